"""The pipeline, stage by stage, and the registered queries."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from dqspark.llm import fertility, langid, simhash  # noqa: E402
from dqspark.llm.queries import QUERIES  # noqa: E402
from dqspark.session import materialize  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents):
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == before.columns
            assert docs.exceptAll(before).count() == 0
        kept.append((before, docs))
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for _, d in kept]
    known = langid.predict(documents, langid.learn(documents, ~langid.held_out()))
    assert ids[0] == {r.doc_id for r in known.filter("not rejected").collect()}
    assert ids[1] == {r.doc_id for r in fertility.judge(kept[1][0]).filter("kept").collect()}
    signed = materialize(simhash.wide_signatures(kept[2][0]), "signed")
    groups = signed.join(simhash.similar_groups(kept[2][0], signed), "fp", "left")
    least = groups.selectExpr("doc_id", "coalesce(root, fp) root").groupBy("root").agg(F.min("doc_id").alias("i")).collect()
    assert ids[2] == {r.i for r in least} and len(ids[1]) > len(ids[2])
    assert ids[3] == ids[2]
    assert len(ids[0]) >= 0.98 * documents.count()


def test_run_is_its_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_odd_and_empty_rows(spark, odd, empty):
    for docs in (odd, empty):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF), name)
            assert name == "packing" or docs.columns == columns


def test_queries_return_whole_tables(spark):
    n, pages = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages"))
    for name, query in QUERIES.items():
        rows = query(spark, SF)
        assert rows.count() == (pages if name == "op1_html" else n) or name in ("op10_packing", "op11_variants")
