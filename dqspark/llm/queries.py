"""The registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.llm import (bpe, fertility, fim, html_text, imatch, langid, licenses, mixture, packing,
                         ring, simhash, token_files, variants)
from dqspark.llm.common import tables


def op1_html(spark, sf_dir):
    return html_text.extract(tables(spark, sf_dir, "pages"))


def op2_bpe(spark, sf_dir):
    coded = bpe.decode(bpe.encode(tables(spark, sf_dir, "documents")))
    decimal = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(decimal, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_ring(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    slim = tables(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"))
    put = ring.assign(slim, "doc_id", "text_crc32")
    return put.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(tables(spark, sf_dir, "documents"))


def op5_token_files(spark, sf_dir):
    files = token_files.write(tables(spark, sf_dir, "documents"), token_files.folder(spark))
    return token_files.read(files).select("doc_id", "start", "n_tokens",
                                          F.crc32("ids").alias("ids_crc32"))


def op6_language(spark, sf_dir):
    docs = tables(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang")
    model = langid.learn(docs, ~langid.held_out())
    return langid.predict(docs, model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_imatch(spark, sf_dir):
    return imatch.edited_neighbours(tables(spark, sf_dir, "documents"))


def op8_fertility(spark, sf_dir):
    return fertility.judge(tables(spark, sf_dir, "documents"))


def op9_licenses(spark, sf_dir):
    return licenses.find_licenses(tables(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.pack_documents(tables(spark, sf_dir, "documents"))


def op11_variants(spark, sf_dir):
    return variants.spelling_variants(tables(spark, sf_dir, "documents"))


def op12_fim(spark, sf_dir):
    cut = fim.transform(tables(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim.restore(), 256).alias("restored_sha256"))


def op13_mixture(spark, sf_dir):
    mixed = mixture.mix(tables(spark, sf_dir, "documents"))
    return mixture.taken(mixed).select("doc_id", "size", "source_size", "target", "taken", "source")


QUERIES = {q.__name__: q for q in (
    op1_html, op2_bpe, op3_ring, op4_simhash, op5_token_files, op6_language, op7_imatch,
    op8_fertility, op9_licenses, op10_packing, op11_variants, op12_fim, op13_mixture)}
#: No operator's result can be stated in SQL: each rests on hashing, a vocabulary, a trained model,
#: an alignment or an order of placement. They are tested against brute force instead.
ORACLES: dict[str, str] = {}
