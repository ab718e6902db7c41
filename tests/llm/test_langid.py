"""Language id: held-out accuracy, what is never read, and odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from dqspark.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs, ~langid.held_out())
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in got) <= 0.01 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_every_label_is_learned(spark):
    """Eighty made languages, each with letters of its own kind of words."""
    import random
    rng = random.Random(2)
    rows = []
    for k in range(80):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 8))) for _ in range(40)]
        rows += [(len(rows) + i, " ".join(rng.choices(words, k=60)), f"l{k:02}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, ~langid.held_out())
    assert len(model.labels) == 80
    got = langid.predict(docs, model).join(docs, "doc_id").filter(langid.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_noise_and_unlearned_languages_are_rejected(spark):
    """At 1 % of calibration scores less a margin: nearly no text of a learned language, nearly all others."""
    import random
    rng = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    noise = spark.createDataFrame([(-i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9)))
                                                 for _ in range(60)), "noise") for i in range(1, 101)], docs.schema)
    model = langid.learn(docs.filter("lang <> 'fr'"), ~langid.held_out())
    got = langid.predict(docs.unionByName(noise), model).join(docs.unionByName(noise), "doc_id").collect()
    shares = {}
    for r in got:
        n = shares.setdefault(r.lang if r.lang in ("fr", "noise") else "learned", [0, 0])
        n[0] += r.rejected
        n[1] += 1
    assert shares["noise"][0] >= 0.98 * shares["noise"][1] and shares["fr"][0] >= 0.95 * shares["fr"][1], shares
    assert shares["learned"][0] <= 0.01 * shares["learned"][1], shares


def test_one_hard_row_does_not_move_a_threshold():
    sure = [0.99 + i / 1e5 for i in range(300)]
    a, b = langid.thresholds([sure, []]), langid.thresholds([[0.3, *sure], sure])
    assert abs(a[0] - b[0]) < 0.01 and a[0] > 0.8 and a[1] == a[0]


def test_labels_of_held_out_rows_teach_nothing(documents):
    wrong = documents.withColumn("lang", F.when(langid.held_out(), "zz").otherwise(F.col("lang")))
    a, b = (langid.learn(d, ~langid.held_out()) for d in (documents, wrong))
    assert a.labels == b.labels and np.array_equal(a.logits, b.logits)


def test_prediction_reads_the_text_alone(documents):
    model = langid.learn(documents, ~langid.held_out())
    blank = documents.select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    a = sorted((r.doc_id + 1000, r.lang_pred, r.score) for r in langid.predict(documents, model).collect())
    assert a == sorted((r.doc_id, r.lang_pred, r.score) for r in langid.predict(blank, model).collect())


def test_odd_rows(odd):
    model = langid.learn(odd, F.lit(True))
    got = langid.predict(odd, model).collect()
    assert len(got) == odd.count() and model.labels == ("en",)
    for r in got:
        assert r.lang_pred in ("en", "und")
    text = {r.doc_id: r.text for r in odd.collect()}
    for r in got:
        if r.doc_id is not None:
            no_letter = not any(c.isalpha() for c in text[r.doc_id] or "")
            assert (r.lang_pred == "und") == no_letter and r.rejected >= no_letter
    kept = langid.keep_known(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(not r.rejected for r in got)


def test_nothing_to_learn(empty, odd):
    assert langid.learn(empty, F.lit(True)) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.keep_known(odd, None).count() > 5 and langid.keep_known(empty, None).count() == 0


def test_chunks_do_not_change_counts(monkeypatch):
    text = "Straße über den Fluss, 12 mal! " * 50
    whole = langid.subwords(text)
    monkeypatch.setattr(langid, "_CHUNK", 64)
    assert np.array_equal(whole, langid.subwords(text))
    assert langid.subwords("").sum() == 0
