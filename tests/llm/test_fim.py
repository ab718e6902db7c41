"""Fill-in-middle against a plain cut by regular expression."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dqspark.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_cut(doc_id, text):
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def compare(df):
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    want = sorted((plain_cut(*r) for r in rows), key=str)
    made = fim.transform(df)
    assert sorted((tuple(r) for r in made.collect()), key=str) == want
    back = made.select("doc_id", fim.restore().alias("t")).collect()
    assert sorted((tuple(r) for r in back), key=str) == sorted(rows, key=str)
    return want


def test_odd_texts(odd):
    compare(odd)


def test_sentinels_stay_plain_and_every_form_occurs(spark):
    texts = ["a <P> b", "x<S>", "<M>", "< P> <", "<", "<P", "S> <", "a <", "<<P", "é \x0b\x1f ü"] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r[2] for r in compare(df)} == {"plain", "psm", "spm"}


def test_random_texts(spark):
    rng = random.Random(3)
    alphabet = " \t\n\x0b\x0c\r\x1c\x85\xa0ab<>PSM\x00é日🙂"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(1500)]
    compare(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))


def test_documents_and_empty(documents, empty):
    compare(documents)
    assert fim.transform(empty).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_rank_and_select(seed):
    rng = np.random.default_rng(seed)
    marks = rng.integers(0, 256, 50).astype(np.uint64)
    words = np.zeros(50, np.uint64)
    places = []
    for i, m in enumerate(marks.tolist()):
        for b in range(8):
            if m >> b & 1:
                words[i] |= np.uint64(0x80 << 8 * b)
                places.append(8 * i + b)
    found = fim.Marks(words)
    assert found.select(np.arange(len(places))).tolist() == places
    at = np.arange(401)
    assert found.rank(at).tolist() == [sum(p < x for p in places) for x in at]


def test_white_bytes():
    data = np.arange(256, dtype=np.uint8)
    marked = fim.white(data.view("<u8").astype(np.uint64)).astype("<u8").view(np.uint8) == 0x80
    assert np.nonzero(marked)[0].tolist() == [9, 10, 11, 12, 13, 32]


def test_rate_of_forms(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    n = {r.form: r["count"] for r in fim.transform(df).groupBy("form").count().collect()}
    assert abs(n["plain"] - 2000) < 200 and abs(n["spm"] - 1600) < 200
