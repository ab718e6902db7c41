"""Counts against brute force, bands, verdicts."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from dqspark.llm import fertility
from dqspark.llm.common import CachedEncoder


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    cover, seen, lines = set(), set(), 0
    for i in range(len(w) - 2):
        if found[tuple(w[i:i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            lines += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(cover)


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_table(request, name):
    df = request.getfixturevalue(name)
    got = fertility.judge(df).collect()
    want = Counter((r.doc_id, *counts(r.text)) for r in df.select("doc_id", "text").collect())
    assert Counter(tuple(r)[:1] + tuple(r)[2:7] for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    kept = fertility.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.kept)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t\x1c#|é　"), max_size=60))
def test_counts(text):
    r = fertility.meter(fertility.PIECES, fertility.RANKS).measure(text)
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(text)


def test_far_from_the_band_is_rejected(spark):
    import random
    rnd = random.Random(1)
    words = "the house of a man and his dog stood near some old river where boats went by every morning".split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(150)), "en") for i in range(60)]
    rows.append((99, " ".join("".join(rnd.choice("xqzjkwvXQZ#%") for _ in range(7)) for _ in range(150)), "en"))
    got = {r.doc_id: r for r in fertility.judge(spark.createDataFrame(
        rows, "doc_id long, text string, lang string")).collect()}
    assert not got[99].kept and not got[99].base_failed
    assert sum(r.kept for r in got.values()) >= 58


@pytest.mark.parametrize("n", [400, 60, 12])
def test_a_rare_language_is_drawn_towards_its_script_and_all_rows(spark, n):
    import random
    rnd = random.Random(1)
    words = "the house of a man and his dog stood near some old river where boats went by every morning".split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(150)), "rare" if i < 3 else "en") for i in range(n)]
    rows.append((999, " ".join("".join(rnd.choice("xqzjkwvXQZ#%") for _ in range(7)) for _ in range(150)), "rare"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in fertility.judge(df).collect() if r.kept}
    assert 999 not in kept and {0, 1, 2} <= kept
    assert {r.doc_id for r in fertility.keep_good(df).collect()} == kept


def _plain_limits(rows):
    """Limits by exact quartiles of (band, script, values) rows."""
    def quartiles(some, i):
        return np.quantile([round(r[2][i] * 1000) for r in some], [0.25, 0.5, 0.75])
    out = {}
    for band, script in {(r[0], r[1]) for r in rows}:
        lims = []
        for i, (c, times) in enumerate(zip(fertility.MEASURES, fertility.REACH)):
            wide, own = [r for r in rows if r[1] == script], [r for r in rows if r[0] == band]
            w = (quartiles(wide, i) * len(wide) + quartiles(rows, i) * 20) / (len(wide) + 20)
            q = (quartiles(own, i) * len(own) + w * 20) / (len(own) + 20) / 1000
            step = times * max(q[2] - q[0], 0.02 * abs(q[1]), 0.005)
            lims.append((-1.0 if c == "byte_share" else q[0] - step, 1e9 if c == "evenness" else q[2] + step))
        out[band, script] = lims
    return out


def test_verdicts_against_plain_bands(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(
        "doc_id", "text", F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("lang"))
    rows = {r.doc_id: r for r in fertility.judge(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    sound = [(r.band, fertility.script(texts[i] or ""), [r[c] for c in fertility.MEASURES])
             for i, r in rows.items() if not r.base_failed]
    limits = _plain_limits(sound)
    for i, r in rows.items():
        if r.base_failed:
            assert not r.kept and r.rejected_by is None
            continue
        lims = limits[r.band, fertility.script(texts[i] or "")]
        bad = [c for c, (low, high) in zip(fertility.MEASURES, lims) if not low <= r[c] <= high]
        assert (r.kept, r.rejected_by) == (not bad, bad[0] if bad else None)
    assert 10 < sum(r.rejected_by is not None for r in rows.values()) < 60


def test_each_measure_alone_rejects_a_defect(spark):
    """A planted defect for every measure, which none of the others rejects."""
    import random
    rnd = random.Random(6)
    base = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'").collect()]
    base = [t for t in base if not any(c in t for c in "#*$%&|<>") and 200 < len(t.split()) < 600][:120]
    pool = [w for t in base for w in t.split()]
    few = rnd.sample(pool, 24)
    defects = {"evenness": " ".join(rnd.choices(few, k=2500)),
               "byte_share": " ".join(w + "\U00013000" if i % 17 == 0 else w for i, w in enumerate(rnd.choices(pool, k=500)))}
    rows = [(i, t, "en") for i, t in enumerate(base)] + [(1000 + i, t, "en") for i, t in enumerate(defects.values())]
    got = {r.doc_id: r for r in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    sound = [("en", "s", [r[c] for c in fertility.MEASURES]) for r in got.values() if not r.base_failed]
    lims = _plain_limits(sound)["en", "s"]
    for i, name in enumerate(defects):
        r = got[1000 + i]
        assert not r.base_failed and not r.kept
        assert [c for c, (low, high) in zip(fertility.MEASURES, lims) if not low <= r[c] <= high] == [name]
    assert sum(r.kept for r in got.values()) >= 0.97 * len(base)


def test_empty(empty):
    assert fertility.judge(empty).collect() == [] and fertility.keep_good(empty).collect() == []


def test_scripts():
    assert fertility.script("привет мир x") == "script Cyrillic" and fertility.script("12") == "script none"


def test_a_full_cache_changes_nothing():
    calls = []

    def encode(words):
        calls.extend(words)
        each = [[len(w)] * (len(w) % 3) for w in words]
        return [i for x in each for i in x], np.array(list(map(len, each)))
    small = CachedEncoder(encode, 2)
    for text in (["a", "bb", "a"], ["cc", "d"], ["a"], []):
        small.room()
        ids, lens = small.ids(small.places(text))
        want = [[len(w)] * (len(w) % 3) for w in text]
        assert lens.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    assert calls.count("a") == 2
