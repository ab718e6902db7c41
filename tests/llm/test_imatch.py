"""I-Match against a plain recomputation of neighbours, and the properties of fingerprints."""

import hashlib
import re
from collections import Counter

import pytest

from dqspark.llm import imatch


def check(df, **band):
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    got = imatch.edited_neighbours(df, **band).collect()
    assert len(got) == len(rows)
    order = sorted({(d is None, -(d or 0)) for d, _ in rows})
    starts = {k: [t for d, t in rows if (d is None, -(d or 0)) == k] for k in order}
    following = dict(zip(order, order[1:] + order[:1]))
    want = Counter()
    for d, t in rows:
        half = len(t) // 2
        own = (d is None, -(d or 0))
        most = max(len(x) // 2 for x in starts[own])
        begin = min(x[:most] for x in starts[following[own]])
        edited = t[:len(t) - half] + begin[:half]
        want[(d, len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    return rows, got


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_rows(request, name):
    rows, got = check(request.getfixturevalue(name))
    size = 8 * (1 + imatch.CHAINS * imatch.LEVELS)
    for r in got:
        assert len(r.fingerprint) == len(r.edited_fingerprint) == size
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.fingerprint == r.edited_fingerprint:
            assert r.near_edited == 1
    prints = {}
    texts = dict(rows)
    for r in got:
        if r.doc_id is not None:
            prints.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in prints.values())


def test_halves_are_nearer_than_strangers(documents):
    got = imatch.edited_neighbours(documents).collect()
    assert sum(r.near_edited for r in got) > 5 * sum(r.near_next for r in got)


def test_one_row_and_none(spark, empty):
    one = spark.createDataFrame([(4, "alpha beta gamma")], "doc_id long, text string")
    _, got = check(one)
    assert got[0].near_next == 1
    assert imatch.edited_neighbours(empty).collect() == []


def test_lexicon_is_the_band(documents):
    texts = [r.text or "" for r in documents.select("text").collect()]
    terms = Counter(w for t in texts for w in {x for x in re.split(r"[^\w]+|_", t.lower()) if x})
    want = sum(0.02 * len(texts) <= n <= 0.1 * len(texts) for n in terms.values())
    got = imatch.lexicon(imatch._keyed(documents, "text"), 0.02, 0.1).count()
    assert got == want


def test_no_python_in_the_plan(documents, capsys):
    imatch.edited_neighbours(documents).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
