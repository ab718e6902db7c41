"""Mixing against plain targets, and the shards' texts against what is said to be taken."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dqspark.llm import mixture

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Share by weight; who is above three times its size stops there, and the rest is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def sources(rows):
    out = Counter()
    for source, size in rows:
        out[source] += size
    return dict(out)


@pytest.mark.parametrize("sizes", [
    [("a", 10), ("b", 1000), ("c", 5), (None, 300)], [("a", 7)], [("a", 0), (None, 0)],
    [(f"s{i:02}", (i * 37) % 11 * i) for i in range(40)], [("Z", 5), ("a", 5), ("é", 900), ("", 40)]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes)], "doc_id long, source string, size long")
    got = {r.source: r.target for r in mixture.targets(df).collect()}
    want = plain_targets(sources(sizes))
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(spark, n):
    rows = spark.range(n).select(*[mixture.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(k)) for k in (1, 2)]).collect()
    assert sorted(r[0] for r in rows) == sorted(r[1] for r in rows) == list(range(n))
    if n == 1000:
        assert sum(r[0] == r[1] for r in rows) < 20
        steps = Counter((b[0] - a[0]) % n for a, b in zip(rows, rows[1:]))
        assert max(steps.values()) < 20          # neighbours do not stay together


def check(df, block=16):
    mixed = mixture.mix(df, block=block, shard_slots=8)
    rows = mixture.taken(mixed).collect()
    again = mixture.taken(mixture.mix(df.repartition(7), block=block, shard_slots=8)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    want = Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in
                   df.select("doc_id", "source", "text").collect())
    assert Counter((r.doc_id, r.source, r["size"]) for r in rows) == want
    size = sources((r.source, r["size"]) for r in rows)
    target, took = plain_targets(size), sources((r.source, r.taken) for r in rows)
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 3 * r["size"]
    for s in size:
        assert abs(took[s] - target[s]) <= 2 * block
    return mixed, rows


def test_odd_rows_and_empty(odd, empty):
    check(odd)
    assert mixture.taken(mixture.mix(empty)).collect() == []


def test_documents_and_shards(documents):
    mixed, rows = check(documents, 64)
    held = mixture.shard_texts(mixed, documents).collect()
    got, by_slot = defaultdict(int), defaultdict(list)
    for r in held:
        got[r.doc_id] += len(WORD.findall(r.text))
        by_slot[r.number, r.slot].append(r)
    assert {r.doc_id: r.taken for r in rows if r.taken} == dict(got)
    texts = {r.doc_id: WORD.findall(r.text or "") for r in documents.collect()}
    streams = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.doc_id):
        streams[r.source] += texts[r.doc_id]
    source = {r.number: r.source for r in mixed.goals.collect()}
    plan = {(r.number, r.slot): r for r in mixed.slots.collect()}
    assert plan.keys() == by_slot.keys()
    for at, parts in by_slot.items():
        words = " ".join(r.text for r in sorted(parts, key=lambda r: r.start)).split(" ")
        b = plan[at].block * 64
        assert words == streams[source[at[0]]][b:b + 64]
    for number in source:
        slots = [k for k in plan if k[0] == number]
        times = Counter(plan[k].block for k in slots)
        assert max(times.values()) - min(times.get(b, 0) for b in range(max(times) + 1)) <= 1
    assert len({r.shard for r in plan.values()}) > 3


def test_no_python_on_the_main_path(documents):
    mixed = mixture.mix(documents)
    for df in (mixture.taken(mixed), mixture.shard_texts(mixed, documents)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
