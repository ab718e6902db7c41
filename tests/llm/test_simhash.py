"""SimHash: fingerprints and components against brute force."""

import re

import numpy as np
import xxhash

from dqspark.llm import simhash
from dqspark.llm.components import components


def slow_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def slow_groups(rows, bits=4):
    """(fingerprint, component) of (id, fingerprint) rows, repeated as they come."""
    fps = sorted({f for _, f in rows})
    top = {f: f for f in fps}

    def find(f):
        while top[f] != f:
            f = top[f]
        return f
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                top[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in rows), key=str)


def check(df, **kw):
    rows = [(r.doc_id, slow_print(r.text)) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in simhash.near_duplicates(df, **kw).collect()), key=str)
    assert got == slow_groups(rows)


def test_odd_rows(odd):
    check(odd)


def test_documents(documents):
    check(documents)


def test_large_nodes_are_cut_into_runs(documents):
    check(documents, node_rows=5)


def test_links_of_nodes_in_any_batches(spark, monkeypatch):
    """Nodes of one to many members, in batches that cut them anywhere."""
    x = near(np.random.default_rng(8), 900)
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    want = len({r[2] for r in slow_groups([(i, int(v)) for i, v in enumerate(x)])})
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for small, held, rows in ((32, 16384, 512), (1, 1, 7), (3, 40, 11)):
        monkeypatch.setattr(simhash, "SMALL", small)
        monkeypatch.setattr(simhash, "_HELD", held)
        monkeypatch.setattr(simhash, "small_batches", lambda s, n=rows: s.conf.set(
            "spark.sql.execution.arrow.maxRecordsPerBatch", str(n)))
        links = simhash.near_links(fps)
        roots = {r.node: r.root for r in components(simhash.materialize(links, "links")).collect()}
        assert len({roots.get(int(v), int(v)) for v in x.view(np.int64)}) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_large_nodes_keep_links_of_a_wider_radius(spark):
    fps = spark.createDataFrame([(0x111 << 48,), (0x111 << 48 ^ 0xFFF << 20,)], "fp long")
    assert simhash.near_links(fps, 12, node_rows=1).count() == 1


def test_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_one(empty).collect() == []


def near(rng, n):
    x = rng.integers(0, 2**63, 40, dtype=np.uint64)[rng.integers(0, 40, n)]
    for _ in range(4):
        flip = rng.integers(0, 2, n).astype(np.uint64) << rng.integers(0, 64, n).astype(np.uint64)
        x = x ^ flip
    return np.unique(x)


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(3)
    for n in (1, 2, 60, 300, 900):
        x = near(rng, n)
        a, b = simhash.forest(x)
        assert all((int(p) ^ int(q)).bit_count() <= 4 for p, q in zip(a, b)) and len(a) < max(len(x), 1)
        ids = {int(v): i for i, v in enumerate(x)}
        want = slow_groups([(i, int(v)) for i, v in enumerate(x)])
        top = {v: v for v in ids}
        for p, q in zip(a.tolist(), b.tolist()):
            while top[p] != p:
                p = top[p]
            while top[q] != q:
                q = top[q]
            top[p] = q

        def find(v):
            while top[v] != v:
                v = top[v]
            return v
        assert len({find(v) for v in top}) == len({r[2] for r in want})


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (1, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}


def test_keep_one_keeps_columns_and_the_least(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    want = {c for _, _, c in slow_groups([(r.doc_id, slow_print(r.text)) for r in odd.collect()])}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)


def test_group_without_ids_keeps_one_row(spark):
    df = spark.createDataFrame([(None, "no id here at all"), (None, "no id here at all"), (3, "other words")],
                               "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in simhash.keep_one(df).collect()) == ["3", "None"]


def near_pairs(sets, least=0.8):
    """All pairs of ids whose sets have that Jaccard similarity, by the rarest elements of each."""
    from collections import Counter, defaultdict
    from math import ceil
    share = Counter(h for s in sets.values() for h in s)
    places, out = defaultdict(list), {}
    for i, s in sets.items():
        for h in sorted(s, key=lambda h: (share[h], h))[:len(s) - ceil(least * len(s)) + 1]:
            for k in places[h]:
                if (k, i) not in out:
                    t = sets[k]
                    out[k, i] = min(len(s), len(t)) >= least * max(len(s), len(t)) and len(s & t) >= least * len(s | t)
            places[h].append(i)
    return [p for p, near in out.items() if near]


def test_similar_groups_find_near_copies(spark):
    """Recall on all texts of sf0.1; no two groups of true similarity are merged beyond it."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sets = {r.doc_id: frozenset(simhash.shingle_hashes(r.text or "", 5).tolist()) for r in docs.collect()}
    first = {}
    for i, s in sorted(sets.items()):
        first.setdefault(s, i)
    pairs = near_pairs({i: s for s, i in first.items()})
    top = {i: first[s] for i, s in sets.items()}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    for a, b in pairs:
        top[find(a)] = find(b)
    signed = simhash.materialize(simhash.wide_signatures(docs), "signed")
    groups = simhash.similar_groups(docs, signed)
    rows = signed.join(groups, "fp", "left").selectExpr("doc_id", "coalesce(root, fp) root").collect()
    root = {r.doc_id: r.root for r in rows}
    found = sum(root[a] == root[b] for a, b in pairs)
    assert found >= 0.9 * len(pairs) and all(root[i] == root[first[s]] for i, s in sets.items())
    want, got = len({find(i) for i in sets}), len(set(root.values()))
    assert want <= got <= want + 0.1 * len(pairs)
    assert len({(find(i), root[i]) for i in sets}) == got            # every group lies within a true one
    kept = {r.doc_id for r in simhash.keep_one_similar(docs).select("doc_id").collect()}
    least = {}
    for i, r in sorted(root.items()):
        least.setdefault(r, i)
    assert kept == set(least.values())


def test_wide_print_is_a_majority():
    import random
    rng = random.Random(1)
    hashes = np.array([rng.getrandbits(64) for _ in range(9)] * 2, np.uint64)
    bits = np.zeros(512, int)
    for h in set(hashes.tolist()):
        for j in range(8):
            z = (h + j * 0x9E3779B97F4A7C15) % 2**64
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
            z ^= z >> 31
            for k in range(64):
                bits[64 * j + k] += z >> k & 1
    want = [sum(1 << k for k in range(64) if 2 * bits[64 * j + k] > 9) for j in range(8)]
    assert simhash.wide_print(hashes).tolist() == want


def test_similar_odd_rows_and_small_nodes(spark, odd, empty):
    kept = simhash.keep_one_similar(odd)
    texts = {simhash.wide_print(simhash.shingle_hashes(r.text or "", 5)).tobytes() for r in odd.collect()}
    assert kept.columns == odd.columns and kept.count() == len(texts)
    assert simhash.keep_one_similar(empty).collect() == []
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    signed = simhash.materialize(simhash.wide_signatures(docs), "signed")
    a, b = (simhash.similar_groups(docs, signed, node_rows=n) for n in (simhash.NODE_ROWS, 3))

    def parts(df):
        out = {}
        for r in df.collect():
            out.setdefault(r.root, set()).add(r.fp)
        return sorted(map(sorted, out.values()))
    assert parts(a) == parts(b) != []


def test_similar_groups_lose_no_pair(spark):
    """Pairs just above the similarity asked for, pairs just below it, among texts that share a long passage."""
    import random
    rng = random.Random(5)
    line = " ".join(f"common{i}" for i in range(40))
    rows = []
    for i in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        at = rng.randrange(1, 99)
        cut = rng.choice((8, 10, 11, 12, 14, 30))
        copy = words[:-cut] + [f"x{rng.randrange(10**6)}" for _ in range(cut)]
        for text in (words, copy):
            rows.append((len(rows), " ".join(text[:at] + [line] * (i % 2) + text[at:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = {i: frozenset(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    pairs = near_pairs(sets)
    signed = simhash.materialize(simhash.wide_signatures(docs), "signed")
    groups = simhash.similar_groups(docs, signed)
    root = {r.doc_id: r.root for r in signed.join(groups, "fp", "left").selectExpr(
        "doc_id", "coalesce(root, fp) root").collect()}
    assert 100 < len(pairs) < 300 and [p for p in pairs if root[p[0]] != root[p[1]]] == []
    assert len(set(root.values())) == len(rows) - len(pairs)


def test_prefixes_hold_the_pairs_that_the_first_round_leaves(spark, monkeypatch):
    """A chain of texts, an order that puts most shingles last, and no first round."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[6 * i:6 * i + 100])) for i in range(16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    star = simhash.star_pairs
    monkeypatch.setattr(simhash, "star_pairs", lambda *args: star(*args).limit(0))
    assert len(simhash.common_shingles(docs, 5)[0]) > 50
    assert simhash.keep_one_similar(docs).collect()[0].doc_id == 0
