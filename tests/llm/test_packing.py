"""Packing: every token once, no capacity broken, few sequences."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from dqspark.llm import packing
from dqspark.llm.packing import Bins
from dqspark.llm.tokens import VOCABULARY

LIBRARY = Tokenizer.from_file(VOCABULARY)


def valid(lengths, at, offset, bins):
    held = defaultdict(list)
    for n, b, o in zip(lengths, at, offset):
        held[b].append((o, n))
    for some in held.values():
        some.sort()
        assert [o for o, _ in some] == list(np.cumsum([0, *[n for _, n in some[:-1]]]))
        assert sum(n for _, n in some) <= bins.tokens and len(some) <= bins.documents
        assert sum(n * n for _, n in some) <= bins.attention
    return len(held)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.sampled_from(["norm", "dot"]),
       st.integers(1, 10), st.integers(4096, 5000))
def test_every_capacity_holds(lengths, rule, documents, attention):
    bins = Bins(64, documents, attention, rule=rule)
    valid(lengths, *packing.place(np.array(lengths, int), bins), bins)


def test_near_the_bound():
    lengths = np.random.default_rng(1).integers(1, 1024, 5000)
    bins = Bins()
    n = valid(lengths, *packing.place(lengths, bins), bins)
    assert n <= 1.01 * lengths.sum() / 1024


def test_a_piece_that_fits_nowhere_is_refused():
    with pytest.raises(ValueError):
        packing.place(np.array([9]), Bins(8))


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_table(request, name):
    df = request.getfixturevalue(name)
    bins = Bins(256, 256, 256 * 256)
    got = packing.pack(packing.pieces(df, bins.tokens), bins, group=100).collect()
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids + [2]
        want += [(r.doc_id, k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()))
                 for k, (s, n) in enumerate(packing.cut(len(ids), 256))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    n = valid([r.length for r in got], [r.sequence_id for r in got], [r.offset for r in got], bins)
    groups = len({r.sequence_id >> 32 for r in got})
    assert n <= sum(r.length for r in got) / 256 * 1.01 + 2 * groups


def test_empty(empty):
    assert packing.pack_documents(empty).collect() == []


def test_one_document_with_many_pieces_spreads(spark):
    df = spark.createDataFrame([(1, "word " * 30_000), (2, "x")], "doc_id long, text string")
    rows = packing.pieces(df, 64)
    got = packing.pack(rows, Bins(64, 64, 4096), group=50).collect()
    assert len({r.sequence_id >> 32 for r in got}) > 5 and len(got) == rows.count()
