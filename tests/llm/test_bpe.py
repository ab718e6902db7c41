"""Distributed BPE against the tiktoken library, text by text."""

import public_tokenizers
import tiktoken
from hypothesis import given, settings, strategies as st

from dqspark.llm import bpe

LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                            mergeable_ranks=bpe.ranks(bpe.VOCABULARY), special_tokens={})


def check(df):
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.ids, bytes(r.decoded)) for r in bpe.decode(bpe.encode(df)).collect()]
    want = [(d, LIBRARY.encode_ordinary(t), t.encode()) for d, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_odd_rows(odd):
    check(odd)


def test_documents(documents, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 20_000)
    check(documents)


def test_empty(empty):
    assert bpe.decode(bpe.encode(empty)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t \x1c.,'sdltmré1ß日🙂ab　 ")), max_size=30))
def test_blocks_split_like_the_pattern(text):
    split = bpe.compiled(public_tokenizers.PATTERN)
    block = bpe.Block(split, True)
    block.add("foo bar\n baz")
    block.add(text)
    words = list(block.words)
    pieces = [words[i] for i in block.positions()[1]]
    assert pieces == split.findall(text)
    assert [i for p in pieces for i in LIBRARY.encode_ordinary(p)] == LIBRARY.encode_ordinary(text)


def test_numbering_needs_no_positions():
    split = bpe.compiled(public_tokenizers.PATTERN)
    a, b = bpe.Block(split, True), bpe.Block(split, False)
    for t in ("to be or  not", "not to be", "\n x \n y", ""):
        a.add(t)
        b.add(t)
    assert list(a.words) == list(b.words)
