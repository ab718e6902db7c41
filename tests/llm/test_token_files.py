"""Token files: exact round trips, ranges, and ids of the tokenizers library."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from dqspark.llm import token_files as tf
from dqspark.llm.tokens import VOCABULARY, encoder

LIBRARY = Tokenizer.from_file(VOCABULARY)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\t .,'srt1ß日🙂ab")), max_size=30), max_size=4))
def test_cached_ids_are_those_of_the_library(texts):
    for t in texts:
        assert encoder(VOCABULARY).ids(t).tolist() == ids(t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500), st.integers(0, 20), st.data())
def test_file_round_trip(values, bits, data):
    values = np.array(values, np.uint32) >> np.uint32(bits)
    file = tf.TokenFile(tf.to_bytes(values, [5, None], [len(values), 0]))
    assert file.ids().tolist() == values.tolist() and file.doc_ids == [5, None]
    lo = data.draw(st.integers(0, len(values)))
    hi = data.draw(st.integers(lo, len(values)))
    assert file.ids(lo, hi).tolist() == values[lo:hi].tolist()


def test_outliers_become_exceptions():
    values = np.full(1024, 7, np.uint32)
    values[::100] = 4_000_000_000
    file = tf.TokenFile(tf.to_bytes(values, [1], [1024]))
    assert file.extra.sum() == 11 and file.widths.max() == 0 and len(file.data) < 400
    assert file.ids().tolist() == values.tolist()


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_table(spark, request, name):
    df = request.getfixturevalue(name)
    files = tf.write(df, tf.folder(spark), file_ids=5000, part_bytes=30_000)
    got = tf.read(files).collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, ids(r.text)) for r in df.select("doc_id", "text").collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    got = sorted(got, key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    assert all(zlib.crc32(r.ids) == zlib.crc32(np.frombuffer(r.ids, "<u4").tobytes()) for r in got)
    assert files.count() > 1


def test_empty(spark, empty):
    assert tf.read(tf.write(empty, tf.folder(spark))).collect() == []
