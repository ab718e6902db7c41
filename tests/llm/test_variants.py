"""Spelling variants against deletion neighbourhoods and plain counting."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest

from dqspark.llm import variants
from dqspark.session import materialize

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain_words(rows, least=3, typo=97):
    total = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % typo == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= least}


def plain_variants(words):
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            short = w[:i] + w[i + 1:]
            holes[i, short].add(w)
            if short in words:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_documents_with_odd_rows(documents, odd):
    df = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = [tuple(r) for r in df.collect()]
    want = plain_variants(plain_words(rows))
    assert sum(w[1] is not None for w in want) > 100
    assert got(variants.spelling_variants(df)) == want


def test_odd_rows_and_empty(odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert got(variants.spelling_variants(odd)) == plain_variants(plain_words(rows))
    assert got(variants.spelling_variants(empty)) == []


@pytest.mark.parametrize("block, segments", [(4096, 3), (7, 3), (2, 2), (3, 5)])
def test_dense_words_in_any_blocks(spark, block, segments):
    rng = random.Random(block)
    words = {"".join(rng.choices("abé日", k=rng.randrange(5, 9))): rng.randrange(3, 400) for _ in range(700)}
    words |= {"a" * k: k * k for k in range(5, 30)} | {"x" * 300: 9, "x" * 301: 20, "x" * 150 + "y" + "x" * 150: 9}
    df = materialize(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert got(variants.variants(df, block=block, segments=segments)) == plain_variants(words)


def test_ties_and_long_chains(spark):
    words = {"aaaaa" + "b" * i: 3 * 2 ** i for i in range(40)} | {"zzzzx": 5, "zzzzy": 10, "zzzzw": 10}
    df = materialize(spark.createDataFrame(list(words.items()), "word string, n long"))
    rows = got(variants.variants(df))
    assert rows == plain_variants(words)
    assert {r[0]: r[1] for r in rows}["zzzzx"] == "zzzzw"


def test_long_text_is_cut_between_runs(spark):
    text = "Abcdef " * 200_000 + "é" * 30 + "q" * 1_500_000 + " abcdef" * 5
    rows = [(7, text), (8, text)]
    total = Counter()
    for i, t in rows:
        variants.count_text(total, i, t)
    found = {w.decode(): n for w, n in total.items() if n > 2 and len(w.decode()) > 4}
    assert found == plain_words(rows)
