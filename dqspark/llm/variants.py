"""Spelling variants: words one edit apart, found by dense prefix and suffix tiles.

Two words, the longer of L code points, are one edit apart exactly if their common prefix and common
suffix together reach L - 1. Cut L into ``SEGMENTS``: the segment in which the common prefix ends
says which code points before and behind it must agree, so those form the key under which the two
meet, and only there. Rows sorted by key are cut into tiles at key borders; the words of a tile are
padded matrices of code points, one aligned left and one right, and all pairs of a tile are compared
column by column. A key with more than ``BLOCK`` words is dealt into blocks and every pair of its
blocks is a unit of work, so no key is gathered whole.

Each tile reports for each of its words how many others are near and the most frequent one, which
sums and minima over the keys complete. Forms at least double the count, so following them ends;
roots come from doubling the way of every word until none moves.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dqspark.llm.common import longs, map_batches, small_batches
from dqspark.session import materialize

SEGMENTS = 3
BLOCK = 4096
TILE = 128
#: Cells of one comparison.
CELLS = 1 << 21
#: One of so many pairs of document and run loses a code point.
TYPO = 97
LEAST_LENGTH, LEAST_COUNT, DOMINANCE = 5, 3, 2
#: Runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8 whose A-Z are lower-cased.
_RUN = re.compile(rb"(?:[a-z]++|(?:\xc3[\x80-\xbf])++)++")
#: A byte at which a text may be cut: no part of a run.
_BORDER = re.compile(rb"[^a-z\x80-\xff]")
_ASCII = bytes(b if chr(b).isascii() and chr(b).islower() else 32 for b in range(256))
_PIECE = 1 << 20
_MOST_WORDS = 300_000


def _pieces(data: bytes):
    """A text cut between runs, so that one piece after another is held."""
    at = 0
    while at < len(data):
        cut = _BORDER.search(data, at + _PIECE)
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def runs(text: str):
    """Lower-cased runs of a text as UTF-8, piece by piece."""
    for piece in _pieces(text.encode().lower()):
        yield piece.translate(_ASCII).split() if piece.isascii() else _RUN.findall(piece)


def _shortened(run: bytes, h: int) -> bytes:
    word = run.decode()
    at = h % len(word)
    return (word[:at] + word[at + 1:]).encode()


def count_text(total: Counter, doc_id: int | None, text: str, typo: int = TYPO) -> None:
    """Add the words of a text: its runs, less a code point where the hash of id and run says so."""
    seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for found in runs(text):
        total.update(found)
        hit = {w for w in set(found) if not crc32(w, seed) % typo}
        if hit:
            for w, n in Counter(filter(hit.__contains__, found)).items():
                total[w] -= n
                total[_shortened(w, crc32(w, seed))] += n


def word_counts(docs: DataFrame, typo: int = TYPO, length: int = LEAST_LENGTH,
                least: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of all words of ``docs(doc_id, text)`` with enough code points and occurrences.

    Counts are added up in each task before the shuffle. A null text has no words.
    """
    small_batches(docs.sparkSession)

    def work(batches):
        total: Counter = Counter()

        def out():
            some = [(w, n) for w, n in total.items() if n and (len(w) >= length)]
            total.clear()
            words = pa.array([w for w, _ in some], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_pydict({"word": words, "n": longs([n for _, n in some])})

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                count_text(total, i, text.as_py() or "", typo)
                if len(total) > _MOST_WORDS:
                    yield out()
        yield out()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    parts = slim.mapInArrow(work, "word string, n long")
    return (parts.groupBy("word").agg(F.sum("n").alias("n"))
            .filter((F.char_length("word") >= length) & (F.col("n") >= least)))


def _keys(words: DataFrame, segments: int) -> DataFrame:
    """``(length, seg, key, word, n)``: each word under every key, as the longer and as the shorter
    one of a pair."""
    size = F.char_length("word")
    keyed = words.withColumn("length", F.explode(F.array(size, size + 1)))
    keyed = keyed.withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
    low = F.floor(F.col("length") * F.col("seg") / segments).cast("int")
    high = F.floor(F.col("length") * (F.col("seg") + 1) / segments).cast("int")
    tail = F.col("length") - high
    key = F.xxhash64("length", "seg", F.substring("word", F.lit(1), low),
                     F.substring("word", size - tail + 1, tail))
    return keyed.select("length", "seg", key.alias("key"), "word", "n")


def _units(words: DataFrame, segments: int, block: int) -> DataFrame:
    """Keyed words with the pair of blocks they are compared in; one block where the key is small."""
    keyed = _keys(words, segments)
    full = keyed.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > block)
    full = materialize(full, "full")
    dealt = keyed.join(full, "key", "left")
    blocks = F.ceil(F.coalesce("rows", F.lit(1)) / block).cast("int")
    own = F.pmod(F.xxhash64("word"), blocks).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.select("length", "seg", "key", F.least("own", "other").alias("a"),
                        F.greatest("own", "other").alias("b"), "own", "word", "n")


class _Matrix:
    """Code points of words, one column of the array for each place, from the left and the right."""

    def __init__(self, words: list[str], width: int):
        points = np.array([len(w) for w in words])
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        starts = np.cumsum(points) - points
        row = np.repeat(np.arange(len(words)), points)
        place = np.arange(len(flat)) - np.repeat(starts, points)
        kind = np.uint8 if len(flat) and flat.max() < 256 else np.uint32
        self.left, self.right = np.zeros((2, width, len(words)), kind)
        self.left[place, row] = flat
        self.right[np.repeat(points, points) - 1 - place, row] = flat
        self.size = points


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading places at which all pairs of columns of ``a`` and ``b`` agree."""
    alive = np.ones((a.shape[1], b.shape[1]), bool)
    total = np.zeros(alive.shape, np.int32 if len(a) > 250 else np.uint8)
    for x, y in zip(a, b):
        alive &= x[:, None] == y[None, :]
        if not alive.any():
            break
        total += alive
    return total


def near_pairs(a: _Matrix, b: _Matrix, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all near pairs whose common prefix ends from place ``low`` to before ``high``."""
    width = len(a.left)
    prefix = _agreement(a.left, b.left)
    i, j = np.nonzero((prefix >= low) & (prefix < high))
    longer = np.maximum(a.size[i], b.size[j]) == width
    i, j = i[longer], j[longer]
    alive, suffix = np.ones(len(i), bool), np.zeros(len(i), np.int64)
    for k in range(width):
        alive &= a.right[k, i] == b.right[k, j]
        if not alive.any():
            break
        suffix += alive
    near = (prefix[i, j] + suffix >= width - 1) & (np.abs(a.size[i] - b.size[j]) <= 1)
    return i[near], j[near]


class _Found:
    """For each row of a unit: how many near words, and the best of them."""

    def __init__(self, words: list[str], counts: np.ndarray):
        self.words, self.counts = words, counts
        self.order = np.lexsort((np.argsort(np.argsort(np.array(words, object))), -counts))
        self.rank = np.empty(len(words), np.int64)
        self.rank[self.order] = np.arange(len(words))
        self.n = np.zeros(len(words), np.int64)
        self.best = np.full(len(words), len(words), np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.n, i, 1)
        np.minimum.at(self.best, i, self.rank[j])

    def rows(self) -> dict:
        at = np.nonzero(self.n)[0]
        best = self.order[self.best[at]]
        return {"word": pa.array([self.words[k] for k in at], pa.string()), "n_near": longs(self.n[at]),
                "near_n": longs(self.counts[best]), "near": pa.array([self.words[k] for k in best], pa.string())}


def _solve(words: list[str], counts: np.ndarray, length: int, seg: int, segments: int,
           key: np.ndarray, own: np.ndarray, crossed: np.ndarray) -> dict:
    """Compare the rows of one (length, segment), sorted by unit; ``key`` numbers their units.

    ``crossed`` says for each row whether its unit holds two blocks, whose words are compared with
    those of the other block only.
    """
    low, high = length * seg // segments, length * (seg + 1) // segments
    found, borders = _Found(words, counts), np.append(np.nonzero(np.diff(key, prepend=key[0] - 1))[0], len(key))
    at = 0
    while at < len(borders) - 1:
        # as many whole units as fit a tile, or one unit that is larger
        to = max(at + 1, int(np.searchsorted(borders, borders[at] + TILE, side="right")) - 1)
        lo, hi = int(borders[at]), int(borders[to])
        at = to
        if hi - lo < 2:
            continue
        step = max(1, CELLS // ((hi - lo) * max(1, length // 64)))
        cols = max(1, min(hi - lo, CELLS // max(1, length)))
        for x in range(lo, hi, step):
            rows = _Matrix(words[x:min(hi, x + step)], length)
            for y in range(lo, hi, cols):
                others = _Matrix(words[y:min(hi, y + cols)], length)
                i, j = near_pairs(rows, others, low, high)
                i, j = i + x, j + y
                keep = (key[i] == key[j]) & (~crossed[i] | (own[i] != own[j]))
                found.add(i[keep], j[keep])
    return found.rows()


def near_words(words: DataFrame, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """``(word, n_near, near_n, near)`` for the words of stored ``(word, n)`` that have near words:
    their number, and the one of largest n (ties: the least in code-point order). Words are distinct.
    """
    small_batches(words.sparkSession)
    units = _units(words, segments, block)
    by = ["length", "seg", "key", "a", "b"]
    # every row of a unit in one partition; a unit has about two blocks at most
    units = units.repartition(*by).sortWithinPartitions(*by)

    def solve(batches):
        """Rows of equal (length, seg) are solved together, whole units at a time."""
        held: list[pa.RecordBatch] = []

        def settle(last: bool):
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            cols = {c: table.column(c).to_numpy() for c in [*by, "own", "n"]}
            change = np.zeros(len(table), bool)
            for c in by:
                change[1:] |= cols[c][1:] != cols[c][:-1]
            unit = np.cumsum(change)
            done = len(unit) if last else int(np.searchsorted(unit, unit[-1])) if len(unit) else 0
            kind = (cols["length"] != np.roll(cols["length"], 1)) | (cols["seg"] != np.roll(cols["seg"], 1))
            cuts = [0, *(np.nonzero(kind[1:done])[0] + 1), done]
            words_ = table.column("word").slice(0, done).to_pylist()
            crossed = cols["a"] != cols["b"]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    out = _solve(words_[lo:hi], cols["n"][lo:hi], int(cols["length"][lo]), int(cols["seg"][lo]),
                                 segments, unit[lo:hi], cols["own"][lo:hi], crossed[lo:hi])
                    yield pa.RecordBatch.from_pydict(out)
            if done < len(unit):
                held.extend(table.slice(done).to_batches())

        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
                if rows >= BLOCK:
                    yield from settle(False)
                    rows = 0
        if held:
            yield from settle(True)

    parts = units.mapInArrow(solve, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.m")).alias("near_n"), F.col("best.w").alias("near"))


def roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` for every word of stored acyclic ``(word, form)`` rows, one row a word.

    Each round doubles how far a word has come, as a written table.
    """
    now = links.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialize(now.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def variants(words: DataFrame, dominance: int = DOMINANCE, segments: int = SEGMENTS,
             block: int = BLOCK) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of stored distinct ``(word, n)``.

    The form of a word is its near word of largest n if that is at least ``dominance`` (above 1)
    times its own; else null, and the word is its own root. An empty table stays empty.
    """
    near = materialize(near_words(words, segments, block), "near")
    own = words.join(near, "word", "left")
    formed = F.col("near_n") >= dominance * F.col("n")
    own = materialize(own.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "forms")
    root = roots(own.filter("form is not null").select("word", "form"))
    return own.join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants of the words of ``docs(doc_id, text)``.

    Null, empty and wordless texts add nothing; repeated rows count again, ties go to the least
    word, a null doc_id counts as an empty number, and other columns are not read.
    """
    return variants(materialize(word_counts(docs), "words"))
