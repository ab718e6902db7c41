"""Best-fit packing of token sequences under several capacities at once.

A piece asks for tokens, one document place and attention cost (the square of its length). Pieces
are placed in order of falling length into the bin whose residual after the placement has the
least weighted norm (or the largest weighted dot product with the piece), among the bins that
hold it under every capacity. Pieces are dealt by hash into groups of a fixed size, packed side by
side; a group leaves a bin or two half empty, whatever the size of the corpus.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dqspark.llm.common import longs, map_batches, small_batches, texts
from dqspark.llm.tokens import END, VOCABULARY, encoder
from dqspark.session import materialize

GROUP = 8192


@dataclass(frozen=True)
class Bins:
    """Capacities and weights. With the default documents and attention the tokens bind first."""
    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02)
    rule: str = "norm"                       # or "dot"


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of ``most`` tokens but the first."""
    head = n % most or min(n, most)
    return [(0, head), *((s, most) for s in range(head, n, most))]


def place(lengths: np.ndarray, bins: Bins) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece of a group."""
    lengths = np.asarray(lengths, np.int64)
    at, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    whole = int((lengths == bins.tokens).sum())
    at[order[:whole]] = np.arange(whole)
    rest = order[whole:]
    if not len(rest):
        return at, offset
    if (lengths ** 2).max() > bins.attention or bins.documents < 1 or lengths.max() > bins.tokens:
        raise ValueError("a piece fits no empty bin")
    full = np.array([bins.tokens, bins.documents, bins.attention], np.float64)
    scale = np.array(bins.weights) / full ** (1 if bins.rule == "dot" else 2)
    least = int(lengths[rest[-1]])
    left = np.empty((3, len(rest)), np.float64)     # residuals of the open bins
    name = np.empty(len(rest), np.int64)
    n, made = 0, whole
    for i in rest:
        length = int(lengths[i])
        ask = np.array([length, 1, length * length], np.float64)
        after = left[:, :n] - ask[:, None]
        fits = (after >= 0).all(0)
        best = -1
        if fits.any():
            if bins.rule == "dot":
                value = -(scale * ask / full) @ left[:, :n]
            else:
                value = scale @ (after * after)
            best = int(np.argmin(np.where(fits, value, np.inf)))
        if best < 0:
            best, left[:, n], name[n] = n, full, made
            n, made = n + 1, made + 1
        at[i], offset[i] = name[best], bins.tokens - int(left[0, best])
        left[:, best] -= ask
        if left[0, best] < least or left[1, best] < 1 or left[2, best] < least * least:
            n -= 1                                  # nothing more fits: the last open bin moves up
            left[:, best], name[best] = left[:, n], name[n]
    return at, offset


def pieces(docs: DataFrame, most: int, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every text, cut only beyond ``most`` ids.

    A null or empty text is its end id alone.
    """
    def make():
        encode = encoder(vocabulary)

        def work(batch):
            rows = [(doc_id, k, s, n, zlib.crc32(ids[s:s + n].astype("<u4").tobytes()))
                    for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch))
                    for ids in [encode.ids(text, end)]
                    for k, (s, n) in enumerate(cut(len(ids), most))]
            doc_id, piece, start, length, crc = zip(*rows)
            return {"doc_id": longs(doc_id), "piece": pa.array(piece, pa.int32()),
                    "start": longs(start), "length": longs(length), "ids_crc32": longs(crc)}
        return work

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return map_batches(slim, make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(rows: DataFrame, bins: Bins = Bins(), group: int = GROUP) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset`` by their column ``length``.

    The rows are stored first and dealt by content and place in the store, so one document with
    many pieces, or one repeated row, spreads over all groups. An empty table stays empty; a
    piece longer than a bin raises.
    """
    small_batches(rows.sparkSession)
    stored = materialize(rows.withColumn("_tie", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-stored.count() // group))
    dealt = stored.withColumn("_group", F.pmod(F.xxhash64(F.col("length"), F.col("_tie")),
                                               F.lit(groups)))
    dealt = dealt.repartition(min(groups, 1 << 16), "_group").sortWithinPartitions(
        "_group", F.desc("length"), "_tie").drop("_tie")
    columns = rows.columns

    def run(batches):
        """The rows of a group follow one another, over batches."""
        held, now = [], None

        def close():
            table = pa.Table.from_batches(held)
            at, offset = place(table.column("length").to_numpy(), bins)
            table = table.select(columns).append_column("sequence_id", longs((now << 32) + at))
            return table.append_column("offset", longs(offset)).combine_chunks().to_batches()

        for batch in batches:
            keys = batch.column("_group").to_numpy()
            cuts = [0, *(np.nonzero(np.diff(keys))[0] + 1), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if held and keys[lo] != now:
                        yield from close()
                        held = []
                    now = int(keys[lo])
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield from close()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, bins: Bins = Bins(), vocabulary: str = VOCABULARY,
                   end: int = END) -> DataFrame:
    """Every piece of every text with its sequence and its place there."""
    return pack(pieces(docs, bins.tokens, vocabulary, end), bins)
