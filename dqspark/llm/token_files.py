"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents in blocks of ``BLOCK`` ids. A block keeps its
minimum; what is above it is packed at the width that ``PERCENT`` of its ids need, and wider ones
go to a list of exceptions (place and whole difference). The starts of all blocks are indexed, so
any run of ids can be read without the rest of its file. Little-endian layout:

    8 bytes   magic
    blocks    one after another: packed words of 64 bits, exception places (2 bytes each),
              exception values (4 bytes each)
    index     for every block: start 8, minimum 4, exceptions 2, width 1 byte (as four arrays)
    documents doc_id 8 bytes, known 1 byte, ids 8 bytes (as three arrays)
    40 bytes  ids, blocks, documents, start of the index, start of the documents
"""

from __future__ import annotations

import posixpath

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dqspark.llm.common import longs, small_batches
from dqspark.llm.tokens import END, VOCABULARY, encoder
from dqspark.session import materialize

MAGIC = b"PFORIDS1"
BLOCK = 256
PERCENT = 90
FILE_IDS = 4_000_000
PART_BYTES = 32 << 20


def _widths(above: np.ndarray) -> np.ndarray:
    """Bits that PERCENT of the ids of each row need."""
    at = min(above.shape[1] - 1, above.shape[1] * PERCENT // 100)
    most = np.partition(above, at, axis=1)[:, at]
    return np.ceil(np.log2(most.astype(np.float64) + 1)).astype(np.int64)


def pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 k numbers below 2**width as rows of k * width 64-bit words."""
    v = rows.reshape(-1, 64).astype(np.uint64)
    out = np.zeros((len(v), width), np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        out[:, word] |= v[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[:, i] >> np.uint64(64 - shift)
    return out.reshape(len(rows), -1)


def unpack(words: np.ndarray, width: int, size: int = BLOCK) -> np.ndarray:
    out = np.zeros((len(words) * size // 64, 64), np.uint64)
    w = words.reshape(-1, width) if width else words
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        out[:, i] = w[:, word] >> np.uint64(shift)
        if shift + width > 64:
            out[:, i] |= w[:, word + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << width) - 1)).reshape(-1, size)


def to_bytes(ids: np.ndarray, doc_ids: list, counts: list[int]) -> bytes:
    """A whole file."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint32)
    padded[:n] = ids
    rows = padded.reshape(blocks, BLOCK)
    least = rows.min(1, initial=np.uint32(0xFFFFFFFF)) if blocks else np.empty(0, np.uint32)
    above = rows - least[:, None]
    widths = _widths(above) if blocks else np.empty(0, np.int64)
    over = above >> widths[:, None].astype(np.uint64) > 0
    extra = over.sum(1)
    sizes = widths * (BLOCK // 8) + extra * 6
    starts = len(MAGIC) + np.cumsum(sizes) - sizes
    low = np.where(over, 0, above)
    body: list = [b""] * blocks
    for width in np.unique(widths):
        at = np.nonzero(widths == width)[0]
        for i, words in zip(at, pack(low[at], int(width))):
            body[i] = words.tobytes()
    for i in np.nonzero(extra)[0]:
        place = np.nonzero(over[i])[0]
        body[i] += place.astype(np.uint16).tobytes() + above[i, place].astype(np.uint32).tobytes()
    index = [starts.astype(np.int64), least, extra.astype(np.uint16), widths.astype(np.uint8)]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = [np.array([d or 0 for d in doc_ids], np.int64), known, np.array(counts, np.int64)]
    index_at = len(MAGIC) + int(sizes.sum())
    docs_at = index_at + sum(a.nbytes for a in index)
    tail = np.array([n, blocks, len(doc_ids), index_at, docs_at], np.int64)
    return MAGIC + b"".join(body) + b"".join(a.tobytes() for a in [*index, *docs, tail])


def _take(data: bytes, at: int, kinds: list, n: int) -> list[np.ndarray]:
    out = []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


class TokenFile:
    """A file's bytes, opened: documents, and the ids of any range."""

    def __init__(self, data: bytes):
        if data[:len(MAGIC)] != MAGIC:
            raise ValueError("not a token-id file")
        self.data = data
        self.n, self.blocks, docs, index_at, docs_at = np.frombuffer(data[-40:], np.int64).tolist()
        self.starts, self.least, self.extra, self.widths = _take(
            data, index_at, [np.int64, np.uint32, np.uint16, np.uint8], self.blocks)
        ids, known, self.counts = _take(data, docs_at, [np.int64, np.uint8, np.int64], docs)
        self.doc_ids = [i if k else None for i, k in zip(ids.tolist(), known.tolist())]

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids lo to hi, from the blocks that hold them alone."""
        hi = self.n if hi is None else min(hi, self.n)
        first, last = lo // BLOCK, -(-hi // BLOCK)
        if hi <= lo:
            return np.empty(0, np.uint32)
        rows = np.zeros((last - first, BLOCK), np.uint32)
        widths = self.widths[first:last]
        for width in np.unique(widths):
            at = np.nonzero(widths == width)[0]
            size = int(width) * BLOCK // 64
            words = np.stack([np.frombuffer(self.data, np.uint64, size, s)
                              for s in self.starts[first + at].tolist()])
            rows[at] = unpack(words, int(width))
        for i in np.nonzero(self.extra[first:last])[0]:
            n = int(self.extra[first + i])
            at = int(self.starts[first + i]) + int(widths[i]) * BLOCK // 8
            rows[i, np.frombuffer(self.data, np.uint16, n, at)] = np.frombuffer(
                self.data, np.uint32, n, at + 2 * n)
        rows += self.least[first:last, None]
        return rows.ravel()[lo - first * BLOCK:hi - first * BLOCK]


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END,
          file_ids: int = FILE_IDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write all texts of ``docs(doc_id, text)`` as token-id files under the shared folder ``path``.

    Documents stand in ascending doc_id order, rows without doc_id first; rows that repeat a
    doc_id in an order of their texts. A null or empty text is its end id alone. Parts are ranges
    of that order, so repeated doc_ids spread over parts. A file is written beside its place and
    renamed, so a task that runs again replaces it whole. Returns the stored list of files:
    ``(part, file, path, n_ids, n_docs)``; an empty table has none.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = slim.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    order = ["doc_id", F.xxhash64("text"), "_tie"]
    ranged = slim.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(
        max(1, -(-total // part_bytes)), *order).sortWithinPartitions(*order)

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, doc_ids, size = [], [], 0

        def close():
            nonlocal ids, doc_ids, size, number
            name = posixpath.join(path, f"part-{part:06d}-{number:06d}.pfor")
            counts = list(map(len, ids))
            put(name, to_bytes(np.concatenate(ids), doc_ids, counts))
            row = {"part": longs([part]), "file": longs([number]), "path": [name],
                   "n_ids": longs([size]), "n_docs": longs([len(ids)])}
            ids, doc_ids, size, number = [], [], 0, number + 1
            return pa.RecordBatch.from_pydict(row)

        encode = encoder(vocabulary)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(encode.ids(text.as_py() or "", end))
                doc_ids.append(doc_id)
                size += len(ids[-1])
                if size >= file_ids:
                    yield close()
        if ids:
            yield close()

    files = ranged.select("doc_id", "text").mapInArrow(
        run, "part long, file long, path string, n_ids long, n_docs long")
    return materialize(files, "files")


def put(path: str, data: bytes) -> None:
    """Write a file of the shared folder in one step."""
    store, name = fs.FileSystem.from_uri(path)
    task = TaskContext.get()
    draft = f"{name}.{task.taskAttemptId() if task else 0}"
    store.create_dir(posixpath.dirname(name), recursive=True)
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, name)


def get(path: str) -> bytes:
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name) as f:
        return f.read()


def read(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the files of a stored list.

    ``start`` counts the ids of all documents before it; ``ids`` are bytes, four for each id.
    """
    small_batches(files.sparkSession)
    base = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(base), F.lit(0)))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(get(row["path"]))
                if file.n != row["n_ids"] or len(file.doc_ids) != row["n_docs"]:
                    raise RuntimeError(f"{row['path']} is not the file that was written")
                ends = np.cumsum(file.counts)
                starts, lo = ends - file.counts, 0
                while lo < len(ends):
                    hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + (1 << 19), "right")))
                    ids = file.ids(int(starts[lo]), int(ends[hi - 1]))
                    cuts = 4 * np.append(starts[lo:hi], ends[hi - 1]) - 4 * starts[lo]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": longs(file.doc_ids[lo:hi]),
                        "start": longs(row["base"] + starts[lo:hi]),
                        "n_tokens": longs(file.counts[lo:hi]),
                        "ids": pa.Array.from_buffers(pa.binary(), hi - lo, [
                            None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(ids)])})
                    lo = hi

    return placed.repartition(n, "path").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")


def folder(spark: SparkSession, name: str = "tokens") -> str:
    """A new place in the shared folder."""
    import uuid

    from dqspark.session import shared_dir
    return f"{shared_dir(spark)}/dqspark/{name}-{uuid.uuid4().hex}"
