"""Byte-level BPE by ranks: every distinct pre-token of the corpus is encoded once.

1. Texts are split into pre-tokens, block by block (some MB of text each). A block keeps each of
   its distinct pre-tokens once and, for every document, their positions as a sequence of numbers.
2. The distinct pre-tokens go to partitions of the word space; there, all blocks together, each
   word is encoded once.
3. The ids go back to their blocks and are put in place by position.
4. Decoding looks every id up in the token-byte table, which is as large as the vocabulary.

What moves is one packed row per block and word partition, and the packed positions; texts never
move. A word in all documents is one entry per block, so no word makes a large group.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from dqspark.llm.common import gather, small_batches

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BLOCK_BYTES = 8 << 20
#: Fixed: the code points with the Unicode property White_Space, which the pattern means by \s.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PACK, _UNPACK = zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def token_bytes(path: str) -> dict[int, bytes]:
    """The token-byte table."""
    return {b: a for a, b in ranks(path).items()}


@cache
def _token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All token bytes one after another, and each id's start and length (-1: no such id)."""
    table = token_bytes(path)
    start, size, at = np.zeros(max(table) + 1, np.int64), np.full(max(table) + 1, -1), 0
    for i, data in sorted(table.items()):
        start[i], size[i], at = at, len(data), at + len(data)
    return np.frombuffer(b"".join(table[i] for i in sorted(table)), np.uint8), start, size


@cache
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def compiled(pattern: str) -> regex.Pattern:
    """The pattern with its white-space classes written out."""
    pattern = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]")
    return regex.compile(pattern.replace(r"\s", f"[{SPACE}]"))


def unsure(run: str) -> bool:
    """Whether the space before a run has white space at its side, or the run ends in some: then
    a pre-token may reach over a space. Elsewhere a space starts a pre-token."""
    return not run or run[0].isspace() or run[-1].isspace()


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte planes apart, compressed."""
    planes = np.ascontiguousarray(values, np.uint32).view(np.uint8).reshape(-1, 4).T
    return _PACK.compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_UNPACK.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def pack_words(words: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, words), np.uint32, len(words))
    return np.uint32(len(words)).tobytes() + _PACK.compress(lens.tobytes() + b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    n, body = int(np.frombuffer(data[:4], np.uint32)[0]), _UNPACK.decompress(data[4:])
    ends = np.cumsum(np.frombuffer(body[:4 * n], np.uint32), dtype=np.int64) + 4 * n
    return [body[a:b] for a, b in zip([4 * n, *ends.tolist()], ends.tolist())]


class Block:
    """Distinct pre-tokens of some texts and, if asked for, their positions.

    Texts are cut at spaces, and a run between spaces is split once; ``unsure`` runs make their
    text be split whole. Words are numbered by first use, alike with and without positions.
    """

    def __init__(self, pattern: regex.Pattern, positions: bool):
        self.split, self.size, self.texts = pattern.findall, 0, [] if positions else None
        self.words: dict[str, int] = {}
        self.runs: dict[str, int] = {}
        self.unsure: set[str] = set()
        self.run_words: list[int] = []
        self.run_ends = [0]

    def _places(self, text: str) -> list[int]:
        return [self.words.setdefault(w, len(self.words)) for w in self.split(text)]

    def add(self, text: str) -> None:
        self.size += len(text) + 16
        head, *rest = text.split(" ")
        fresh = [r for r in dict.fromkeys(rest) if r not in self.runs]
        for run in fresh:
            if unsure(run):
                self.unsure.add(run)
            self.run_words += self._places(" " + run)
            self.run_ends.append(len(self.run_words))
            self.runs[run] = len(self.runs)
        if rest and head[-1:].isspace() or self.unsure and not self.unsure.isdisjoint(rest):
            whole, at = self._places(text), None
        else:
            whole, at = self._places(head), rest
        if self.texts is not None:
            at = np.fromiter(map(self.runs.__getitem__, at or ()), np.int64)
            self.texts.append((np.array(whole, np.int64), at))

    def positions(self) -> list[np.ndarray]:
        flat, ends = np.array(self.run_words, np.int64), np.array(self.run_ends, np.int64)
        return [np.concatenate([first, gather(flat, ends[at], ends[at + 1] - ends[at])])
                for first, at in self.texts]


ROWS = "block long, part int, ids array<long>, counts binary, data binary"
_ARROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())),
                    ("counts", pa.binary()), ("data", pa.binary())])


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: [values.get(k)] for k in _ARROW.names}, _ARROW)


def _blocks(docs: DataFrame, pattern: str, parts: int, words: bool) -> DataFrame:
    """Rows of all blocks: packed words per word partition, or else packed positions.

    Words are numbered by partition, then by first use, so that a partition's words are one run.
    Blocks are numbered by split and place in it; both kinds come from the same scan.
    """
    def close(number: int, block: Block, ids: list):
        names = [w.encode() for w in block.words]
        place = np.fromiter((xxhash.xxh32_intdigest(w) % parts for w in names), np.int64, len(names))
        order = np.argsort(place, kind="stable")
        if words:
            cuts = np.searchsorted(place[order], np.arange(parts + 1))
            for p in np.nonzero(np.diff(cuts))[0]:
                some = [names[i] for i in order[cuts[p]:cuts[p + 1]]]
                yield _row(block=number, part=int(p), data=pack_words(some))
            return
        at = np.empty(len(order), np.uint32)
        at[order] = np.arange(len(order), dtype=np.uint32)
        each = block.positions()
        head = [len(order), *map(len, each)]
        yield _row(block=number, part=parts, ids=ids, counts=pack(np.array(head, np.uint32)),
                   data=pack(at[np.concatenate(each)]))

    def run(batches):
        first, n = 0, 0
        find = compiled(pattern)
        block, ids = Block(find, not words), []
        for batch in batches:
            if batch.num_rows:
                first = batch.column(2)[0].as_py() << 32
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(text.as_py() or "")
                ids.append(doc_id)
                if block.size >= BLOCK_BYTES:
                    yield from close(first + n, block, ids)
                    block, ids, n = Block(find, not words), [], n + 1
        if ids:
            yield from close(first + n, block, ids)

    # the number of the split in its scan, which is the same wherever the scan stands in a plan
    return docs.withColumn("_split", F.spark_partition_id()).mapInArrow(run, ROWS)


def _encode_words(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """Ids of every word of every row; each word is encoded when its partition first shows it."""
    def run(batches):
        encode, known, part = encoding(path, pattern).encode_ordinary, {}, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, known = row["part"], {}
                words = unpack_words(row["data"])
                for w in words:
                    if w not in known:
                        known[w] = encode(w.decode())
                ids = [known[w] for w in words]
                yield _row(block=row["block"], part=part,
                           counts=pack(np.fromiter(map(len, ids), np.uint32, len(ids))),
                           data=pack(np.array([i for some in ids for i in some], np.uint32)))
    return rows.mapInArrow(run, ROWS)


def _reassemble(rows: DataFrame) -> DataFrame:
    """Token ids of every document; the positions of a block follow the ids of its words."""
    def run(batches):
        block, counts, data = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    block, counts, data = row["block"], [], []
                if row["ids"] is None:
                    counts.append(unpack(row["counts"]))
                    data.append(unpack(row["data"]))
                    continue
                lens = np.concatenate([np.empty(0, np.uint32), *counts]).astype(np.int64)
                flat = np.concatenate([np.empty(0, np.uint32), *data]).astype(np.int32)
                head = unpack(row["counts"])
                if head[0] != len(lens):
                    raise RuntimeError(f"block {block}: {len(lens)} of {head[0]} words came back")
                first, at, lo = np.cumsum(lens) - lens, unpack(row["data"]), 0
                ids, out, size = [], [], 0
                for doc_id, n in zip(row["ids"], head[1:].tolist()):
                    own = at[lo:lo + n]
                    lo += n
                    ids.append(doc_id)
                    out.append(gather(flat, first[own], lens[own]))
                    size += len(out[-1])
                    if size > 1 << 19:
                        yield _lists(ids, out)
                        ids, out, size = [], [], 0
                if ids:
                    yield _lists(ids, out)

    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def _lists(ids: list, out: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids, pa.int64()),
        "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out), pa.int32()))})


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN,
           text: str = "text") -> DataFrame:
    """``(doc_id, ids)`` for every row of ``docs``, as the rank file and the pattern encode it.

    Null and empty texts have no ids; repeated rows and null doc_ids stay as they are; an empty
    table gives an empty result. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 3 * n
    words = _blocks(slim, pattern, parts, True).repartition(n, "part").sortWithinPartitions("part")
    coded = _encode_words(words, path, pattern)
    rows = coded.unionByName(_blocks(slim, pattern, parts, False))
    return _reassemble(rows.repartition(n, "block").sortWithinPartitions("block", "part"))


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``encoded`` with the bytes of its ids in column ``decoded``; an unknown id raises."""
    small_batches(encoded.sparkSession)

    def run(batches):
        flat, start, size = _token_table(path)
        for batch in batches:
            lists = batch.column("ids")
            ids, cuts = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            if len(ids) and (ids.min() < 0 or ids.max() >= len(size) or size[ids].min() < 0):
                raise ValueError("an id that is not in the vocabulary")
            lens = size[ids]
            stops = np.concatenate([[0], np.cumsum(lens)])[cuts].astype(np.int32)
            data = gather(flat, start[ids], lens)
            texts = pa.Array.from_buffers(pa.binary(), len(lists), [
                None, pa.py_buffer(stops), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{kinds}, decoded binary")
