"""Fill-in-middle transformation with units found in 64-bit words.

The UTF-8 bytes of a whole batch are viewed as uint64 words. Byte classes are told by arithmetic on
all eight bytes of a word at once: bit 7 of each byte is the mark. A unit is white space with the
word behind it, or the white space at the end of a text; its last byte is one that is no white
space before one that is, or the last byte of its text. The marks of each word are counted, and
the place of a text's k-th unit is found by a search in the cumulative counts and by clearing marks
inside the word found. Code points are counted by the same ranks over bytes that start one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from dqspark.llm.common import longs, map_batches

SEED = 42
#: Of 100 texts so many are transformed, and of 100 of these so many have their suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = "<[PSM]>"


def _every(byte: int) -> np.uint64:
    """A word of eight equal bytes."""
    return np.uint64(byte * 0x0101010101010101)


_TOP, _LOW = _every(0x80), _every(0x7F)


def _at_least(low: np.ndarray, byte: int) -> np.ndarray:
    """Marks of the bytes from ``byte`` on; ``low`` holds bytes below 128, so nothing carries over."""
    return low + _every(0x80 - byte)


def white(words: np.ndarray) -> np.ndarray:
    """Marks of the bytes that are ASCII white space."""
    low = words & _LOW
    inside = _at_least(low, 9) & ~_at_least(low, 14) | _at_least(low, 32) & ~_at_least(low, 33)
    return inside & ~words & _TOP


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before each byte place."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        some = self.marks[np.minimum(word, len(self.marks) - 1)] & ((np.uint64(1) << (byte << np.uint64(3))) - np.uint64(1))
        return self.before[word] + np.bitwise_count(some)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte place of the k-th mark, from 0."""
        word = np.minimum(np.searchsorted(self.before, k, side="right") - 1, len(self.marks) - 1)
        left = self.marks[word]
        skip = k - self.before[word]
        for i in range(7):
            left = np.where(skip > i, left & (left - np.uint64(1)), left)
        lowest = left & (~left + np.uint64(1))
        return (word << 3) + (np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) >> 3)


class Units:
    """Units and code points of texts that lie one after another in ``data``; text i ends before
    byte ``ends[i]``."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        padded = np.full((len(data) // 8 + 2) * 8, 32, np.uint8)
        padded[:len(data)] = data
        words = padded.view("<u8").astype(np.uint64)
        blank = white(words)
        after = blank >> np.uint64(8)
        after[:-1] |= blank[1:] << np.uint64(56)
        marks = after & ~blank
        last = ends[np.diff(ends, prepend=0) > 0] - 1
        np.bitwise_or.at(marks, last >> 3, np.uint64(0x80) << ((last & 7) << 3).astype(np.uint64))
        self.units = Marks(marks)
        self.points = Marks(~(words & ~(words << np.uint64(1))) & _TOP)
        self.start = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        self.first = self.units.rank(self.start)
        self.n = self.units.rank(ends) - self.first

    def end_of(self, k: np.ndarray) -> np.ndarray:
        """Byte place behind the first k units of every text."""
        place = self.units.select(self.first + np.maximum(k, 1) - 1) + 1
        return np.where(k > 0, place, self.start)

    def chars(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Code points from byte place a to b."""
        return self.points.rank(b) - self.points.rank(a)


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of a document."""
    text = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(text.encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12)]


def transform(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
              seed: int = SEED) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` of every row of ``docs(doc_id, text)``.

    n counts the units. Both cuts fall between units, drawn from the document's hash. ``form`` is
    ``plain`` (the text itself), ``psm`` or ``spm``; a text that holds a sentinel stays plain, as
    do null and empty texts, whose output is empty. The two lengths are null for plain. A null
    doc_id counts as an empty number. Repeated rows are transformed alike, an empty table stays
    empty, and other columns are not read.
    """
    def make():
        sentinels = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
        p, s, m = sentinels

        def work(batch):
            column = batch.column("text").fill_null("").cast(pa.large_binary())
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
            base = int(ends[0])
            held = column.buffers()[2]
            data = np.frombuffer(held, np.uint8)[base:int(ends[-1])] if held else np.empty(0, np.uint8)
            start, ends = ends[:-1] - base, ends[1:] - base
            units = Units(data, ends)
            h = np.array([draws(i, seed) for i in batch.column("doc_id").to_pylist()], np.int64)
            one, two = h[:, 0] % (units.n + 1), h[:, 1] % (units.n + 1)
            cut, stop = units.end_of(np.minimum(one, two)), units.end_of(np.maximum(one, two))
            plain = (ends == start) | (h[:, 2] % 100 >= rate)
            for x in sentinels:
                plain |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
            spm = h[:, 3] % 100 < suffix_first
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            raw, out = memoryview(data), []
            for a, b, c, d, kind in zip(start.tolist(), cut.tolist(), stop.tolist(), ends.tolist(), form.tolist()):
                if kind == "plain":
                    out.append(bytes(raw[a:d]))
                elif kind == "spm":
                    out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
                else:
                    out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
            return {"doc_id": batch.column("doc_id"), "n": longs(units.n), "form": pa.array(form.tolist(), pa.string()),
                    "prefix_chars": pa.array(units.chars(start, cut), pa.int64(), mask=plain),
                    "middle_chars": pa.array(units.chars(cut, stop), pa.int64(), mask=plain),
                    "output": pa.array(out, pa.binary()).cast(pa.string())}
        return work

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return map_batches(slim, make, "doc_id long, n long, form string, prefix_chars long, "
                                   "middle_chars long, output string")


def restore(output: str = "output", form: str = "form") -> Column:
    """The text of an output. No sentinel stands inside a transformed text, and none can arise at
    a cut, as ``<`` only begins one."""
    part = F.split(F.col(output), SENTINELS, -1)
    return (F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2]))
            .when(F.col(form) == "spm", F.concat(part[2], part[3], part[1]))
            .otherwise(F.col(output)))
