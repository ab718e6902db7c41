"""Helpers shared by the corpus operators: batch sizes, words, cached encoders, row writers."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, as texts may be very long, and let workers that run on
    the driver's machine find this package from any folder."""
    paths = spark.sparkContext.environment
    if ROOT not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, paths.get("PYTHONPATH")]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """``mapInArrow`` of a function that ``make`` builds once per task.

    The function gets a record batch and returns a mapping of column lists or arrays, or None.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The texts of a batch one by one, null as empty."""
    for x in batch.column(name):
        yield x.as_py() or ""


def longs(values) -> pa.Array:
    return pa.array(values, pa.int64())


class CachedEncoder:
    """Token ids of words, each distinct word encoded once per worker while it stays cached.

    ``encode`` turns a list of words into all their ids and the number of each word's. The cache
    holds about ``most`` words; beyond that it starts anew between two texts, which changes no
    result.
    """

    def __init__(self, encode: Callable[[list], tuple], most: int = 600_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}
        self.used = 0
        self.flat = np.empty(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)

    def add(self, words: list) -> None:
        """Encode the words that are not cached yet."""
        ids, lens = self.encode(words)
        n, total = len(self.index), len(ids)
        while len(self.start) < n + len(words) + 1:
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used:self.used + total] = ids
        self.start[n + 1:n + 1 + len(words)] = self.used + np.cumsum(lens)
        self.used += total
        self.index.update(zip(words, range(n, n + len(words))))

    def room(self) -> None:
        """To be called between texts."""
        if len(self.index) > self.most:
            self.clear()

    def places(self, words: list) -> np.ndarray:
        """Index of every word in the cache, which must not be cleared before its use."""
        if new := list(set(words).difference(self.index)):
            self.add(new)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words at ``at``, one after another, and how many each word has."""
        first, lens = self.start[at], self.start[at + 1] - self.start[at]
        return gather(self.flat, first, lens), lens


def gather(flat: np.ndarray, first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[f:f+n]`` for each (f, n)."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(first - (ends - lens), lens)]


def keep_rows(df: DataFrame, make: Callable[[], Callable]) -> DataFrame:
    """The rows for which the function that ``make`` builds says true; it gets a batch of the texts
    alone, and the batch of whole rows."""
    small_batches(df.sparkSession)
    at = df.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            if batch.num_rows:
                text = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
                yield batch.filter(pa.array(keep(text, batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)
