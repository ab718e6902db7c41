"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its subwords: byte n-grams of its lower-cased words, a
word's edge counting as a byte, hashed into a fixed number of buckets. Embeddings and softmax are
trained together by stochastic gradient descent on a bounded sample of labelled rows. As the
model is linear in the mean, prediction needs one table of bucket logits. A temperature fitted
on a held part of the sample calibrates the scores. The same part sets each label's threshold of
rejection: a low quantile of the scores of what is predicted rightly, less a margin, so that a single
hard row does not move it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from dqspark.llm.common import keep_rows, map_batches, texts
from dqspark.session import materialize

BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
DIMENSION = 16
EPOCHS = 12
RATE = 4.0
#: Bounds of the training sample: about so many rows of each label, and fewer where all labels together
#: would have more than ``ROWS`` (one of each at least). Every label is learned.
SAMPLE = 500
ROWS = 10_000
#: A text is rejected if its score lies below that of this share of the rightly predicted calibration rows
#: of its label, by at least ``MARGIN`` in log-odds.
REJECTED = 0.01
MARGIN = 3.0
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that are no letters count as word edges.
_EDGES = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))
_CHUNK = 1 << 20


def subwords(text: str) -> np.ndarray:
    """How often the text's subwords fall into each bucket."""
    data = np.frombuffer(b" " + text.lower().encode().translate(_EDGES) + b" ", np.uint8)
    counts = np.zeros(BUCKETS + 1, np.int64)
    for lo in range(0, len(data), _CHUNK):
        b = data[lo:lo + _CHUNK + max(ORDERS) - 1].astype(np.uint32)
        edge = b == 32
        for n in ORDERS:
            m = min(len(b) - n + 1, _CHUNK)
            if m < 1:
                continue
            h = np.full(m, n, np.uint32)
            bad = edge[:m] & edge[n - 1:n - 1 + m]
            for i in range(n):
                h = (h ^ b[i:i + m]) * np.uint32(0x01000193)
                if 0 < i < n - 1:
                    bad = bad | edge[i:i + m]
            h ^= h >> np.uint32(15)
            at = np.where(bad, BUCKETS, h & np.uint32(BUCKETS - 1))
            counts += np.bincount(at, minlength=BUCKETS + 1)
    return counts[:BUCKETS]


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    logits: np.ndarray           # of every bucket
    bias: np.ndarray
    temperature: float
    thresholds: np.ndarray       # of every label

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Calibrated probability of every label."""
        z = (counts.astype(np.float32) @ self.logits / max(1, counts.sum()) + self.bias)
        z = np.exp((z - z.max()) / self.temperature)
        return z / z.sum()


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], labels: tuple[str, ...],
          seed: int = 7) -> Model:
    """Fit on (label, buckets, counts) rows in their given order; every fifth one calibrates."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (BUCKETS, DIMENSION)).astype(np.float32) / DIMENSION
    out, bias = np.zeros((DIMENSION, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    held = [r for i, r in enumerate(rows) if i % 5 == 4] or rows
    fit = [r for i, r in enumerate(rows) if i % 5 != 4]
    steps, done = EPOCHS * max(1, len(fit)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            label, at, counts = fit[i]
            rate = RATE * (1 - done / steps)
            done += 1
            share = (counts / max(1, counts.sum())).astype(np.float32)
            mean = share @ emb[at]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            emb[at] -= rate * share[:, None] * (out @ p)[None, :]
            out -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
    table = emb @ out
    z = np.array([(c / max(1, c.sum())) @ table[a] + bias for _, a, c in held]).reshape(-1, len(labels))
    y = np.array([r[0] for r in held], int)

    def loss(t: float) -> float:
        s = z / t
        s -= s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    # separable samples would drive it to zero
    temperature = min(np.geomspace(1, 50, 60), key=loss) if len(y) else 1.0
    model = Model(labels, table, bias, float(temperature), np.zeros(len(labels)))
    right: list[list[float]] = [[] for _ in labels]
    for label, at, counts in held:
        whole = np.zeros(BUCKETS, np.int64)
        whole[at] = counts
        p = model.scores(whole)
        if p.argmax() == label:
            right[label].append(float(p.max()))
    return replace(model, thresholds=thresholds(right))


def thresholds(right: list[list[float]]) -> np.ndarray:
    """The score below which each label rejects, from the scores of its rightly predicted rows; a
    label without any goes by those of all labels."""
    every = [x for some in right for x in some]
    if not every:
        return np.zeros(len(right))
    low = np.array([np.quantile(some or every, REJECTED) for some in right])
    low = np.clip(low, 1e-6, 1 - 1e-6)
    odds = low / (1 - low) * np.exp(-MARGIN)
    return odds / (1 + odds)


def learn(docs: DataFrame, labelled: Column, sample: int = SAMPLE, rows: int = ROWS) -> Model | None:
    """A model of column ``lang`` from the rows of ``docs(doc_id, text, lang)`` under ``labelled``.

    Rows are chosen by a hash of id and text, about ``sample`` of each label, within ``rows`` of all;
    null labels teach nothing. None if there is no labelled row.
    """
    usable = docs.filter(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull())
    slim = usable.select(F.xxhash64("doc_id", "text").alias("_key"), "lang", "text")
    sizes = materialize(slim.groupBy("lang").agg(F.count("*").alias("n"), F.min("_key").alias("_least")), "labels")
    labels = tuple(sorted(r.lang for r in sizes.select("lang").collect()))
    if not labels:
        return None
    sample = min(sample, max(1, rows // len(labels)))
    # the least of many hashes stands for a label whose share would choose none
    share = F.least(F.lit(1.0), sample / F.col("n")) * (1 << 30)
    chosen = slim.join(sizes, "lang").filter(
        (F.pmod("_key", F.lit(1 << 30)) < share) | (F.col("_key") == F.col("_least")))

    def make():
        place = {x: i for i, x in enumerate(labels)}

        def work(batch):
            found = [subwords(t) for t in texts(batch)]
            at = [np.nonzero(c)[0] for c in found]
            return {"key": batch.column("_key"),
                    "label": pa.array([place[x] for x in batch.column("lang").to_pylist()], pa.int32()),
                    "at": pa.array([a.astype("<u4").tobytes() for a in at], pa.binary()),
                    "counts": pa.array([c[a].astype("<u4").tobytes() for c, a in zip(found, at)],
                                       pa.binary())}
        return work

    found = map_batches(chosen.select("_key", "lang", "text"), make,
                        "key long, label int, at binary, counts binary")
    found = found.orderBy("key", "label", "at").limit(2 * sample * len(labels)).collect()
    return train([(r.label, np.frombuffer(r.at, "<u4").astype(np.int64),
                   np.frombuffer(r.counts, "<u4").astype(np.int64)) for r in found], labels)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the id as text is a multiple of 5 (a null
    id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def _classify(batch: pa.RecordBatch, model: Model | None) -> list[tuple[str, float, bool]]:
    """Label, score and verdict for the texts of a batch."""
    out = []
    for text in texts(batch):
        if not _LETTER.search(text):
            out.append((UNKNOWN, 0.0, True))
        elif model is None:
            out.append((UNKNOWN, 0.0, False))
        else:
            p = model.scores(subwords(text))
            best = int(p.argmax())
            out.append((model.labels[best], float(p[best]), bool(p[best] < model.thresholds[best])))
    return out


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` of every row of ``docs(doc_id, text)``.

    Texts that are null or have no letter are ``und`` with score 0, and rejected. Without a model
    all are ``und``, and only those without a letter are rejected. Prediction reads the text alone.
    """
    def make():
        def work(batch):
            label, score, rejected = zip(*_classify(batch, model))
            return {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(label, pa.string()),
                    "score": pa.array(score, pa.float64()), "rejected": pa.array(rejected, pa.bool_())}
        return work
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return map_batches(slim, make, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns."""
    return keep_rows(docs, lambda: lambda batch, _: [not r for *_, r in _classify(batch, model)])
