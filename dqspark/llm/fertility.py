"""Quality rules from tokeniser fertility.

Public vocabularies measure how well a text's words split: characters per token, the share of
tokens that fall back to bytes, and the entropy of the tokens as a share of the most they could
have. Every language (every script where the language is unknown) has bands for these, from
quartiles over all its documents, drawn towards its script's where these are few; what lies far outside is rejected, as is what fails the
base rules: too few words, or too many words in repeated three-word windows.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from dqspark.llm.bpe import encoding, token_bytes
from dqspark.llm.common import CachedEncoder, longs, map_batches, small_batches, texts
from dqspark.session import materialize

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LEAST_WORDS = 50
REPEATED_PERCENT = 50
#: Quartile distances that each measure may lie outside the quartiles. Evenness spreads widely, as
#: it falls with a text's length, so it has a smaller reach.
REACH = (7.0, 7.0, 7.0, 2.5)
#: Weight, in rows, of a script's quartiles in those of its languages, and of all rows' in those of a
#: script: a group of few rows lies near the larger one, and the more it has the more it counts.
PRIOR = 20
#: Quartiles are those of measures rounded to this grid, so that they are exact and the same in any order.
GRID = 1000
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("chars_per_piece", "chars_per_rank", "byte_share", "evenness")
_SCRIPTS = {name: regex.compile(rf"\p{{{name}}}") for name in (
    "Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana",
    "Hangul", "Thai")}


_ASCII, _LETTERS = re.compile("[\x00-\x7f]+"), re.compile("[A-Za-z]")


class Words(CachedEncoder):
    """Piece ids of words, with the tokens of the rank vocabulary and the byte tokens of both.

    Words are encoded in one line, as no piece and no pre-token reaches over the space between two
    words; where the starts of words cannot be told in the result, they are encoded one by one.
    """

    def __init__(self, pieces: str, ranks: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        n = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(n)])
        self.begins = np.array([self.model.id_to_piece(i).startswith("\u2581") for i in range(n)])
        self.plain = encoding(ranks, public_tokenizers.PATTERN)
        table = token_bytes(ranks)
        self.part, self.space = (np.zeros(max(table) + 1, bool) for _ in range(2))
        for i, data in table.items():
            self.part[i], self.space[i] = not _whole(data), data[:1] == b" "
        super().__init__(lambda words: _cut(self.model.encode, self.begins, words, ""))

    def clear(self) -> None:
        super().clear()
        self.more = np.zeros((2, 1 << 14), np.int64)      # rank tokens, byte tokens of both

    def add(self, words: list) -> None:
        n = len(self.index)
        other, sizes = _cut(self.plain.encode_ordinary, self.space, words, " ")
        super().add(words)
        while self.more.shape[1] < len(self.index):
            self.more = np.concatenate([self.more, np.zeros_like(self.more)], axis=1)
        self.more[0, n:len(self.index)] = sizes
        self.more[1, n:len(self.index)] = _sums(self.part[other], sizes)
        ids, lens = self.ids(np.arange(n, len(self.index)))
        self.more[1, n:len(self.index)] += _sums(self.is_byte[ids], lens)


def _sums(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs."""
    ends = np.concatenate([[0], np.cumsum(values)])
    stops = np.cumsum(lens)
    return ends[stops] - ends[stops - lens]


def _cut(encode, begins: np.ndarray, words: list[str], before: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words and how many each has, from one encoding of all of them."""
    ids = np.array(encode(before + " ".join(words)), np.int64)
    starts = np.nonzero(begins[ids])[0]
    if len(starts) != len(words) or len(ids) and starts[0]:
        each = [encode(before + w) for w in words]
        return np.array([i for x in each for i in x], np.int64), np.array(list(map(len, each)), np.int64)
    return ids, np.diff(np.append(starts, len(ids)))


class Meter:
    """Measures of texts; words are encoded once while they stay cached."""

    def __init__(self, pieces: str, ranks: str):
        self.words = Words(pieces, ranks)

    def measure(self, text: str) -> dict:
        words = split_words(text)
        n = len(words)
        chars = len(text) - sum(text.count(c) for c in SPACES)
        out = {"n_words": n, "word_chars": chars, "n_symbols": sum(text.count(c) for c in SYMBOLS),
               "n_dup_lines": repeated_lines(text), "n_repeat_words": 0, "chars_per_piece": 0.0,
               "chars_per_rank": 0.0, "byte_share": 0.0, "evenness": 0.0}
        if not n:
            return out
        self.words.room()
        at = self.words.places(words)
        out["n_repeat_words"] = repeated_words(at)
        ids, _ = self.words.ids(at)
        other, partial = self.words.more[:, at].sum(1).tolist()
        out["chars_per_piece"] = chars / max(1, len(ids))
        out["chars_per_rank"] = chars / max(1, other)
        out["byte_share"] = partial / max(1, len(ids) + other)
        if len(ids) > 1:
            counts = np.bincount(ids)
            counts = counts[counts > 0] / len(ids)
            out["evenness"] = float(-(counts * np.log(counts)).sum() / np.log(len(ids)))
        return out


_UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def split_words(text: str) -> list[str]:
    """Words between ASCII white space; str.split() knows more white space than that."""
    if _UNUSUAL.search(text):
        return [w.decode() for w in text.encode().split()]
    return text.split()


def _whole(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def repeated_words(at: np.ndarray, size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur twice or more; ``at`` numbers the words."""
    n = len(at) - size + 1
    if n < 2:
        return 0
    key = at[:n]
    for i in range(1, size):
        if int(key.max()) >= (1 << 62) // (int(at.max()) + 1):
            key = np.unique(key, return_inverse=True)[1]
        key = key * (int(at.max()) + 1) + at[i:i + n]
    if len(set(key.tolist())) == n:
        return 0
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    start = counts[back] > 1
    cover = np.zeros(len(at), bool)
    for i in range(size):
        cover[i:i + n] |= start
    return int(cover.sum())


@cache
def meter(pieces: str, ranks: str) -> Meter:
    return Meter(pieces, ranks)


def script(text: str) -> str:
    """Script of most of the text's letters; ``none`` without letters."""
    other = _ASCII.sub("", text)
    counts = {name: len(p.findall(other)) for name, p in _SCRIPTS.items()} if other else dict.fromkeys(_SCRIPTS, 0)
    counts["Latin"] += len(_LETTERS.findall(text))
    best = max(counts, key=lambda k: (counts[k], k))
    return f"script {best}" if counts[best] else "script none"


def base_failed(n_words, n_repeat_words):
    """Works on numbers and on columns."""
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > REPEATED_PERCENT * n_words)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame, pieces: str = PIECES, ranks: str = RANKS) -> DataFrame:
    """``(doc_id, band, counts..., measures..., script)`` of every row of ``docs(doc_id, text, lang)``; the
    band is the language, or the script where it is not known."""
    def make():
        gauge = meter(pieces, ranks)

        def work(batch):
            rows = [gauge.measure(t) for t in texts(batch)]
            scripts = [script(t) for t in texts(batch)]
            band = [y if x is None else x for x, y in zip(batch.column("lang").to_pylist(), scripts)]
            return {"doc_id": batch.column("doc_id"), "band": pa.array(band, pa.string()),
                    **{c: longs([r[c] for r in rows]) for c in _COUNTS},
                    **{c: pa.array([r[c] for r in rows], pa.float64()) for c in MEASURES},
                    "script": pa.array(scripts, pa.string())}
        return work

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"),
                       F.col("lang").cast("string"))
    schema = ", ".join(["doc_id long", "band string", *[f"{c} long" for c in _COUNTS],
                        *[f"{c} double" for c in MEASURES], "script string"])
    return map_batches(slim, make, schema)


def bands(measured: DataFrame, reach: tuple = REACH) -> DataFrame:
    """``(band, script, low, high)`` for every band and script that a sound row has: arrays with the
    limits of every measure.

    Limits are quartiles, widened by ``reach`` quartile distances (each at least 2 % of the median). The
    quartiles of a script are weighed with those of all rows, and those of a language with its
    script's, by their numbers of rows and ``PRIOR``. Rows that fail the base rules don't count. Quartiles
    come from one count of the rounded values of each group.
    """
    sound = measured.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    cells = F.array(*[F.struct(F.lit(i).alias("m"), F.round(F.col(c) * GRID).alias("v")) for i, c in enumerate(MEASURES)])
    found = sound.select("band", "script", F.explode(cells).alias("c")).groupBy("band", "script", "c.m", "c.v").agg(
        F.count("*").alias("n"))
    found = materialize(found, "values")

    def quartiles(name: str, *group: str) -> DataFrame:
        return found.groupBy(*group, "m").agg(
            F.sum("n").alias(f"{name}_n"), F.expr("percentile(v, array(0.25, 0.5, 0.75), n)").alias(name))

    met = found.select("band", "script", "m").distinct().join(quartiles("own", "band"), ["band", "m"])
    met = met.join(quartiles("wide", "script"), ["script", "m"]).join(quartiles("every"), "m")

    def quartile(i: int) -> Column:
        n, k = F.col("wide_n"), F.col("own_n")
        wide = (F.col("wide")[i] * n + F.col("every")[i] * PRIOR) / (n + PRIOR)
        return (F.col("own")[i] * k + wide * PRIOR) / (k + PRIOR) / GRID

    times = F.array(*[F.lit(float(r)) for r in reach])[F.col("m")]
    met = met.select("band", "script", "m", quartile(0).alias("q1"), quartile(1).alias("q2"), quartile(2).alias("q3"))
    step = times * F.greatest(F.col("q3") - F.col("q1"), 0.02 * F.abs("q2"), F.lit(0.005))
    # few byte fallbacks and an even use of tokens are no fault
    low = F.when(F.col("m") == MEASURES.index("byte_share"), F.lit(-1.0)).otherwise(F.col("q1") - step)
    high = F.when(F.col("m") == MEASURES.index("evenness"), F.lit(1e9)).otherwise(F.col("q3") + step)
    each = met.select("band", "script", F.struct("m", low.alias("low"), high.alias("high")).alias("x"))
    rows = each.groupBy("band", "script").agg(F.array_sort(F.collect_list("x")).alias("x"))    # four a group
    return materialize(rows.select("band", "script", F.col("x.low").alias("low"), F.col("x.high").alias("high")), "limits")


def outside(low: Column, high: Column, values: list[Column]) -> Column:
    """The first measure that lies outside its limits; null if none does."""
    out = F.lit(None).cast("string")
    for i in reversed(range(len(MEASURES))):
        out = F.when(~values[i].between(low[i], high[i]), F.lit(MEASURES[i])).otherwise(out)
    return out


def judge(docs: DataFrame, pieces: str = PIECES, ranks: str = RANKS) -> DataFrame:
    """Counts, measures and verdict of every row of ``docs(doc_id, text, lang)``.

    ``rejected_by`` is the first measure outside its limits of a row that passes the base rules. A null,
    empty or white text has no words and fails. Rows without a language go by their script. Repeated
    rows are judged alike; an empty table stays empty.
    """
    stored = materialize(measures(docs, pieces, ranks), "measures")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    met = stored.join(bands(stored), ["band", "script"], "left")
    why = outside(F.col("low"), F.col("high"), [F.col(c) for c in MEASURES])
    return met.select("doc_id", "band", *_COUNTS, *MEASURES, failed.alias("base_failed"),
                      (~failed & why.isNull()).alias("kept"), F.when(~failed, why).alias("rejected_by"))


def keep_good(docs: DataFrame, pieces: str = PIECES, ranks: str = RANKS) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Rows are stored with their measures, so that every text is measured once.
    """
    small_batches(docs.sparkSession)
    extra = "measured"
    while any(c.lower().startswith(extra) for c in docs.columns):
        extra += "_"
    at_text, at_lang = docs.columns.index("text"), docs.columns.index("lang")
    kinds = StructType().add("band", "string").add("script", "string").add("n_words", "long").add("n_repeat_words", "long")
    for c in MEASURES:
        kinds = kinds.add(c, "double")

    def run(batches):
        gauge = meter(pieces, ranks)
        for batch in batches:
            text = pa.RecordBatch.from_arrays([batch.column(at_text)], ["text"])
            rows = []
            for t, lang in zip(texts(text), batch.column(at_lang).to_pylist()):
                own = script(t)
                rows.append(gauge.measure(t) | {"band": own if lang is None else lang, "script": own})
            fields = [*[pa.array([r[c] for r in rows], pa.string()) for c in ("band", "script")],
                      *[longs([r[c] for r in rows]) for c in ("n_words", "n_repeat_words")],
                      *[pa.array([r[c] for r in rows], pa.float64()) for c in MEASURES]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(fields, kinds.names)],
                                             [*batch.schema.names, extra])

    stored = materialize(docs.mapInArrow(run, StructType([*docs.schema, StructField(extra, kinds)])), "measured")
    limits = bands(stored.select(f"{extra}.*")).select(
        F.struct("band", "script").alias(f"{extra}_k"), F.struct("low", "high").alias(f"{extra}_l"))
    m = {c: F.col(f"{extra}.{c}") for c in kinds.names}
    met = stored.join(limits, (m["band"] == F.col(f"{extra}_k.band")) & (m["script"] == F.col(f"{extra}_k.script")))
    why = outside(F.col(f"{extra}_l.low"), F.col(f"{extra}_l.high"), [m[c] for c in MEASURES])
    good = ~base_failed(m["n_words"], m["n_repeat_words"]) & why.isNull()
    return met.filter(good).select(*[F.col(f"`{c}`") for c in docs.columns])
