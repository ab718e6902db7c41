"""Mixing sources to target weights with fixed-length blocks and index permutations.

The words of each source, its documents in order of doc_id, are packed into blocks of ``BLOCK`` words.
A source's target in words becomes a number of slots. One multinomial draw deals the slots of a
source over the output shards, so the counts of the sources in a shard are random, while the slots
of a source over all shards are exactly its number. Slot k reads block ``perm(k mod N)`` of its
source's N blocks, where perm is a pseudorandom permutation of 0..N-1 of the epoch ``k div N``; so every
block is read once before any is read again, and none more often than its source. Blocks and slots
meet by their index. All draws are hashes of seed, source, epoch and slot: reruns agree.

Only DataFrame functions are used. The permutation is a swap-or-not network: each round reflects the
index at a keyed point, if a keyed bit of the pair of reflected indices says so. A round is its own
inverse on any N, so no index is walked or lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from dqspark.functions.scalars import cumulate
from dqspark.session import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
SEED = 42
BLOCK = 64
#: Mean number of slots of an output shard.
SHARD_SLOTS = 4096
WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
ROUNDS = 24
#: Slots that one task takes from one source at a time.
_CHUNK = 1 << 14


def permuted(index: Column, size: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """``index`` (0 to size - 1) under a pseudorandom permutation that ``key`` selects."""
    def one(x: Column, r: Column) -> Column:
        point = F.pmod(F.xxhash64(*key, r), size)
        other = F.pmod(point - x, size)
        # the larger of both names the pair, so both sides of a pair decide alike
        swap = F.xxhash64(*key, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), one)


def sizes(docs: DataFrame) -> DataFrame:
    """Stored ``(doc_id, source, size)`` of every row: size counts the words of the text."""
    count = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD))
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                   F.col("source").cast("string").alias("source"),
                                   count.cast("long").alias("size")), "sizes")


def targets(sized: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """Stored ``(source, number, source_size, weight, target)``, a row for every source.

    Sources are numbered by code point, null last, and weigh ``weights`` in turn. All targets sum to
    all sizes. A target stops at ``most`` times its source's size and the rest is shared again by
    weight: in order of cap / weight, what is left after the caps before a source, by the weight
    that is left, rises while sources are capped and falls after, so its maximum is the level at
    which the others share.
    """
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    own = own.withColumn("_none", F.col("source").isNull()).withColumn("_one", F.lit(1).cast("long"))
    own = cumulate(own, [], ["_none", "source"], sums={"number": "_one"}).select(
        "source", (F.col("number") - 1).alias("number"), "source_size")
    turn = F.pmod(F.col("number"), F.lit(len(weights))).cast("int")
    own = own.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), turn + 1))
    own = own.withColumn("_cap", most * F.col("source_size")).withColumn("_at", F.col("_cap") / F.col("weight"))
    # the caps sum to most times all sizes
    level = cumulate(own, [], ["_at", "number"], sums={"_caps": "_cap", "_weights": "weight"}, inclusive=False)
    share = (F.col("_caps_total") / most - F.col("_caps")) / (F.col("_weights_total") - F.col("_weights"))
    top = level.agg(F.max(share)).first()[0] or 0.0
    target = F.least(F.col("_cap").cast("double"), F.lit(float(top)) * F.col("weight"))
    return materialize(own.select("source", "number", "source_size", "weight", target.alias("target")), "targets")


def slots(goals: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """``(number, slot, shard, block)``: every slot of every source, its shard and the block it reads."""
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    whole = F.floor(F.col("target") / F.col("source_size")).cast("long")
    rest = (F.col("target") - whole * F.col("source_size")) / F.col("source_size")
    count = F.least(whole * blocks + F.round(rest * blocks).cast("long"), MOST_TIMES * blocks)
    need = goals.filter("source_size > 0").select("number", blocks.alias("n"), count.alias("slots")).filter("slots > 0")
    total = goals.agg(F.sum("source_size")).first()[0] or 0
    shards = max(1, round(total / block / shard_slots))
    spread = int(goals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = need.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1,
                                                          F.lit(_CHUNK).cast("long"))))
    # few small rows stand for many: a given number of partitions keeps them apart
    parts = parts.repartition(spread, "number", "first")
    each = parts.withColumn("slot", F.explode(F.sequence(
        "first", F.least(F.col("first") + _CHUNK, F.col("slots")) - 1)))
    key = [F.lit(seed), F.col("number")]
    epoch = F.floor(F.col("slot") / F.col("n"))
    shard = F.pmod(F.xxhash64(*key, F.lit("shard"), F.col("slot")), F.lit(shards)).cast("int")
    return each.select("number", "slot", shard.alias("shard"),
                       permuted(F.pmod("slot", F.col("n")), F.col("n"), *key, epoch).alias("block"))


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of ``placed(start, size, ...)`` cut at the borders of blocks: ``(block, skip, words)`` are
    the block, the words of the document before the piece, and its words."""
    end = F.col("start") + F.col("size")
    cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    low = F.greatest("start", F.col("block") * block)
    return cut.withColumn("skip", low - F.col("start")).withColumn(
        "words", F.least(end, (F.col("block") + 1) * block) - low)


@dataclass(frozen=True)
class Mixture:
    goals: DataFrame        # source, number, source_size, weight, target
    placed: DataFrame       # doc_id, source, size, number, source_size, target, start
    slots: DataFrame        # number, slot, shard, block
    block: int


def mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Mixture:
    """Plan the mixture of ``docs(doc_id, text, source)``.

    A null text, or one without words, has size 0 and is never taken; a source without words has
    target 0. A null source is one source, the last. Repeated rows, also of one doc_id, are separate
    documents, which follow one another, as do rows without doc_id at the end of their source. An
    empty table gives empty tables. Other columns are not read.
    """
    sized = sizes(docs)
    goals = targets(sized)
    met = F.col("d.source").eqNullSafe(F.col("g.source"))
    rows = sized.alias("d").join(goals.alias("g"), met).select("d.*", "g.number", "g.source_size", "g.target")
    rows = rows.withColumn("_none", F.col("doc_id").isNull())
    placed = cumulate(rows, ["number"], ["_none", "doc_id", "size"], sums={"start": "size"}, inclusive=False)
    return Mixture(goals, placed.drop("_none", "start_total"), slots(goals, block, shard_slots, seed), block)


def taken(mixture: Mixture) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` of every document: the words that the
    mixture takes of it, repeats counted."""
    times = mixture.slots.groupBy("number", "block").agg(F.count("*").alias("times"))
    # the planner takes what a few exploded rows become for small: it must not broadcast it
    cut = pieces(mixture.placed, mixture.block).join(times.hint("merge"), ["number", "block"], "left")
    own = ["doc_id", "source", "size", "number", "source_size", "target", "start"]
    got = cut.groupBy(*own).agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    none = mixture.placed.filter("size = 0").select(*own, F.lit(0).cast("long").alias("taken"))
    return got.unionByName(none).drop("number", "start")


def shard_texts(mixture: Mixture, docs: DataFrame) -> DataFrame:
    """``(shard, number, slot, start, doc_id, text)``: what the shards hold. The rows of a slot, in order
    of ``start``, are its block; a row's text are the words a document gives to the block, joined by
    a space. ``docs`` are those of the mixture, with distinct ids that are not null.
    """
    words = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD), F.lit(0))
    cut = pieces(mixture.placed, mixture.block)
    text = F.concat_ws(" ", F.slice(words, (F.col("skip") + 1).cast("int"), F.col("words").cast("int")))
    said = cut.join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").select(
        "number", "block", (F.col("start") + F.col("skip")).alias("start"), "doc_id", text.alias("text"))
    return mixture.slots.hint("merge").join(said, ["number", "block"]).select(
        "shard", "number", "slot", "start", "doc_id", "text")
