"""Deterministic choice of the rows that get an error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType

from dqspark.functions.scalars import rank_hash
from dqspark.functions.skew import lookup_join
from dqspark.session import materialize


def pick_targets(df: DataFrame, key: Sequence[str], k: int, salt: str,
                 exclude: DataFrame | None = None) -> DataFrame:
    """The k keys with the smallest salted hash, with their 1-based ``position``.

    Each task keeps k rows, so no full sort happens. Keys in ``exclude`` are not eligible.
    """
    keys = df.select(*key)
    if exclude is not None:
        keys = lookup_join(keys, exclude, key, "left_anti")
    ranked = keys.withColumn("_hash", rank_hash(salt, key)).orderBy("_hash", *key).limit(k)
    order = Window.orderBy("_hash", *key)          # k rows only
    return ranked.withColumn("position", F.row_number().over(order)).drop("_hash")


def pin(targets: DataFrame) -> DataFrame:
    """Write a target set once: it is not ranked again at every use, and its size is known."""
    return materialize(targets, "targets")


def split_targets(targets: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """Two disjoint target sets by rank position."""
    return (targets.filter(F.col("position") <= first),
            targets.filter(F.col("position") > first))


def shared_keys(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: how many distinct keys two target sets share."""
    return a.select(*key).intersect(b.select(*key)).agg(F.count(F.lit(1)).alias("shared"))


def disjoint(a: DataFrame, b: DataFrame, key: Sequence[str]) -> bool:
    """Whether two target sets share no key."""
    return a.select(*key).intersect(b.select(*key)).isEmpty()


def fanout(parent: DataFrame, key: str, child: DataFrame, child_key: str) -> DataFrame:
    """Children per parent key, zero included; the child is counted before it is joined."""
    counts = child.groupBy(F.col(child_key).alias(key)).agg(F.count(F.lit(1)).alias("_c"))
    return parent.groupBy(key).agg(F.count(F.lit(1)).alias("_p")).join(counts, key, "left").select(
        key, (F.col("_p") * F.coalesce("_c", F.lit(0))).alias("n_children"))


def fanout_pools(fan: DataFrame, key: str, size: int = 4) -> DataFrame:
    """The ``size`` keys with fewest and with most children, labelled ``low`` and ``high``."""
    low = fan.orderBy(F.asc("n_children"), F.asc(key)).limit(size)
    high = fan.orderBy(F.desc("n_children"), F.desc(key)).limit(size)
    return low.withColumn("pool", F.lit("low")).unionByName(
        high.withColumn("pool", F.lit("high")))


def take_from_pool(pool: DataFrame, key: str, salts: Sequence[str]) -> DataFrame:
    """One pick per salt, smallest hash first, without replacement. A pool is a few keys.

    All (salt, hash, key) triples are ranked once; salts then take turns over that short list.
    """
    turns = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(s).alias("salt"))
                      for i, s in enumerate(salts)])
    tries = pool.select(key, F.explode(turns).alias("t")).select(
        "t.turn", "t.salt", F.sha2(F.concat_ws("|", "t.salt", F.coalesce(
            F.col(key).cast("string"), F.lit("None"))), 256).alias("hash"), F.col(key).alias("key"))
    kind = tries.select(F.struct("turn", "salt", "hash", "key").alias("x")).schema["x"].dataType
    none = F.array().cast(ArrayType(kind))
    picked = F.aggregate("tries", none, lambda got, x: F.when(F.exists(
        got, lambda g: (g["turn"] == x["turn"]) | (g["key"] == x["key"])), got).otherwise(
        F.array_append(got, x)))
    ranked = tries.agg(F.sort_array(F.collect_list(F.struct("turn", "salt", "hash", "key"))).alias("tries"))
    return ranked.select(F.explode(picked).alias("x")).select(
        "x.salt", F.col("x.key").alias(key))


def argmax_row(df: DataFrame, value: str, key: str) -> DataFrame:
    """The row with the largest value, lowest key on ties."""
    return df.orderBy(F.desc_nulls_last(value), F.asc(key)).limit(1)


def universe_report(universes: Mapping[str, DataFrame], excluded: Mapping[str, DataFrame]) -> DataFrame:
    """Eligible and excluded key counts per table."""
    out = None
    for name, df in universes.items():
        ban = excluded.get(name)
        row = df.agg(F.count(F.lit(1)).alias("universe"), F.lit(0).cast("long").alias("excluded"))
        if ban is not None:
            row = row.unionByName(ban.agg(F.lit(0).cast("long").alias("universe"),
                                          F.count(F.lit(1)).alias("excluded")))
        row = row.agg(F.sum("universe").alias("universe"), F.sum("excluded").alias("excluded")) \
            .select(F.lit(name).alias("name"), "universe", "excluded")
        out = row if out is None else out.unionByName(row)
    return out
