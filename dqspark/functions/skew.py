"""Keyed lookups that stay balanced when one key holds a large part of the rows.

Lookups are plain equi joins: Spark broadcasts a side that it measures as small, and otherwise
splits the partitions of hot keys at run time (``session.SETTINGS`` asks for that wherever a join
can be split). Nothing here depends on the number of rows, and no side is ever broadcast by hint.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Ways in which the larger side of a product is spread.
SPREAD = 64


def any_null(cols: Sequence[str]) -> Column:
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.col(c).isNull()
    return cond


def key_counts(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows per key (NULL keys left out), combined on the map side."""
    return df.filter(~any_null(on)).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))


def lookup_join(rows: DataFrame, other: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join of a possibly skewed row side with a lookup side.

    The columns of ``rows`` come first and keep their order. For semi and anti joins the lookup is
    first reduced to distinct keys.
    """
    on = list(on)
    if how in ("left_semi", "left_anti"):
        return rows.join(other.select(*on).distinct(), on, how).select(*rows.columns)
    return rows.join(other, on, how).select(
        *rows.columns, *[c for c in other.columns if c not in on])


def _matching(df: DataFrame, keys: DataFrame, cols: Sequence[str], how: str) -> DataFrame:
    names = [f"_k{i}" for i in range(len(cols))]
    met = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in zip(cols, names)))
    return df.join(keys.toDF(*names), met, how)


def within(df: DataFrame, keys: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows whose ``cols`` are among the keys, by place; NULL equals NULL."""
    return _matching(df, keys, cols, "left_semi")


def without(df: DataFrame, keys: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows whose ``cols`` are not among the keys, by place; NULL equals NULL."""
    return _matching(df, keys, cols, "left_anti")


def mark(rows: DataFrame, keys: DataFrame, on: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Attach boolean ``flags`` of ``keys`` to the rows carrying each key (false elsewhere).

    ``keys`` holds distinct key tuples and the flags. NULL never matches.
    """
    found = keys.select(*on, *[F.col(f).alias(f"_{f}") for f in flags])
    return rows.join(found, list(on), "left").select(
        *rows.columns, *[F.coalesce(f"_{f}", F.lit(False)).alias(f) for f in flags])


def product(big: DataFrame, few: DataFrame) -> DataFrame:
    """Every row of ``big`` with every row of ``few``, where the result is meant to hold each pair.

    The list is repeated once per salt, and the pairs are formed in as many tasks.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(SPREAD)))
    repeated = few.withColumn("_salt", F.explode(F.sequence(
        F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    return salted.join(repeated, "_salt").drop("_salt")
