"""A generic test suite: failing rows per test, and agreement with the signals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dqspark.functions.skew import lookup_join


def unique(df: DataFrame, col: str) -> DataFrame:
    """Values that occur more than once, with their count."""
    return df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1")


def not_null(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNull())


def relationships(df: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Rows whose reference is not in the parent; NULL references pass."""
    known = parent.select(F.col(parent_col).alias(col))
    return lookup_join(df.filter(F.col(col).isNotNull()), known, [col], "left_anti")


def accepted_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Values outside the accepted list, with their count; NULL passes."""
    return df.filter(~F.col(col).isin(list(values))).groupBy(F.col(col).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))


def expression_is_true(df: DataFrame, expr: str | Column) -> DataFrame:
    """Rows on which the expression is false; NULL passes."""
    return df.filter(~(F.expr(expr) if isinstance(expr, str) else expr))


def run_suite(tests: Mapping[str, DataFrame]) -> DataFrame:
    """Long form: test name and its number of failing rows."""
    out = None
    for name, failing in tests.items():
        row = failing.agg(F.count(F.lit(1)).alias("failing_rows")).select(
            F.lit(name).alias("test"), "failing_rows")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("fails", F.col("failing_rows") > 0)


def agreement(signals: DataFrame, suite: DataFrame) -> DataFrame:
    """Per case whether the signals (case, fired), the suite (case, fails), both or none see it."""
    s = signals.groupBy("case").agg(F.bool_or("fired").alias("fired"))
    t = suite.groupBy("case").agg(F.bool_or("fails").alias("fails"))
    both = s.join(t, "case", "full_outer")
    fired, fails = F.coalesce("fired", F.lit(False)), F.coalesce("fails", F.lit(False))
    return both.select("case", F.when(fired & fails, "both").when(fired, "contract only")
                       .when(fails, "suite only").otherwise("none").alias("seen_by"))
