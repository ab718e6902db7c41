"""Controlled errors: the workload whose damage is measured."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from dqspark.functions.skew import lookup_join

MODES = ("numeric_add", "duplicate_rows", "null_out", "fk_orphan", "delete_rows")


@dataclass(frozen=True)
class Injection:
    """One error: mode, table, target keys (a DataFrame) and what the mode needs."""

    node: str
    mode: str
    targets: DataFrame
    key: tuple[str, ...]
    columns: tuple[str, ...] = ()
    operand: float | str | None = None

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown injection mode {self.mode}")


def _hit(df: DataFrame, spec: Injection) -> DataFrame:
    wanted = spec.targets.select(*spec.key).distinct().withColumn("_hit", F.lit(True))
    return lookup_join(df, wanted, spec.key).withColumn(
        "_hit", F.coalesce("_hit", F.lit(False)))


def _new_value(spec: Injection, c: str, kind: str) -> Column:
    if spec.mode == "numeric_add":
        return (F.col(c) + F.lit(spec.operand).cast(kind)).cast(kind)
    return F.lit(None if spec.mode == "null_out" else spec.operand).cast(kind)


def inject(df: DataFrame, spec: Injection) -> DataFrame:
    """Apply one error in a single pass over the table."""
    marked, hit = _hit(df, spec), F.col("_hit")
    types = dict(df.dtypes)
    if spec.mode == "duplicate_rows":
        copies = F.when(hit, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        return marked.withColumn("_copy", F.explode(copies)).select(*df.columns)
    if spec.mode == "delete_rows":
        return marked.filter(~hit).select(*df.columns)
    for c in spec.columns:
        marked = marked.withColumn(c, F.when(hit, _new_value(spec, c, types[c])).otherwise(F.col(c)))
    return marked.select(*df.columns)


def injection_report(df: DataFrame, spec: Injection) -> DataFrame:
    """One row: targets, hits, rows before and after, and the row delta the mode must show."""
    size = spec.targets.agg(F.count(F.lit(1)).alias("targets")).select(
        "targets", F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("rows_before"),
        F.lit(0).cast("long").alias("rows_after"))
    before = _hit(df, spec).agg(F.count_if("_hit").alias("hits"),
                                F.count(F.lit(1)).alias("rows_before")).select(
        F.lit(0).cast("long").alias("targets"), "hits", "rows_before",
        F.lit(0).cast("long").alias("rows_after"))
    after = inject(df, spec).agg(F.count(F.lit(1)).alias("rows_after")).select(
        F.lit(0).cast("long").alias("targets"), F.lit(0).cast("long").alias("hits"),
        F.lit(0).cast("long").alias("rows_before"), "rows_after")
    row = size.unionByName(before).unionByName(after).agg(
        *[F.sum(c).alias(c) for c in ("targets", "hits", "rows_before", "rows_after")])
    step = {"duplicate_rows": F.col("targets"), "delete_rows": -F.col("targets")}.get(
        spec.mode, F.lit(0).cast("long"))
    return row.select(
        F.lit(spec.node).alias("node"), F.lit(spec.mode).alias("mode"), "targets", "hits",
        "rows_before", "rows_after", step.alias("expected_delta"),
        ((F.col("hits") == F.col("targets"))
         & (F.col("rows_after") - F.col("rows_before") == step)).alias("ok"))


def require_hits(df: DataFrame, spec: Injection) -> None:
    """Every target key must hit exactly one row at the moment of injection."""
    hits = _hit(df, spec).agg(F.count_if("_hit").alias("n"), F.lit(1).alias("_one"))
    wanted = spec.targets.agg(F.count(F.lit(1)).alias("wanted"), F.lit(1).alias("_one"))
    row = hits.join(wanted, "_one").first()
    if row["n"] != row["wanted"]:
        raise ValueError(f"injection hits {row['n']} rows of {spec.node}, expected {row['wanted']}")


def same_keys(specs: Sequence[Injection]) -> bool:
    """Whether all errors find their rows by one key that none of them changes."""
    return all(s.key == specs[0].key and not set(s.columns) & set(s.key) for s in specs)


def marked_targets(df: DataFrame, specs: Sequence[Injection]) -> DataFrame:
    """``df`` with a flag ``_t0``, ``_t1``, ... for the rows that each error of ``same_keys`` hits."""
    for i, spec in enumerate(specs):
        df = _hit(df, spec).withColumnRenamed("_hit", f"_t{i}")
    return df


def replay(marked: DataFrame, specs: Sequence[Injection]) -> DataFrame:
    """The errors in order, as projections and filters over the flags alone."""
    types = dict(marked.dtypes)
    for i, spec in enumerate(specs):
        hit = F.col(f"_t{i}")
        if spec.mode == "duplicate_rows":
            copies = F.when(hit, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
            marked = marked.withColumn("_copy", F.explode(copies)).drop("_copy")
        elif spec.mode == "delete_rows":
            marked = marked.filter(~hit)
        else:
            for c in spec.columns:
                marked = marked.withColumn(c, F.when(hit, _new_value(spec, c, types[c])).otherwise(F.col(c)))
    return marked


def check_hits(marked: DataFrame, specs: Sequence[Injection]) -> None:
    """Every target key of every error must hit exactly one row at its turn: one job for all.

    What an error does to the rows that later ones meet is known per row: it doubles, drops or
    keeps them.
    """
    times, sums = F.lit(1), []
    for i, spec in enumerate(specs):
        hit = F.col(f"_t{i}")
        sums.append(F.sum(F.when(hit, times).otherwise(0)).alias(f"h{i}"))
        step = {"duplicate_rows": 2, "delete_rows": 0}.get(spec.mode, 1)
        times = times * F.when(hit, F.lit(step)).otherwise(1)
    stack = ", ".join(f"{i}, coalesce(h{i}, 0)" for i in range(len(specs)))
    found = marked.agg(*sums).selectExpr(f"stack({len(specs)}, {stack}) as (step, n)").withColumn("wanted", F.lit(False))
    for i, spec in enumerate(specs):
        found = found.unionByName(spec.targets.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(i).alias("step"), "n", F.lit(True).alias("wanted")))
    got = {(r["step"], r["wanted"]): r["n"] for r in found.collect()}
    for i, spec in enumerate(specs):
        if got[i, False] != got[i, True]:
            raise ValueError(f"injection hits {got[i, False]} rows of {spec.node}, expected {got[i, True]}")


def inject_all(df: DataFrame, specs: Sequence[Injection], strict: bool = True) -> DataFrame:
    """Apply several errors in order; with ``strict`` each must hit its targets exactly."""
    if specs and same_keys(specs):
        marked = marked_targets(df, specs)
        if strict:
            check_hits(marked, specs)
        return replay(marked, specs).select(*df.columns)
    for spec in specs:
        if strict:
            require_hits(df, spec)
        df = inject(df, spec)
    return df
