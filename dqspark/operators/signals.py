"""Four rule-based signals over one table; none of them reads the injected truth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dqspark.functions.scalars import ratio
from dqspark.functions.skew import key_counts, mark, within
from dqspark.session import materialize

# The shapes, in the order policies are applied.
SHAPES = ("duplicate_shape", "numeric_shape", "null_shape", "fk_shape")


@dataclass(frozen=True)
class Rule:
    """What is checked at a table. ``fk`` is (column, parent table, parent column);
    ``fk_payload`` names a joined column whose NULL shows an unresolved reference."""

    key: tuple[str, ...]
    numeric: str | None = None
    null: str | None = None
    fk: tuple[str, str, str] | None = None
    fk_payload: str | None = None
    parent_null_guard: bool = True


def outside(col: str, band: Sequence | None) -> Column:
    """Closed-band predicate: a value below or above the band; NULL never fires."""
    if band is None:
        return F.lit(False)
    low, high = (b if isinstance(b, Column) else F.lit(b) for b in band)
    c = F.col(col)
    return F.coalesce((c < low) | (c > high), F.lit(False))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key tuples without NULL that occur more than once, with their row count ``_n``."""
    return key_counts(df, key).filter(F.col("_n") > 1)


def orphan_values(df: DataFrame, col: str, parent: DataFrame, parent_col: str,
                  null_guard: bool = True) -> DataFrame:
    """Reference values missing in the parent, with the rows that carry them (``_n``).

    The child is reduced to its distinct values before it meets the parent, so a reference held by
    a third of the rows costs one row. Without the guard a NULL in the parent silences the rule.
    """
    values = key_counts(df, [col])
    known = parent.select(F.col(parent_col).alias(col))
    orphans = values.join(known.filter(F.col(col).isNotNull()).distinct(), col, "left_anti")
    if not null_guard:
        silent = known.filter(F.col(col).isNull()).limit(1).select(F.lit(1).alias("_one"))
        orphans = orphans.withColumn("_one", F.lit(1)).join(
            silent, "_one", "left_anti").drop("_one")
    return orphans


def row_flags(rule: Rule, band: Sequence | None) -> dict[str, Column]:
    """Predicates that need nothing but the row."""
    out = {"numeric_shape": outside(rule.numeric, band) if rule.numeric else F.lit(False),
           "null_shape": F.col(rule.null).isNull() if rule.null else F.lit(False)}
    if rule.fk is None:
        out["fk_shape"] = (F.col(rule.fk_payload).isNull() if rule.fk_payload else F.lit(False))
    return out


def flag_shape(df: DataFrame, rule: Rule, shape: str, band: Sequence | None = None,
               parent: DataFrame | None = None) -> DataFrame:
    """Add one boolean column saying where ``shape`` fires."""
    if shape == "duplicate_shape":
        keys = duplicate_keys(df, rule.key).withColumn(shape, F.lit(True))
        return mark(df, keys, rule.key, [shape])
    if shape == "fk_shape" and rule.fk is not None:
        col, _, parent_col = rule.fk
        keys = orphan_values(df, col, parent, parent_col, rule.parent_null_guard)
        return mark(df, keys.withColumn(shape, F.lit(True)), [col], [shape])
    return df.withColumn(shape, row_flags(rule, band)[shape])


def flag(df: DataFrame, rule: Rule, band: Sequence | None = None,
         parent: DataFrame | None = None) -> DataFrame:
    """The flagged relation: one boolean column per shape."""
    out = df
    for shape in SHAPES:
        out = flag_shape(out, rule, shape, band, parent)
    return out


def key_profile(df: DataFrame, rule: Rule, band: Sequence | None = None,
                parent: DataFrame | None = None, references: bool = True) -> DataFrame:
    """Per key: rows ``_n`` and, per shape, the number of rows it fires on.

    One aggregation with map-side combine serves counts, verdicts and key-level routing. Only the
    columns of the rule are read. Without ``references`` the reference rule is left out.
    """
    used = [*rule.key, rule.numeric, rule.null, rule.fk and rule.fk[0], rule.fk_payload]
    base = df.select(*dict.fromkeys(c for c in used if c))
    flags = row_flags(rule, band)
    if not references:
        flags["fk_shape"] = F.lit(False)
    elif rule.fk is not None:
        base = flag_shape(base, rule, "fk_shape", band, parent)
        flags["fk_shape"] = F.col("fk_shape")
    grouped = base.groupBy(*rule.key).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(flags[s]).alias(s) for s in SHAPES[1:]])
    return grouped.withColumn("duplicate_shape", F.expr("if(_n > 1, _n, 0)"))


def hit_keys(df: DataFrame, rule: Rule, band: Sequence | None = None, parent: DataFrame | None = None) -> DataFrame:
    """Keys, which may repeat, of the rows that a value or reference shape fires on.

    Rows are filtered where they stand; only distinct references meet the parent.
    """
    fires = reduce(lambda a, b: a | b, row_flags(rule, band).values())
    keys = df.filter(fires).select(*rule.key)
    if rule.fk is not None:
        col, _, parent_col = rule.fk
        orphans = orphan_values(df, col, parent, parent_col, rule.parent_null_guard).select(col)
        keys = keys.union(within(df, materialize(orphans, "orphans"), [col]).select(*rule.key))
    return keys


def several_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of several rows; rows with NULL parts count by them."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*key)


def _verdict(multi: str) -> Column:
    fired = ", ".join(f"if({s} > 0, '{s}', null)" for s in SHAPES)
    return F.expr(
        f"case size(array_compact(array({fired}))) when 0 then 'clear' "
        f"when 1 then coalesce({fired}) else '{multi}' end")


def signal_report(df: DataFrame, rule: Rule, band: Sequence | None = None,
                  parent: DataFrame | None = None, unit: str = "rows") -> DataFrame:
    """One row: table size, fire count per shape and the verdict.

    ``unit='rows'`` counts rows (a key with a NULL part never fires as duplicate);
    ``unit='keys'`` counts distinct detected keys.
    """
    by_rows = unit == "rows"
    split = by_rows and rule.fk is not None         # orphan rows are counted without a row join
    profile = key_profile(df, rule, band, parent, references=not split)
    whole = " and ".join(f"{k} is not null" for k in rule.key)
    count = "sum({0})" if by_rows else "count_if({0} > 0)"
    counts = {s: count.format(s) for s in SHAPES}
    if by_rows:
        counts["duplicate_shape"] = f"sum(if({whole}, duplicate_shape, 0))"
    report = profile.agg(F.expr("coalesce(sum(_n), 0) as n_rows"), *[
        F.expr(f"coalesce({c}, 0) as {s}") for s, c in counts.items()])
    if split:
        col, _, parent_col = rule.fk
        orphans = orphan_values(df, col, parent, parent_col, rule.parent_null_guard).agg(
            F.expr("coalesce(sum(_n), 0) as fk_shape"), F.lit(1).alias("_one"))
        report = report.drop("fk_shape").withColumn("_one", F.lit(1)).join(
            F.broadcast(orphans), "_one").select("n_rows", *SHAPES)
    return report.withColumn("verdict", _verdict("multi"))


def two_signal_verdict(report: DataFrame) -> DataFrame:
    """Verdict over duplicate and numeric keys only; both together are a ``conflict``."""
    dup, num = F.col("duplicate_shape") > 0, F.col("numeric_shape") > 0
    return report.withColumn(
        "verdict", F.when(dup & num, "conflict").when(dup, "duplicate_shape")
        .when(num, "numeric_shape").otherwise("clear"))


def detected_keys(df: DataFrame, rule: Rule, band: Sequence | None = None,
                  parent: DataFrame | None = None, shapes: Sequence[str] = SHAPES) -> DataFrame:
    """Union of the detected key sets of ``shapes``, each key once."""
    hit = F.lit(False)
    for s in shapes:
        hit = hit | (F.col(s) > 0)
    return key_profile(df, rule, band, parent).filter(hit).select(*rule.key)


def key_sample(keys: DataFrame, key: Sequence[str], limit: int = 32) -> DataFrame:
    """The first keys in key order, with a flag saying whether more exist."""
    ordered = [F.col(c).asc_nulls_last() for c in key]
    peek = keys.select(*key).orderBy(*ordered).limit(limit + 1)
    size = peek.agg((F.count(F.lit(1)) > limit).alias("truncated"), F.lit(1).alias("_one"))
    return peek.orderBy(*ordered).limit(limit).withColumn("_one", F.lit(1)).join(
        size, "_one").drop("_one")


def fire_rates(df: DataFrame, rule: Rule, band: Sequence | None = None,
               parent: DataFrame | None = None) -> DataFrame:
    """Long form: shape, fired rows, table rows, rate."""
    report = signal_report(df, rule, band, parent)
    stack = ", ".join(f"'{s}', {s}" for s in SHAPES)
    return report.selectExpr("n_rows", f"stack({len(SHAPES)}, {stack}) as (shape, fired)").select(
        "shape", "fired", "n_rows", F.coalesce(ratio("fired", "n_rows"), F.lit(0.0)).alias("rate"))


def band_table(tables: Mapping[str, DataFrame], rules: Mapping[str, Rule],
               margin: float = 2.0) -> DataFrame:
    """[0, margin x observed maximum] for every table whose rule names a numeric column."""
    out = None
    for name, rule in rules.items():
        if rule.numeric and name in tables:
            row = tables[name].agg(F.max(rule.numeric).cast("double").alias("top")).select(
                F.lit(name).alias("name"), F.lit(rule.numeric).alias("numeric"),
                F.lit(0.0).alias("low"), (F.coalesce("top", F.lit(0.0)) * margin).alias("high"))
            out = row if out is None else out.unionByName(row)
    return out


def derive_bands(tables: Mapping[str, DataFrame], rules: Mapping[str, Rule],
                 margin: float = 2.0) -> dict[str, tuple[float, float]]:
    """The band table as literals: one short row per table, read in one job."""
    return {r["name"]: (r["low"], r["high"]) for r in band_table(tables, rules, margin).collect()}


def margin_sweep(df: DataFrame, col: str, margins: Sequence[float]) -> DataFrame:
    """Rows outside [0, m x max] for every margin: one pass for the maximum, one that counts."""
    top = df.agg(F.max(col).cast("double").alias("top")).scalar()
    value = F.col(col)
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.count_if((value < 0) | (value.cast("double") > top * F.lit(float(m)))).alias(f"f{i}")
        for i, m in enumerate(margins)])
    stack = ", ".join(f"cast({float(m)} as double), f{i}" for i, m in enumerate(margins))
    return wide.selectExpr("n_rows", f"stack({len(margins)}, {stack}) as (margin, fired)").select(
        "margin", "fired", "n_rows", ratio("fired", "n_rows").alias("rate"))


def band_drift(train: DataFrame, later: DataFrame, name: str, col: str,
               margins: Sequence[float]) -> DataFrame:
    """Would a band frozen on ``train`` fire on the later snapshot's maximum?"""
    tops = [d.agg(F.max(col).cast("double").alias("top")).withColumn("side", F.lit(s))
            for d, s in ((train, "train"), (later, "later"))]
    both = tops[0].unionByName(tops[1]).agg(
        F.max(F.when(F.col("side") == "train", F.col("top"))).alias("train_max"),
        F.max(F.when(F.col("side") == "later", F.col("top"))).alias("later_max"))
    return both.withColumn("margin", F.explode(F.array(*[F.lit(float(m)) for m in margins]))) \
        .select(F.lit(name).alias("name"), "margin", "train_max", "later_max",
                (F.col("later_max") > F.col("train_max") * F.col("margin")).alias("false_fires"))
