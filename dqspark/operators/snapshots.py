"""Temporal and referentially closed snapshots, and checks on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dqspark.functions.scalars import cumulate, ratio
from dqspark.functions.skew import lookup_join


def running_counts(df: DataFrame, time: str) -> DataFrame:
    """Rows at or before each time value, with the table total (NULL times count there only).

    The table collapses to its time histogram first; the histogram is accumulated range by range.
    """
    hist = df.groupBy(F.col(time).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return cumulate(hist, [], ["t"], sums={"running": "n"}).withColumnRenamed("running_total", "total")


#: Rows of a bracket up to which its histogram is accumulated in one place; sketch accuracy.
FEW_ROWS, ACCURACY = 100_000, 10_000


def _near(share: float) -> list[float]:
    """Quantiles just below and above a share, further apart than the sketch errs."""
    return [min(1.0, max(0.0, share + d / ACCURACY)) for d in (-2, 2)]


def cut_point(df: DataFrame, time: str, q: float) -> DataFrame:
    """One row: the largest time whose running count is at most q of the table (at least the
    first time), the rows up to it and the total. Without any time the cut is NULL.

    A quantile sketch brackets the cut and a counting pass says how many rows lie up to each side of
    the bracket, so that the sketch's error does not matter; this repeats inside the bracket while it holds
    many rows. The histogram of what is left gives the exact cut. Only the time column is read, and
    the table is neither sorted nor stored.
    """
    kind = df.schema[time].dataType.simpleString()
    plain = "timestamp" if kind == "timestamp_ntz" else kind
    values = df.select(F.col(time).cast(plain).alias("t"))
    t = F.col("t")
    ends = values.agg(F.count(F.lit(1)).alias("n"), F.count(t).alias("known"), F.max(t).alias("last"),
                      F.percentile_approx(t, _near(q), ACCURACY).alias("near")).first()
    goal, low, below, high, upper = q * ends["n"], None, 0, ends["last"], ends["known"]
    near = ends["near"]
    while upper - below > FEW_ROWS:
        counts = values.agg(*[F.count_if(t <= F.lit(p)) for p in near]).first()
        before = (low, high)
        for p, n in zip(near, counts):
            if n <= goal and (low is None or p > low):
                low, below = p, n
            elif n > goal and p < high:
                high, upper = p, n
        if before == (low, high):
            break                       # few times hold all these rows, so their histogram is short
        inside = values.filter((t <= F.lit(high)) & (F.lit(True) if low is None else t > F.lit(low)))
        share = (goal - below) / max(1, upper - below)
        near = inside.agg(F.percentile_approx(t, _near(share), ACCURACY).alias("near")).first()["near"]
        if not near:
            break
    rest = values.filter((t <= F.lit(high).cast(plain)) & (F.lit(True) if low is None else t > F.lit(low)))
    hist = rest.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    if upper - below <= FEW_ROWS:
        run = hist.select("t", F.sum("n").over(Window.orderBy("t")).alias("running"))
    else:
        run = cumulate(hist, [], ["t"], sums={"running": "n"})
    run = run.select("t", (F.col("running") + F.lit(below)).alias("running"))
    got = run.agg(F.max(F.when(F.col("running") <= F.lit(float(goal)), F.struct("t", "running"))).alias("last"),
                  F.min(F.struct("t", "running")).alias("first"))
    known = F.col("first") if low is None else F.struct(
        F.lit(low).cast(plain).alias("t"), F.lit(below).cast("long").alias("running"))
    best = F.coalesce("last", known)
    return got.select(best["t"].cast(kind).alias("cut"), best["running"].alias("train_rows"),
                      F.lit(ends["n"]).cast("long").alias("total_rows"),
                      (F.lit(ends["n"]).cast("long") - best["running"]).alias("validation_rows"))


def temporal_split(df: DataFrame, time: str, cut) -> tuple[DataFrame, DataFrame]:
    """(train, validation) around a cut; rows without a time stay on both sides."""
    early = F.col(time) <= cut
    return (df.filter(F.coalesce(early, F.lit(True))), df.filter(F.coalesce(~early, F.lit(True))))


def split_manifest(tables: Mapping[str, tuple[DataFrame, str]], q: float) -> DataFrame:
    """Cut, counts and train share of every fact table."""
    out = None
    for name, (df, time) in tables.items():
        row = cut_point(df, time, q).select(
            F.lit(name).alias("name"), F.col("cut").cast("string").alias("cut"), "train_rows",
            "validation_rows", "total_rows",
            ratio("train_rows", "total_rows").alias("train_share"))
        out = row if out is None else out.unionByName(row)
    return out


def before(df: DataFrame, time: str, cutoff) -> DataFrame:
    """Rows strictly before the cutoff; rows without a time are dropped."""
    return df.filter(F.col(time) < cutoff)


def closed_snapshot(tables: Mapping[str, DataFrame], fact: str, time: str, cutoff,
                    refs: Sequence[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Facts before the cutoff and, for each (table, column, other, other column) of ``refs`` in
    order, only the rows of ``table`` that ``other`` still refers to."""
    out = dict(tables)
    out[fact] = before(tables[fact], time, cutoff)
    for table, col, other, other_col in refs:
        keys = out[other].select(F.col(other_col).alias(col))
        out[table] = lookup_join(out[table], keys, [col], "left_semi")
    return out


def closure_audit(tables: Mapping[str, DataFrame],
                  refs: Mapping[str, tuple[str, str, str, str]]) -> DataFrame:
    """Per check the rows of a table whose reference is missing (a NULL reference is missing).

    Both sides are reduced to distinct keys with counts before they meet.
    """
    out = None
    for name, (table, col, other, other_col) in refs.items():
        values = tables[table].groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
        known = tables[other].select(F.col(other_col).alias(col))
        row = values.join(known.distinct(), col, "left_anti").agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("orphans")).select(
            F.lit(name).alias("check"), "orphans")
        out = row if out is None else out.unionByName(row)
    return out


def snapshot_guard(tables: Mapping[str, DataFrame], fact: str, time: str, cutoff) -> DataFrame:
    """Per table its row count, and rows at or after the cutoff or without a time (fact only)."""
    out = None
    for name, df in tables.items():
        late = F.col(time).isNull() | (F.col(time) >= cutoff) if name == fact else F.lit(False)
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(late).alias("late")).select(
            F.lit(name).alias("name"), "rows", "late", (F.col("rows") > 0).alias("not_empty"))
        out = row if out is None else out.unionByName(row)
    return out


# The scalar types a digest admits, with their tag.
TAGS = {"string": "str", "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int",
        "double": "float", "float": "float", "boolean": "bool", "date": "date",
        "timestamp": "datetime", "timestamp_ntz": "datetime", "binary": "bytes"}


def _tagged(name: str, kind: str) -> Column:
    tag = "decimal" if kind.startswith("decimal") else TAGS.get(kind)
    if tag is None:
        raise TypeError(f"column {name} has unsupported type {kind}")
    c = F.col(name)
    if tag == "datetime":
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    elif tag == "bytes":
        text = F.hex(c)
    elif tag == "float":
        finite = ~F.isnan(c) & (F.abs(c) < float("inf"))
        text = F.when(c.isNull() | finite, c.cast("string")).otherwise(
            F.raise_error(F.lit(f"non-finite value in {name}")))
    else:
        text = c.cast("string")
    return F.coalesce(F.concat(F.lit(f"{tag}:"), F.length(text).cast("string"), F.lit(":"), text),
                      F.lit("null"))


def digest(df: DataFrame) -> DataFrame:
    """Order-free content digest of a table: one row (columns, rows, two sums, xor).

    Every row is hashed from its type-tagged, length-prefixed values; equal bags give equal
    digests, whatever the order or partitioning.
    """
    line = F.concat_ws("|", *[_tagged(n, k) for n, k in df.dtypes])
    h = df.select(F.sha2(line, 256).alias("h"))
    high = F.conv(F.substring("h", 1, 15), 16, 10).cast("long")
    low = F.conv(F.substring("h", 16, 15), 16, 10).cast("long")
    return h.select(high.alias("a"), low.alias("b")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("a").cast("decimal(38,0)")).cast("string").alias("sum_high"),
        F.sum(F.col("b").cast("decimal(38,0)")).cast("string").alias("sum_low"),
        F.bit_xor("a").alias("xor_high")).select(
        F.lit(",".join(df.columns)).alias("columns"), "rows", "sum_high", "sum_low", "xor_high")


def same_identity(tables: Mapping[str, DataFrame], expected: DataFrame) -> DataFrame:
    """Row counts against expected (identity, name, rows): which identities match fully."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("seen")).select(F.lit(name).alias("name"), "seen")
        out = row if out is None else out.unionByName(row)
    met = expected.join(out, "name", "left")
    return met.groupBy("identity").agg(
        F.bool_and(F.coalesce(F.col("rows") == F.col("seen"), F.lit(False))).alias("matches"),
        F.count_if(F.coalesce(F.col("rows") != F.col("seen"), F.lit(True))).alias("different"))
