"""Column helpers shared by operators and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dqspark.session import materialize


def money(col: str) -> Column:
    """Two-decimal amount as DECIMAL, so sums are exact in any order."""
    return F.col(col).cast("decimal(18,2)")


def mean4(total: str, n: str) -> Column:
    """total / n for a total with two decimals, rounded half up to four decimals without floating
    point; NULL when n is 0."""
    cents = f"cast({total} * 100 as decimal(38,0))"
    units = f"((abs({cents}) * 200 + cast({n} as decimal(20,0))) div (2 * cast({n} as decimal(20,0))))"
    signed = f"cast(if({total} < 0, -{units}, {units}) as decimal(19,0))"
    return F.expr(f"if({n} > 0, cast({signed} * cast(0.0001 as decimal(5,4)) as decimal(18,4)), null)")


def micros(col: str) -> Column:
    """Sum of a number as millionths, exact in any order of the rows; NULL over no value."""
    return F.expr(f"sum(cast(cast({col} as decimal(28,6)) * 1000000 as decimal(28,0)))")


def rounded(total: str, n: str, digits: int) -> Column:
    """Millionths ``total`` / ``n`` as double, rounded half up to ``digits`` without floating
    point; NULL when n is 0."""
    unit = 10 ** (6 - digits)
    n = f"cast({n} as decimal(20,0))"
    units = f"((abs({total}) * 2 + {unit} * {n}) div ({2 * unit} * {n}))"
    return F.expr(f"if({n} > 0, cast(if({total} < 0, -{units}, {units}) as double) / {10 ** digits}, null)")


def rank_hash(salt: str, cols: Sequence[str]) -> Column:
    """sha256 of the salt and the key values joined by ``|``."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in cols]
    return F.sha2(F.concat_ws("|", F.lit(salt), *parts), 256)


def hash_number(text: Column) -> Column:
    """First 60 bits of sha256 as a non-negative BIGINT."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as double, NULL on a zero denominator."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return F.try_divide(num.cast("double"), den.cast("double"))


def cumulate(df: DataFrame, part: Sequence[str], order: Sequence[str],
             sums: dict[str, str] | None = None, maxima: dict[str, str] | None = None,
             inclusive: bool = True) -> DataFrame:
    """Running sums and maxima inside ``part``; no part and no value is sorted in one task.

    Rows are dealt into ranges of (part, order) with a tie-break, so that equal values spread too,
    and stored with the number of their range. Rows accumulate inside their range; the totals of
    the ranges, one row for each part and range, accumulate over the ranges and are added. Each sum
    ``s`` also yields ``s_total``. Rows whose first order column is NULL count in the totals only
    and are dropped. ``inclusive=False`` leaves the current row out.
    """
    sums, maxima = sums or {}, maxima or {}
    part, kept = list(part), list(df.columns)
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(
        ranges, *part, *order, "_tie").withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    totals = dealt.groupBy(*part, "_range").agg(
        *[F.sum(c).alias(f"_t_{a}") for a, c in sums.items()],
        *[F.max(c).alias(f"_t_{a}") for a, c in maxima.items()],
        *[F.sum(F.when(F.col(order[0]).isNotNull(), F.col(c))).alias(f"_k_{a}") for a, c in sums.items()],
        *[F.max(F.when(F.col(order[0]).isNotNull(), F.col(c))).alias(f"_k_{a}") for a, c in maxima.items()])
    before = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    totals = totals.select(
        *part, "_range",
        *[F.coalesce(F.sum(f"_k_{a}").over(before), F.lit(0)).alias(f"_b_{a}") for a in sums],
        *[F.sum(f"_t_{a}").over(whole).alias(f"{a}_total") for a in sums],
        *[F.max(f"_k_{a}").over(before).alias(f"_b_{a}") for a in maxima])
    within = Window.partitionBy(*part, "_range").orderBy(*order, "_tie").rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    inner = dealt.filter(F.col(order[0]).isNotNull()).select(
        *kept, "_range",
        *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_w_{a}") for a, c in sums.items()],
        *[F.max(c).over(within).alias(f"_w_{a}") for a, c in maxima.items()])
    met = [F.col(f"i.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*part, "_range"]]
    joined = inner.alias("i").join(totals.alias("t"), met)
    return joined.select(
        *[f"i.{c}" for c in kept],
        *[(F.col(f"_w_{a}") + F.col(f"_b_{a}")).alias(a) for a in sums],
        *[f"{a}_total" for a in sums],
        *[F.greatest(F.col(f"_w_{a}"), F.col(f"_b_{a}")).alias(a) for a in maxima])


def ranked(df: DataFrame, part: Sequence[str], value: str) -> DataFrame:
    """Rank of every row by ``value`` inside ``part`` and the part's size (``rank``, ``size``)."""
    out = cumulate(df.withColumn("_c", F.lit(1)), part, [value], sums={"rank": "_c"})
    return out.withColumnRenamed("rank_total", "size").drop("_c")


def medians(df: DataFrame, part: Sequence[str], value: str) -> DataFrame:
    """Exact median per part (mean of the two middle values), sorted range by range."""
    r = ranked(df.filter(F.col(value).isNotNull()), part, value)
    middle = (F.col("rank") == F.floor((F.col("size") + 1) / 2)) | (
        F.col("rank") == F.floor(F.col("size") / 2) + 1)
    return r.filter(middle).groupBy(*part).agg(F.avg(value).alias("median"))
