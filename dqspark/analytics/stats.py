"""Paired statistics for many comparisons at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dqspark.functions.scalars import cumulate, hash_number
from dqspark.session import materialize

#: Differences of one comparison up to which all sign assignments are counted: 2^25 sums a half.
FLIP_LIMIT = 50
EXACT = "decimal(28,15)"


#: Differences of a comparison up to which they travel as one array (8 bytes each); resamples that meet it at once.
DRAW_ARRAY = 1 << 16
DRAW_BLOCK = 50


def _draw(seed: str, n: Column, resample: Column, j: Column) -> Column:
    return F.pmod(hash_number(F.concat_ws("|", F.lit(seed), resample.cast("string"), j.cast("string"))), n)


def _means_of_arrays(values: DataFrame, resamples: int, seed: str) -> DataFrame:
    """Resampled means of short comparisons: each block of resamples meets the array of differences in one
    task, so a draw is a look-up, and only arrays are shuffled, one for each block."""
    lists = values.groupBy("comparison").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("_h", "campaign", "diff"))), lambda x: x["diff"].cast("double")).alias("d"))
    blocks = -(-resamples // DRAW_BLOCK)
    met = lists.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition("comparison", "_b")
    first = F.col("_b") * DRAW_BLOCK
    met = met.withColumn("resample", F.explode(F.sequence(
        first, F.least(first + (DRAW_BLOCK - 1), F.lit(resamples - 1)))))
    n = F.size("d").cast("long")
    drawn = F.transform(F.sequence(F.lit(0), F.size("d") - 1), lambda j: F.get(
        F.col("d"), _draw(seed, n, F.col("resample"), j).cast("int")))
    some = F.filter(drawn, lambda x: x.isNotNull())
    total = F.aggregate(some, F.lit(0.0), lambda a, x: a + x)
    return met.select("comparison", "resample", F.try_divide(total, F.size(some)).alias("mean"))


def _means_of_joins(values: DataFrame, resamples: int, seed: str) -> DataFrame:
    """Resampled means of long comparisons: the draw index is the join key, so the draws of one comparison
    spread over all tasks. A difference's position comes from running counts."""
    placed = cumulate(values.withColumn("_c", F.lit(1)), ["comparison"], ["_h", "campaign"], sums={"_pos": "_c"})
    placed = placed.select("comparison", (F.col("_pos") - 1).alias("_i"), "diff", F.col("_pos_total").alias("n"))
    draws = placed.select("comparison", "n", F.col("_i").alias("_j")).withColumn(
        "resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    draws = draws.withColumn("_i", _draw(seed, F.col("n"), F.col("resample"), F.col("_j")))
    met = draws.join(placed.select("comparison", "_i", "diff"), ["comparison", "_i"])
    return met.groupBy("comparison", "resample").agg(F.avg("diff").alias("mean"))


def bootstrap_means(diffs: DataFrame, resamples: int = 10_000, seed: str = "0") -> DataFrame:
    """(comparison, resample, mean): means of n draws with replacement.

    Draw j of resample r of a comparison takes the difference at index sha256(seed, r, j) mod n, in the order
    of the campaigns' hashes. NULL differences are drawn, and count in no mean; rows without campaign are
    left out. Comparisons of more than ``DRAW_ARRAY`` differences go another way to the same draws.
    """
    values = diffs.filter("campaign is not null").select(
        "comparison", "campaign", "diff", hash_number(F.col("campaign").cast("string")).alias("_h"))
    sized = values.groupBy("comparison").agg(F.count(F.lit(1)).alias("_n"))
    long = materialize(sized.filter(F.col("_n") > DRAW_ARRAY).select("comparison"), "long-comparisons")
    if long.isEmpty():
        return _means_of_arrays(values, resamples, seed)
    same = [F.col("comparison").eqNullSafe(F.col("_long"))]
    long = long.toDF("_long")
    return _means_of_arrays(values.join(long, same, "left_anti"), resamples, seed).unionByName(
        _means_of_joins(values.join(long, same, "left_semi"), resamples, seed))


def bootstrap_ci(diffs: DataFrame, resamples: int = 10_000, seed: str = "0") -> DataFrame:
    """Percentile interval (2.5 % and 97.5 % order statistics) and the share below zero.

    The resampled means of a comparison (``resamples`` numbers) are sorted by percentile_disc.
    """
    means = bootstrap_means(diffs, resamples, seed)
    low, high = int(0.025 * resamples) + 1, int(0.975 * resamples)

    def rank(r: int, name: str) -> Column:        # the r-th smallest of exactly `resamples` values
        return F.expr(f"percentile_disc({(r - 0.5) / resamples}) within group (order by mean)") \
            .alias(name)

    return means.groupBy("comparison").agg(
        F.avg("mean").alias("mean"), rank(low, "lower"), rank(high, "upper"),
        (F.count_if(F.col("mean") < 0) / F.lit(float(resamples))).alias("below_zero"))


def _half_sums(halves: DataFrame) -> DataFrame:
    """``(comparison, side, total)``: the sums of ``d`` under all sign masks, in as many rows."""
    width = 12                                       # masks come as high and low parts
    halves = halves.withColumn("_n", F.size("d")).withColumn("_hi", F.expr(
        f"explode(sequence(0, shiftleft(1, greatest(_n - {width}, 0)) - 1))"))
    halves = halves.repartition("comparison", "side", "_hi").withColumn("_lo", F.expr(
        f"explode(sequence(0, shiftleft(1, least(_n, {width})) - 1))"))
    mask = F.col("_hi") * (1 << width) + F.col("_lo")
    signed = F.transform("d", lambda x, i: F.when(F.call_function("getbit", mask, i) == 1, x).otherwise(-x))
    total = F.aggregate(signed, F.lit(0).cast(EXACT), lambda a, x: (a + x).cast(EXACT))
    return halves.select("comparison", "side", "bound", total.alias("total"))


def sign_flip(diffs: DataFrame) -> DataFrame:
    """Exact one-sided sign-flip p per comparison over all 2^n sign assignments.

    An assignment is a half for the first differences and one for the rest, so it counts where the
    first half's sum is at most the bound less the second half's. Both sets of sums, 2^(n/2) each, are
    merged in order of value: every second half counts the first halves up to its place. Equal sums
    are one row, and a comparison's rows accumulate in ranges. Differences count with 15 decimals, so
    sums are exact; NULL differences count nowhere.

    Returns comparison, n, p and status: a comparison of no difference, or of more than ``FLIP_LIMIT``,
    has p NULL and status ``refused``, which leaves all others as they are.
    """
    sized = diffs.groupBy("comparison").agg(F.count("diff").alias("n"))
    fits = (F.col("n") > 0) & (F.col("n") <= FLIP_LIMIT)
    refused = sized.filter(~fits).select(
        "comparison", "n", F.lit(None).cast("double").alias("p"), F.lit("refused").alias("status"))
    few = diffs.filter("diff is not null").join(sized.filter(fits), "comparison")
    lists = few.groupBy("comparison").agg(F.transform(F.array_sort(F.array_agg(
        F.struct("campaign", "diff"))), lambda x: x["diff"].cast(EXACT)).alias("d"))
    n, half = F.size("d"), F.floor(F.size("d") / 2).cast("int")
    bound = F.aggregate("d", F.lit(0).cast(EXACT), lambda a, x: (a + x).cast(EXACT)) + (
        n * F.lit("0.000000000000001").cast("decimal(16,15)"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.slice("d", F.lit(1), half).alias("d")),
                    F.struct(F.lit(1).alias("side"), F.slice("d", half + 1, n - half).alias("d")))
    halves = lists.select("comparison", bound.cast(EXACT).alias("bound"), F.explode(sides).alias("s"))
    sums = _half_sums(halves.select("comparison", "bound", "s.side", "s.d"))
    first = F.col("side") == 0
    place = F.when(first, F.col("total")).otherwise((F.col("bound") - F.col("total")).cast(EXACT))
    merged = sums.groupBy("comparison", place.alias("place")).agg(
        F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    met = cumulate(merged, ["comparison"], ["place"], sums={"below": "a"})
    hits = met.groupBy("comparison").agg(F.sum(F.col("b") * F.col("below")).alias("hits"))
    out = hits.join(sized, "comparison").select(
        "comparison", "n", (F.col("hits") / F.pow(F.lit(2.0), F.col("n"))).alias("p"), F.lit("exact").alias("status"))
    return out.unionByName(refused)


def holm(pvals: DataFrame) -> DataFrame:
    """Holm-adjusted p per family: running maximum of min(1, (m - i) p) in ascending order.

    pvals: (family, name, p). Rows whose p is NULL (refused) are no tests of the family: they are
    returned without rank and adjusted p, and m counts the others. Ranks and maxima are accumulated
    over ranges of (family, p, name), so a family of any size is sorted in parts, also where all its
    p-values are equal.
    """
    open_ = pvals.filter("p is null").select(
        "family", "name", "p", F.lit(None).cast("long").alias("rank"), F.lit(None).cast("double").alias("adjusted"))
    tests = pvals.filter("p is not null").withColumn("_c", F.lit(1))
    ranked = cumulate(tests, ["family"], ["p", "name"], sums={"rank": "_c"})
    ranked = ranked.withColumn("_raw", F.least(F.lit(1.0), (
        F.col("rank_total") - F.col("rank") + 1) * F.col("p")))
    out = cumulate(ranked.drop("_c", "rank_total"), ["family"], ["p", "name"],
                   maxima={"adjusted": "_raw"})
    return out.select("family", "name", "p", "rank", "adjusted").unionByName(open_)
