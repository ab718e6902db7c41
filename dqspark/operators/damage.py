"""How far a rebuilt sink is from its clean version."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dqspark.functions.scalars import cumulate, ratio
from dqspark.functions.skew import any_null, key_counts, within
from dqspark.session import materialize


def value_columns(df: DataFrame, key: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in key]


def row_groups(clean: DataFrame, dirty: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct (key, values) rows of both sides with their multiplicities ``nc`` and ``nd``."""
    cols = clean.columns
    both = clean.select(*cols, F.expr("1 as _c"), F.expr("0 as _d")).unionAll(
        dirty.select(*cols, F.expr("0 as _c"), F.expr("1 as _d")))
    return both.groupBy(*cols).agg(F.expr("sum(_c) as nc"), F.expr("sum(_d) as nd"))


def _digested(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The key with 128 bits of hash of all other columns, so that rows are compared without moving
    them; whether a value is NULL is hashed too."""
    values = value_columns(df, key)
    cells = [*values, *[F.col(v).isNull() for v in values]]
    return df.select(*key, F.xxhash64(F.lit(1), *cells).alias("_v1"), F.xxhash64(F.lit(2), *cells).alias("_v2"))


def digest_groups(clean: DataFrame, dirty: DataFrame, key: Sequence[str]) -> DataFrame:
    """``row_groups`` with a digest of the values in their place."""
    return row_groups(_digested(clean, key), _digested(dirty.select(*clean.columns), key), key)


# Per key: rows on both sides, equal pairs, rows matched as multisets.
_PER_KEY = ("sum(nc) as nc", "sum(nd) as nd", "sum(nc * nd) as equal_pairs",
            "sum(least(nc, nd)) as matched")


def key_groups(groups: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows, equal pairs and matched rows of every key."""
    return groups.groupBy(*key).agg(*[F.expr(e) for e in _PER_KEY])


def _counted(per_key: DataFrame, key: Sequence[str], form: str) -> DataFrame:
    if form == "keyset":
        null = " or ".join(f"{k} is null" for k in key)
        exprs = (f"cast(if({null}, 0, nc * nd - equal_pairs) as bigint) as changed",
                 "cast(nc = 0 as bigint) as added", "cast(nd = 0 as bigint) as lost")
    elif form == "multiset":
        changed = "least(nc - matched, nd - matched)"
        exprs = (f"{changed} as changed", f"nd - matched - {changed} as added",
                 f"nc - matched - {changed} as lost")
    else:
        raise ValueError(f"unknown form {form}")
    return per_key.selectExpr("*", *exprs)


def changes_per_key(clean: DataFrame, dirty: DataFrame, key: Sequence[str],
                    form: str = "keyset") -> DataFrame:
    """Per key the counts ``changed``, ``added``, ``lost``; two aggregations, no self join. Rows meet
    by key and digest, so no value column is shuffled.

    keyset: a key missing on one side counts once; changed counts unequal clean/dirty pairs
    (NULL keys never pair). multiset: surplus and missing copies count one by one.
    """
    per_key = key_groups(digest_groups(clean, dirty, key), key)
    return _counted(per_key, key, form).select(*key, "nc", "nd", "changed", "added", "lost")


def sink_base(clean: Mapping[str, DataFrame], sinks: Mapping) -> DataFrame:
    """``(sink, n_clean, twins)``: rows of every clean sink, and how many pairs of rows of one key are
    unequal in it. Branches over one snapshot share it; store it once. Rows are only compared in sinks
    that hold keys of several rows."""
    out = None
    for name, sink in sinks.items():
        df, key = clean[name], list(sink.key)
        sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("n_clean"),
            F.count_if(~any_null(key) & (F.col("_n") > 1)).alias("doubles"))
        row = sizes.select(F.lit(name).alias("sink"), "n_clean", "doubles")
        out = row if out is None else out.unionByName(row)
    out = materialize(out, "sizes")
    twins = None
    for name in [r["sink"] for r in out.filter("doubles > 0").select("sink").collect()]:
        df, key = clean[name], list(sinks[name].key)
        double = materialize(key_counts(df, key).filter("_n > 1").select(*key), "doubles")
        groups = _digested(within(df, double, key), key).groupBy(*key, "_v1", "_v2").agg(F.count("*").alias("n"))
        per_key = groups.groupBy(*key).agg(F.expr("sum(n) as nc"), F.expr("sum(n * n) as squares"))
        row = per_key.agg(F.expr("coalesce(sum(nc * nc - squares), 0) as twins")).select(F.lit(name).alias("sink"), "twins")
        twins = row if twins is None else twins.unionByName(row)
    if twins is None:
        return out.select("sink", "n_clean", F.lit(0).cast("long").alias("twins"))
    return out.join(twins, "sink", "left").select("sink", "n_clean", F.coalesce("twins", F.lit(0)).alias("twins"))


def _patched(clean: Mapping, changes: Mapping, sinks: Mapping, form: str, base: DataFrame) -> DataFrame:
    """Damage of sinks of which only the rows of some keys can differ; all other keys are equal, and
    keep the unequal pairs they have with themselves."""
    out = None
    for name, sink in sinks.items():
        change, key = changes[name], list(sink.key)
        known = ~any_null(key)
        part = within(clean[name], change.keys, change.own)
        groups = digest_groups(part, change.added, key)
        per_key = groups.groupBy(*key).agg(*[F.expr(e) for e in _PER_KEY], F.expr("sum(nc * nc) as squares"))
        counted = _counted(per_key, key, form)
        row = counted.agg(*[F.expr(e) for e in _TOTALS[:3]],
                          F.coalesce(F.sum(F.when(known, F.expr("nc * nc - squares"))), F.lit(0)).alias("own_twins"))
        row = row.select(F.lit(name).alias("sink"), F.lit(sink.kind).alias("kind"), "changed", "added", "lost", "own_twins")
        out = row if out is None else out.unionByName(row)
    met = out.join(base, "sink")
    if form == "keyset":
        met = met.withColumn("changed", F.col("changed") + F.col("twins") - F.col("own_twins"))
    return _damage(met).select("sink", "kind", "changed", "added", "lost", "n_clean", "damage")


_TOTALS = ("coalesce(sum(changed), 0) as changed", "coalesce(sum(added), 0) as added",
           "coalesce(sum(lost), 0) as lost", "coalesce(sum(nc), 0) as n_clean")


def _damage(total: DataFrame) -> DataFrame:
    return total.withColumn("damage", F.expr(
        "coalesce(try_divide(cast(2 * changed + added + lost as double), "
        "cast(2 * n_clean + added - lost as double)), 0.0D)"))


def exact_damage(clean: DataFrame, dirty: DataFrame, key: Sequence[str],
                 form: str = "keyset") -> DataFrame:
    """One row: changed, added, lost, clean rows and damage = (2C+A+L) / (2N+A-L)."""
    per_key = changes_per_key(clean, dirty, key, form)
    return _damage(per_key.agg(*[F.expr(e) for e in _TOTALS]))


def _magnitude(col: str) -> Column:
    return F.abs(F.coalesce(F.col(col), F.lit(0)))


def _filled(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(0))


def _pair_distances(groups: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Summed distances over all clean/dirty pairs of keys with several rows, without the pairs.

    For one column of one key the sum over pairs follows from running counts and sums of the dirty
    values in value order, so the cost is linear in the distinct rows of the key.
    """
    zero = F.lit(False)
    for v in values:
        zero = zero | (_filled(v) == 0)
    types = dict(groups.dtypes)
    kind = ("double" if any(types[v] in ("double", "float") for v in values)
            else "decimal(28,4)")
    cells = F.explode(F.array(*[F.struct(
        F.lit(i).alias("i"), _filled(v).cast(kind).alias("v"))
        for i, v in enumerate(values)])).alias("_cell")
    long = groups.select(*key, "nc", "nd", zero.alias("_zero"), cells)
    long = long.select(*key, "nc", "nd", "_zero", "_cell.i", "_cell.v").groupBy(
        *key, "i", "v").agg(
        F.sum("nc").alias("nc"), F.sum("nd").alias("nd"),
        F.sum(F.when(~F.col("_zero"), F.col("nc")).otherwise(0)).alias("nr"))
    long = long.withColumn("_w", F.col("nd") * F.col("v"))
    long = cumulate(long, [*key, "i"], ["v"], sums={"cn": "nd", "cs": "_w"})
    v = F.col("v")
    apart = v * (2 * F.col("cn") - F.col("cn_total")) + (F.col("cs_total") - 2 * F.col("cs"))
    return long.agg(
        F.coalesce(F.sum(F.col("nc") * apart), F.lit(0)).cast("double").alias("distance"),
        F.coalesce(F.sum(F.when(F.col("nr") > 0, F.col("nr") * apart.cast("double")
                                / F.abs(v).cast("double"))), F.lit(0.0)).alias("relative"))


def _settle(groups: DataFrame, key: Sequence[str], values: Sequence[str], form: str) -> DataFrame:
    """One row: exact counts, and the distances of all keys with one row per side.

    ``dense`` counts the keys with several rows, whose distances are still open.
    """
    size = sum((_magnitude(v) for v in values[1:]), _magnitude(values[0]))
    sides = []
    for v in values:
        sides += [F.sum(F.col("nc") * _filled(v)).alias(f"c_{v}"),
                  F.sum(F.col("nd") * _filled(v)).alias(f"d_{v}")]
    per_key = _counted(groups.groupBy(*key).agg(
        *[F.expr(e) for e in _PER_KEY],
        F.sum(F.col("nc") * size).alias("clean_size"),
        F.sum(F.col("nd") * size).alias("dirty_size"), *sides), key, form)
    joins = ~any_null(key)
    paired = joins & (F.col("nc") > 0) & (F.col("nd") > 0)
    single = paired & (F.col("nc") == 1) & (F.col("nd") == 1)
    gaps = [F.abs(F.col(f"c_{v}") - F.col(f"d_{v}")) for v in values]
    zero, rel = F.lit(False), F.lit(0.0)
    for v, gap in zip(values, gaps):
        zero = zero | (F.col(f"c_{v}") == 0)
        rel = rel + F.try_divide(gap.cast("double"), F.abs(F.col(f"c_{v}")).cast("double"))
    lost, added = F.col("nd") == 0, F.col("nc") == 0
    real = [F.sum(F.when(single, sum(gaps[1:], gaps[0]))).cast("double").alias("distance"),
            F.sum(F.when(single & ~zero, rel)).alias("relative"),
            F.sum(F.when(joins & lost, F.col("clean_size"))).cast("double").alias("lost_size"),
            F.sum(F.when(joins & added, F.col("dirty_size"))).cast("double").alias("added_size"),
            F.sum("clean_size").cast("double").alias("clean_size")]
    total = per_key.agg(*[F.expr(e) for e in _TOTALS], *real, F.count_if(lost).alias("lost_keys"),
                        F.count_if(added).alias("added_keys"),
                        F.count_if(paired & ~single).alias("dense"))
    return total.fillna(0.0, ["distance", "relative", "lost_size", "added_size", "clean_size"])


def distances(pairs: Mapping[str, tuple], form: str = "keyset") -> DataFrame:
    """Per name of ``pairs`` (clean, dirty, key, values) the exact, the value-weighted and the
    relative-error damage.

    value weighted: (|c-d| on matched pairs + |c| of lost + |d| of added rows) / total |c|.
    relative: per matched pair the mean of |c-d|/|c| over the columns (0 for the whole pair once a
    clean value is 0 or NULL), plus added and lost keys, over the clean rows.
    All names are settled in one job; only those with keys of several rows need a second one.
    """
    grouped = {n: row_groups(c, d, key) for n, (c, d, key, _) in pairs.items()}
    rows = None
    for name, (_, _, key, values) in pairs.items():
        row = _settle(grouped[name], list(key), list(values), form).select(
            F.lit(name).alias("name"), F.lit(len(values)).alias("n_values"), "*")
        rows = row if rows is None else rows.unionByName(row)
    rows = materialize(rows, "distances")
    dense = [r["name"] for r in rows.filter("dense > 0").select("name").collect()]
    for name in dense:
        _, _, key, values = pairs[name]
        key, values, groups = list(key), list(values), grouped[name]
        per_key = key_groups(groups, key)
        several = per_key.filter(~any_null(key) & (F.col("nc") > 0) & (F.col("nd") > 0)
                                 & (F.col("nc") + F.col("nd") > 2)).select(*key)
        extra = _pair_distances(groups.join(several, key, "left_semi"), key, values).select(
            F.lit(name).alias("name"), F.col("distance").alias("_dist"),
            F.col("relative").alias("_rel"))
        rows = rows.join(extra, "name", "left").withColumns({
            "distance": F.col("distance") + F.coalesce("_dist", F.lit(0.0)),
            "relative": F.col("relative") + F.coalesce("_rel", F.lit(0.0))}).drop("_dist", "_rel")
    far = F.col("distance") + F.col("lost_size") + F.col("added_size")
    dev = F.col("relative") / F.col("n_values") + F.col("added_keys") + F.col("lost_keys")
    return _damage(rows).select(
        "name", "changed", "added", "lost", "n_clean", "damage",
        F.coalesce(ratio(far, "clean_size"), F.lit(0.0)).alias("damage_value_weighted"),
        F.coalesce(ratio(dev, "n_clean"), F.lit(0.0)).alias("damage_relative_error"))


def distance_damage(clean: DataFrame, dirty: DataFrame, key: Sequence[str],
                    values: Sequence[str], form: str = "keyset") -> DataFrame:
    """One row with exact, value-weighted and relative-error damage of one table."""
    return distances({"table": (clean, dirty, key, values)}, form).drop("name")


def sink_damage(clean: Mapping[str, DataFrame], dirty: Mapping[str, DataFrame], sinks: Mapping,
                form: str = "keyset", variants: bool = False, changes: Mapping | None = None,
                base: DataFrame | None = None) -> DataFrame:
    """Per sink: kind, counts and damage (and the two distance variants).

    A sink the branch never rebuilt is the clean DataFrame itself: only its size is read. With the
    ``changes`` of a delta run, sinks are compared on the changed keys alone, with ``base`` (see
    ``sink_base``) for what the rest holds; distances read the whole sinks.
    """
    partial = {n: s for n, s in sinks.items() if not variants and n in (changes or {})
               and not changes[n].whole and set(changes[n].own) <= set(s.key)}
    out = None
    if partial:
        out = _patched(clean, changes, partial, form, sink_base(clean, partial) if base is None else base)
        sinks = {n: s for n, s in sinks.items() if n not in partial}
    kinds = {n: F.lit(s.kind).alias("kind") for n, s in sinks.items()}
    changed = {n: s for n, s in sinks.items() if dirty[n] is not clean[n]}
    if variants and changed:
        got = distances({n: (clean[n], dirty[n], s.key, s.values) for n, s in changed.items()}, form)
        kind = F.create_map(*[x for n, s in changed.items() for x in (F.lit(n), F.lit(s.kind))])
        out = got.withColumn("kind", kind[F.col("name")]).withColumnRenamed("name", "sink")
    for name, sink in sinks.items():
        if name in changed and variants:
            continue
        if name in changed:
            row = exact_damage(clean[name], dirty[name], sink.key, form)
        else:
            none = [F.lit(0).cast("long").alias(x) for x in ("changed", "added", "lost")]
            row = clean[name].agg(F.count(F.lit(1)).alias("n_clean")).select(
                *none, "n_clean", F.lit(0.0).alias("damage"))
        if variants:
            row = row.withColumns({x: F.lit(0.0) for x in (
                "damage_value_weighted", "damage_relative_error")})
        row = row.select(F.lit(name).alias("sink"), kinds[name], *row.columns)
        out = row if out is None else out.unionByName(row)
    return out


def macro_damage(per_sink: DataFrame, value: str = "damage") -> DataFrame:
    """Unweighted mean over all sinks and over the sinks of each kind."""
    by_kind = per_sink.groupBy("kind").agg(F.avg(value).alias(value))
    return by_kind.unionByName(per_sink.agg(F.avg(value).alias(value)).select(
        F.lit("all").alias("kind"), value))


def nrd(dirty: Column | str, baseline: Column | str) -> Column:
    """Damage relative to no validation; NULL without a positive baseline."""
    return ratio(dirty, baseline)


def explain_rows(clean: DataFrame, dirty: DataFrame, key: Sequence[str],
                 form: str = "keyset") -> DataFrame:
    """The keys that differ, with what happened to them."""
    c = changes_per_key(clean, dirty, key, form)
    kind = (F.when(F.col("nc") == 0, "added").when(F.col("nd") == 0, "lost")
            .when(F.col("changed") > 0, "changed"))
    if form == "multiset":
        kind = kind.when(F.col("added") > 0, "copied").when(F.col("lost") > 0, "thinned")
    return c.withColumn("change", kind).filter(F.col("change").isNotNull()).select(
        *key, "change", "changed", "added", "lost")


def key_difference(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct key tuples of ``a`` missing in ``b``; NULLs compare equal."""
    return a.select(*key).subtract(b.select(*key))
