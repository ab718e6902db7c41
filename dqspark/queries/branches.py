"""Damage measures and protected branches over the star lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.analytics.responses import derive_policy
from dqspark.functions.scalars import ratio
from dqspark.operators import damage as dm
from dqspark.operators.dispositions import route_live
from dqspark.operators.injection import inject_all
from dqspark.operators.signals import derive_bands, margin_sweep, signal_report
from dqspark.plans.delta import delta_run, measure, placement_grid
from dqspark.plans.star import STAR
from dqspark.queries import cases as c
from dqspark.queries.common import damage_sql, keyed, star_ctes, star_tables, with_sql
from dqspark.session import materialize

QUERIES = {}
ORACLES = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def _branch(spark, sf_dir, specs=c.mixed, plan=None, stored=False, **options):
    clean = (_stored if stored else star_tables)(spark, sf_dir)
    run = delta_run(STAR, clean, specs(clean["stg_orders"]), plan or {},
                    c.order_bands(clean) if plan else {}, **options)
    return clean, run


def _per_sink(clean, run, sizes=None):
    return dm.sink_damage(clean, run.tables, STAR.sinks, changes=run.changes, base=sizes)


def _stored(spark, sf_dir):
    """The clean snapshot as written tables: a branch reads it many times. The lines are not stored: a
    branch reads those of a few orders, parts and days, and no mart reads their customers."""
    clean = star_tables(spark, sf_dir)
    return STAR.store(clean, c.TOUCHED + ["stg_orders", "fact_order"])


MIXED = c.branch_ctes(c.sql_mixed(), "mixed")
DETAIL = ("mart_order_detail", "mart_order_detail_d", ["orderkey"],
          c.SINK_VALUES["mart_order_detail"])


@query(with_sql(MIXED + [c.sql_sinks()], "select * from sinks"))
def damage_exact(spark, sf_dir):
    clean, run = _branch(spark, sf_dir, stored=True)
    return _per_sink(clean, run)


@query(with_sql(MIXED + ["""
    g as materialized (select orderkey, cust_name, order_date, total_price, sum(c) nc, sum(d) nd from
      (select *, 1 c, 0 d from mart_order_detail union all
       select *, 0, 1 from mart_order_detail_d) group by 1, 2, 3, 4),
    k as (select orderkey, sum(nc) nc, sum(nd) nd, sum(least(nc, nd)) m from g group by 1),
    e as (select nc, nd, least(nc - m, nd - m) ch, m from k),
    t as (select cast(sum(ch) as bigint) changed, cast(sum(nd - m - ch) as bigint) added,
      cast(sum(nc - m - ch) as bigint) lost, cast(sum(nc) as bigint) n_clean from e)"""],
    "select *, cast(2 * changed + added + lost as double) / (2 * n_clean + added - lost) damage from t"))
def damage_multiset(spark, sf_dir):
    clean, run = _branch(spark, sf_dir)
    return dm.exact_damage(clean["mart_order_detail"], run.tables["mart_order_detail"],
                           ("orderkey",), form="multiset")


def _distances(sink: str, dirty: str) -> str:
    """Both distances from one full join by key."""
    s = STAR.sinks[sink]

    def total(pattern: str) -> str:
        return " + ".join(f"({pattern.replace('@', v)})" for v in s.values)

    zero = " or ".join(f"coalesce(c.{v}, 0) = 0" for v in s.values)
    sums = (f"sum({total('abs(coalesce(c.@, 0) - coalesce(d.@, 0))')}) filter (pair) gap, "
            f"sum({total('cast(abs(c.@ - coalesce(d.@, 0)) as double) / nullif(cast(abs(c.@) as double), 0)')}) "
            f"filter (pair and not ({zero})) part, "
            f"sum({total('abs(coalesce(c.@, 0))')}) c_size, sum({total('abs(coalesce(d.@, 0))')}) d_size")
    known = " and ".join(f"{k} is not null" for k in s.key)
    return f"""select '{sink}' sink,
      round(cast(coalesce(sum(gap), 0) + coalesce(sum(c_size) filter (not in_dirty and {known}), 0)
        + coalesce(sum(d_size) filter (not in_clean and {known}), 0) as double)
        / cast((select sum({total('abs(coalesce(@, 0))')}) from {sink}) as double), 12) damage_value_weighted,
      round((coalesce(sum(part), 0) / {len(s.values)} + count(*) filter (not in_dirty)
        + count(*) filter (not in_clean)) / (select count(*) from {sink}), 9) damage_relative_error
      from ({keyed(sink, dirty, list(s.key), list(s.values), sums)})"""


@query(with_sql(MIXED, " union all ".join(_distances(s, s + "_d") for s in c.TOUCHED)))
def damage_distances(spark, sf_dir):
    clean, run = _branch(spark, sf_dir, stored=True)
    sinks = {n: STAR.sinks[n] for n in c.TOUCHED}
    return dm.sink_damage(clean, run.tables, sinks, variants=True).select(
        "sink", F.round("damage_value_weighted", 12).alias("damage_value_weighted"),
        F.round("damage_relative_error", 9).alias("damage_relative_error"))


@query(with_sql(MIXED + [c.sql_sinks()],
                "select kind, round(avg(damage), 12) damage from sinks group by 1 union all "
                "select 'all', round(avg(damage), 12) from sinks"))
def damage_macro_by_kind(spark, sf_dir):
    clean, run = _branch(spark, sf_dir, stored=True)
    per_sink = _per_sink(clean, run)
    return dm.macro_damage(per_sink).select("kind", F.round("damage", 12).alias("damage"))


@query(with_sql(MIXED, """select orderkey, 'changed' change, 1::bigint changed, 0::bigint added,
    0::bigint lost from mart_order_detail c join mart_order_detail_d d using (orderkey)
    where row(c.cust_name, c.order_date, c.total_price) is distinct from
    row(d.cust_name, d.order_date, d.total_price)"""))
def damage_rows_explained(spark, sf_dir):
    clean, run = _branch(spark, sf_dir)
    return dm.explain_rows(clean["mart_order_detail"], run.tables["mart_order_detail"],
                           ("orderkey",))


_DELETED = [c.sql_targets("gone", 40, "case.gone"),
            f"deleted as materialized ({c.sql_delete('stg_orders', 'true', 'gone')})"]


@query(with_sql(c.branch_ctes(_DELETED, "deleted"),
                "select orderkey from mart_order_detail except "
                "select orderkey from mart_order_detail_d"))
def damage_lost_keys(spark, sf_dir):
    clean, run = _branch(spark, sf_dir, specs=lambda o: [c.delete(c.order_targets(o, 40,
                                                                                "case.gone"))])
    return dm.key_difference(clean["mart_order_detail"], run.tables["mart_order_detail"],
                             ("orderkey",))


# --- whole branches ----------------------------------------------------------------------------

COND = c.sql_conditional("mixed")
BRANCH = [*MIXED, *COND, *star_ctes({"stg_orders": "select * from conditional"}, "_p")]
_MEANS = [c.sql_sinks("_d", "s_base"), c.sql_sinks("_p", "s_prot"),
          "m as (select (select avg(damage) from s_base) b, (select avg(damage) from s_prot) p)"]


@query(with_sql(BRANCH + [c.sql_sinks("_p")], "select * from sinks"))
def protected_branch(spark, sf_dir):
    clean, run = _branch(spark, sf_dir, plan={"stg_orders": c.CONDITIONAL}, stored=True)
    return _per_sink(clean, run)


@query(with_sql(BRANCH + _MEANS, """select 'mixed' campaign, 'conditional' as plan,
    round(b, 12) no_validation_damage, round(p, 12) absolute_damage, round(p / b, 9) nrd,
    0.0::double clean_absolute_damage from m"""))
def nrd_branch(spark, sf_dir):
    clean = _stored(spark, sf_dir)
    rows = measure(STAR, clean, "mixed", c.mixed(clean["stg_orders"]),
                   {"conditional": {"stg_orders": c.CONDITIONAL}}, c.order_bands(clean))
    return rows.select("campaign", "plan",
                       F.round("no_validation_damage", 12).alias("no_validation_damage"),
                       F.round("absolute_damage", 12).alias("absolute_damage"),
                       F.round("nrd", 9).alias("nrd"), "clean_absolute_damage")


# A band at half of the maximum fires on clean rows: the price of a tight rule.
_TIGHT = """tight as materialized (select * from stg_orders where total_price <=
    (select max(total_price) * 0.5 from stg_orders))"""


@query(with_sql(c.branch_ctes([_TIGHT], "tight") + [c.sql_sinks()],
                "select round(avg(damage), 12) clean_collateral, bool_and(damage = 0) safe from sinks"))
def clean_collateral(spark, sf_dir):
    clean = _stored(spark, sf_dir)
    low, high = c.order_bands(clean)["stg_orders"]
    run = delta_run(STAR, clean, c.mixed(clean["stg_orders"]),
                        {"stg_orders": {"numeric_shape": "quarantine"}},
                        {"stg_orders": (low, high / 4)}, with_errors=False)
    per_sink = _per_sink(clean, run)
    return per_sink.agg(F.round(F.avg("damage"), 12).alias("clean_collateral"),
                        F.bool_and(F.col("damage") == 0).alias("safe"))


_PARTS = [f"only_num as materialized ({c.sql_numeric('stg_orders', 'position <= 20')})",
          f"only_dup as materialized ({c.sql_duplicate('stg_orders', 'position > 20')})"]


@query(with_sql([*star_ctes(), *c.sql_mixed(), *_PARTS,
                 *star_ctes({"stg_orders": "select * from mixed"}, "_d"),
                 *star_ctes({"stg_orders": "select * from only_num"}, "_n"),
                 *star_ctes({"stg_orders": "select * from only_dup"}, "_u"),
                 c.sql_sinks("_d", "s_mixed"), c.sql_sinks("_n", "s_num"), c.sql_sinks("_u", "s_dup"),
                 "m as (select (select avg(damage) from s_mixed) a, (select avg(damage) from s_num) b,"
                 " (select avg(damage) from s_dup) d)"],
                "select 'num_only' component, round(b, 12) damage, round(b / a, 9) share from m "
                "union all select 'dup_only', round(d, 12), round(d / a, 9) from m"))
def damage_components(spark, sf_dir):
    clean = _stored(spark, sf_dir)
    specs, out = c.mixed(clean["stg_orders"]), None
    sizes = materialize(dm.sink_base(clean, STAR.sinks), "base")
    for name, part in (("mixed", specs), ("num_only", specs[:1]), ("dup_only", specs[1:])):
        run = delta_run(STAR, clean, part, {})
        row = _per_sink(clean, run, sizes).agg(F.avg("damage").alias("damage")) \
            .select(F.lit(name).alias("component"), "damage", F.lit(1).alias("_one"))
        out = row if out is None else out.unionByName(row)
    out = materialize(out, "components")
    whole = out.filter("component = 'mixed'").select("_one", F.col("damage").alias("whole"))
    return out.filter("component <> 'mixed'").join(whole, "_one").select(
        "component", F.round("damage", 12).alias("damage"),
        F.round(ratio("damage", "whole"), 9).alias("share"))


MAGNITUDES = {"inside": 1_000, "near_edge": 400_000, "past_edge": 1_000_000, "far": c.OPERAND}


def _stress_sql() -> str:
    ctes, rows = [*star_ctes(), c.sql_targets("stress", 100, "case.stress")], []
    for name, operand in MAGNITUDES.items():
        ctes += [f"x_{name} as materialized "
                 f"({c.sql_numeric('stg_orders', 'true', operand, 'stress')})",
                 f"y_{name} as materialized ({c.sql_quarantine_numeric(f'x_{name}')})"]
        counts = [damage_sql("stg_orders", f"{a}_{name}", ["orderkey"],
                             ["custkey", "status", "total_price", "order_date", "priority"])
                  for a in "xy"]
        ctes += [f"d_{name} as (select (select damage from ({counts[0]})) b, "
                 f"(select damage from ({counts[1]})) p, (select count(*) from x_{name} "
                 f"where {c.SQL_OUT}) f)"]
        rows.append(f"select '{name}' magnitude, f > 0 detected, f fired, b no_validation_damage, "
                    f"p protected_damage, p / b nrd from d_{name}")
    return with_sql(ctes, " union all ".join(rows))


@query(_stress_sql())
def stress_magnitudes(spark, sf_dir):
    clean = star_tables(spark, sf_dir, "stg_orders", "stg_customer")
    orders, out = clean["stg_orders"], None
    band = c.order_bands({"stg_orders": orders})["stg_orders"]
    targets = c.order_targets(orders, 100, "case.stress")
    for name, operand in MAGNITUDES.items():
        dirty = inject_all(orders, [c.numeric(targets, operand)])
        kept = route_live(dirty, c.ORDERS_RULE, {"numeric_shape": "quarantine"}, band).df
        one = F.lit(1).alias("_one")
        fired = signal_report(dirty, c.ORDERS_RULE, band, clean["stg_customer"]).select(
            F.col("numeric_shape").alias("fired"), one)
        base = dm.exact_damage(orders, dirty, c.ORDER_KEY).select(
            F.col("damage").alias("no_validation_damage"), one)
        prot = dm.exact_damage(orders, kept, c.ORDER_KEY).select(
            F.col("damage").alias("protected_damage"), one)
        row = fired.join(base, "_one").join(prot, "_one").select(
            F.lit(name).alias("magnitude"), (F.col("fired") > 0).alias("detected"), "fired",
            "no_validation_damage", "protected_damage",
            dm.nrd("protected_damage", "no_validation_damage").alias("nrd"))
        out = row if out is None else out.unionByName(row)
    return out


_SHUT = """shut as (select exists (select 1 from mixed group by orderkey having count(*) > 1) shut)"""


@query(with_sql(MIXED + [c.sql_sinks("_d", "s_open"), c.sql_sinks("", "s_stale"), _SHUT], """select 'mixed' campaign,
    case when shut then 1.0e0 else 0.0e0 end availability_loss, (select avg(damage) from (select damage, false stale from
    s_open union all select damage, true from s_stale) where stale = shut) damage, case when shut then 'stg_orders' end
    suppressed_at from shut"""))
def act_fail_closed(spark, sf_dir):
    clean = star_tables(spark, sf_dir)
    run = delta_run(STAR, clean, c.mixed(clean["stg_orders"]),
                        {"stg_orders": {"duplicate_shape": "fail_closed"}}, c.order_bands(clean),
                        scope="chain")
    per_sink = _per_sink(clean, run)
    return per_sink.agg(F.avg("damage").alias("damage")).select(
        F.lit("mixed").alias("campaign"), F.lit(run.availability_loss).alias("availability_loss"),
        "damage", F.lit(run.suppressed_at).alias("suppressed_at"))


MARGINS = (2.0, 0.5)
ARMS = {"withhold": {"numeric_shape": "quarantine"}, "conditional": c.CONDITIONAL}


def _margin_sql() -> str:
    """Every margin with every arm, on the dirty and on the clean orders."""
    ctes, rows = [*MIXED, c.sql_sinks("_d", "s_base")], []
    for i, m in enumerate(MARGINS):
        out = f"(total_price < 0 or total_price > (select max(total_price) * {m} from stg_orders))"
        for arm in ARMS:
            for side, src in (("e", "mixed"), ("k", "stg_orders")):
                name = f"g{i}_{arm}_{side}"
                # nothing is doubled in the clean orders, so a merge leaves them as they are
                rest = c.sql_dedup(src, "orderkey", c.ORDER_COLUMNS) if arm == "conditional" else f"select * from {src}"
                ctes += [f"{name} as materialized (select * from ({rest}) where not coalesce({out}, false))",
                         *star_ctes({"stg_orders": f"select * from {name}"}, f"_{name}"),
                         c.sql_sinks(f"_{name}", f"s_{name}")]
            rows.append(
                f"select cast({m} as double) margin, '{arm}' arm, (select count(*) from stg_orders where {out}) "
                f"clean_fires, round((select avg(damage) from s_g{i}_{arm}_e) / (select avg(damage) from s_base), 9) "
                f"nrd, round((select avg(damage) from s_g{i}_{arm}_k), 12) clean_collateral")
    return with_sql(ctes, " union all ".join(rows))


@query(_margin_sql())
def margin_policy_grid(spark, sf_dir):
    """Per band margin and arm: rows that fire on clean data, NRD, and damage done to clean data."""
    clean = _stored(spark, sf_dir)
    orders, out = clean["stg_orders"], None
    specs = c.mixed(orders)
    sizes, shared = materialize(dm.sink_base(clean, STAR.sinks), "base"), {}
    for m in MARGINS:
        bands = derive_bands({"stg_orders": orders}, {"stg_orders": c.ORDERS_RULE}, m)
        fires = margin_sweep(orders, "total_price", [m]).select("margin", F.col("fired").alias("clean_fires"))
        rows = measure(STAR, clean, "mixed", specs, {a: {"stg_orders": p} for a, p in ARMS.items()}, bands,
                       sizes, fires=shared)
        rows = rows.withColumn("margin", F.lit(m)).join(fires, "margin").select(
            "margin", F.col("plan").alias("arm"), "clean_fires", F.round("nrd", 9).alias("nrd"),
            F.round("clean_absolute_damage", 12).alias("clean_collateral"))
        out = rows if out is None else out.unionByName(rows)
    return out


#: One family of errors for each of two shapes, with what may be done about it.
FAMILIES = {"shifts": ("numeric_shape", ("quarantine", "null_out")),
            "copies": ("duplicate_shape", ("quarantine", "dedup"))}


def _measured_sql() -> str:
    hit = "(select orderkey from fam_copies group by 1 having count(*) > 1)"
    acts = {("shifts", "quarantine"): c.sql_quarantine_numeric("fam_shifts"),
            ("shifts", "null_out"): f"select * replace (case when {c.SQL_OUT} then null else total_price end as "
                                    "total_price) from fam_shifts",
            ("copies", "quarantine"): f"select * from fam_copies where orderkey not in {hit}",
            ("copies", "dedup"): c.sql_dedup("fam_copies", "orderkey", c.ORDER_COLUMNS)}
    ctes = [*star_ctes(), c.sql_targets(),
            f"fam_shifts as materialized ({c.sql_numeric('stg_orders', 'true')})",
            f"fam_copies as materialized ({c.sql_duplicate('stg_orders', 'true')})"]
    rows = []
    for fam, (shape, _) in FAMILIES.items():
        ctes += [*star_ctes({"stg_orders": f"select * from fam_{fam}"}, f"_b_{fam}"), c.sql_sinks(f"_b_{fam}", f"s_{fam}")]
    for (fam, act), sql in acts.items():
        name = f"{fam}_{act}"
        ctes += [f"x_{name} as materialized ({sql})", *star_ctes({"stg_orders": f"select * from x_{name}"}, f"_{name}"),
                 c.sql_sinks(f"_{name}", f"s_{name}")]
        rows.append(f"select 'stg_orders' node, '{FAMILIES[fam][0]}' shape, '{act}' disposition, (select avg(damage) from "
                    f"s_{name}) / (select avg(damage) from s_{fam}) nrd")
    ctes.append("measured as (" + " union all ".join(rows) + ")")
    return with_sql(ctes, """select node, shape, case when nrd < 1 - 1e-12 then disposition else 'no_op' end disposition,
        round(least(nrd, 1.0e0), 9) nrd from measured qualify row_number() over (partition by node, shape order by nrd,
        list_position(['dedup', 'quarantine', 'null_out'], disposition)) = 1""")


@query(_measured_sql())
def measured_policy(spark, sf_dir):
    """The disposition of each shape that follows from measured branches of its own family."""
    clean = _stored(spark, sf_dir)
    targets = c.order_targets(clean["stg_orders"])
    specs = {"shifts": [c.numeric(targets)], "copies": [c.duplicate(targets)]}
    bands, out = c.order_bands(clean), None
    sizes, fires = materialize(dm.sink_base(clean, STAR.sinks), "base"), {}
    for fam, (shape, acts) in FAMILIES.items():
        rows = measure(STAR, clean, fam, specs[fam], {a: {"stg_orders": {shape: a}} for a in acts}, bands, sizes,
                       fires=fires)
        rows = rows.select(F.col("campaign").alias("family"), F.lit(c.K).alias("k"), F.lit("stg_orders").alias("node"),
                           F.col("plan").alias("disposition"), "nrd")
        out = rows if out is None else out.unionByName(rows)
    pure = spark.createDataFrame([(f, s) for f, (s, _) in FAMILIES.items()], "family string, shape string")
    grid = pure.select(F.lit("stg_orders").alias("node"), "shape")
    return derive_policy(out, pure, grid).withColumn("nrd", F.round("nrd", 9))


def _grid_sql() -> str:
    ctes = [*MIXED]
    hit = "(select orderkey from {t} group by 1 having count(*) > 1)"
    kept = ("select * from {t} where orderkey not in " + hit
            + f" and not coalesce({c.SQL_OUT}, false)")
    ctes += [f"quar as materialized ({kept.format(t='mixed')})",
             *star_ctes({"stg_orders": "select * from quar"}, "_q"),
             *star_ctes({"stg_orders": "select * from mixed"}, "_f",
                        acts={"fact_order": kept.format(t="{self}")}),
             c.sql_sinks("_d", "s_base"), c.sql_sinks("_q", "s_q"), c.sql_sinks("_f", "s_f")]
    base = "(select avg(damage) from s_base)"
    rows = [f"select 'mixed' campaign, 'quarantine' as policy, '{p}' placement, round((select "
            f"avg(damage) from {s}) / {base}, 9) nrd, 0.0::double clean_absolute_damage"
            for p, s in (("stg_orders", "s_q"), ("fact_order", "s_f"))]
    return with_sql(ctes, " union all ".join(rows))


@query(_grid_sql())
def placement_measurements(spark, sf_dir):
    clean = _stored(spark, sf_dir)
    grid = placement_grid(STAR, clean, "mixed", c.mixed(clean["stg_orders"]),
                          {"quarantine": {"duplicate_shape": "quarantine",
                                          "numeric_shape": "quarantine",
                                          "conflict": "quarantine"}},
                          ("stg_orders", "fact_order"), c.order_bands(clean))
    return grid.select("campaign", "policy", "placement", F.round("nrd", 9).alias("nrd"),
                       "clean_absolute_damage")
