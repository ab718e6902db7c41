"""Target selection, error injection, signals and dispositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators import dispositions as act
from dqspark.operators import signals as sig
from dqspark.operators import targets as tg
from dqspark.operators.injection import inject, inject_all, injection_report
from dqspark.plans.star import STAR
from dqspark.queries import cases as c
from dqspark.queries.common import plain, star_ctes, star_table, star_tables, with_sql

QUERIES = {}
ORACLES = {}
ORDERS = star_ctes()[:3]                     # stg_part, stg_customer, stg_orders
LINES = star_ctes()[:4]


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn
    return add


def orders_out(src: str, ctes: list[str], where: str = "") -> str:
    return with_sql(ORDERS + ctes, f"select * replace (cast(total_price as double) as total_price, "
                                   f"cast(order_date as varchar) as order_date) from {src} {where}")


# --- targets -----------------------------------------------------------------------------------

@query(with_sql(ORDERS + [c.sql_targets()], "select * from targets"))
def target_hash_topk(spark, sf_dir):
    return c.order_targets(star_table(spark, sf_dir, "stg_orders"))


@query(with_sql(ORDERS + [c.sql_targets()],
                "select *, case when position <= 20 then 'numeric' else 'duplicate' end part "
                "from targets"))
def target_disjoint_split(spark, sf_dir):
    a, b = tg.split_targets(c.order_targets(star_table(spark, sf_dir, "stg_orders")), 20)
    return a.withColumn("part", F.lit("numeric")).unionByName(
        b.withColumn("part", F.lit("duplicate")))


@query(with_sql(ORDERS + [c.sql_targets(), c.sql_targets(
    "fresh", 60, "case.fresh", "where orderkey not in (select orderkey from targets)")],
    "select * from fresh"))
def target_exclude_used(spark, sf_dir):
    orders = star_table(spark, sf_dir, "stg_orders")
    return tg.pick_targets(orders, c.ORDER_KEY, 60, "case.fresh", c.order_targets(orders))


_FAN = """fan as materialized (select s.custkey, count(o.orderkey) n_children from stg_customer s
    left join stg_orders o on o.custkey = s.custkey group by 1),
    pools as materialized (select *, 'low' pool from (select * from fan order by n_children, custkey
    limit 4) union all select *, 'high' pool from (select * from fan order by n_children desc,
    custkey desc limit 4))"""


def _fan(spark, sf_dir):
    t = star_tables(spark, sf_dir, "stg_orders", "stg_customer")
    return tg.fanout(t["stg_customer"], "custkey", t["stg_orders"], "custkey")


@query(with_sql(ORDERS + [_FAN], "select * from fan"))
def target_fanout(spark, sf_dir):
    return _fan(spark, sf_dir)


@query(with_sql(ORDERS + [_FAN], "select * from pools"))
def target_fanout_pools(spark, sf_dir):
    return tg.fanout_pools(_fan(spark, sf_dir), "custkey")


@query(with_sql(ORDERS + [_FAN, """h as (select custkey, sha256('camp.a|' || custkey) a,
    sha256('camp.b|' || custkey) b from pools where pool = 'high'),
    p1 as (select 'camp.a' salt, custkey from h order by a limit 1)"""],
    "select * from p1 union all (select 'camp.b' salt, custkey from h where custkey not in "
    "(select custkey from p1) order by b limit 1)"))
def target_pool_pick(spark, sf_dir):
    pools = tg.fanout_pools(_fan(spark, sf_dir), "custkey")
    return tg.take_from_pool(pools.filter("pool = 'high'"), "custkey", ["camp.a", "camp.b"])


@query("select p_partkey partkey, cast(cast(p_retailprice as decimal(18,2)) as double) retail_price "
       "from part order by 2 desc, 1 limit 1")
def target_argmax_tiebreak(spark, sf_dir):
    part = star_table(spark, sf_dir, "stg_part")
    return plain(tg.argmax_row(part.select("partkey", "retail_price"), "retail_price", "partkey"))


@query("select 'stg_orders' as name, (select count(*) from orders) universe, 40::bigint as excluded union all "
       "select 'stg_part', (select count(*) from part), 0::bigint")
def target_universe(spark, sf_dir):
    t = star_tables(spark, sf_dir, "stg_orders", "stg_part")
    return tg.universe_report({n: t[n] for n in ("stg_orders", "stg_part")},
                              {"stg_orders": c.order_targets(t["stg_orders"])})


# --- injection ---------------------------------------------------------------------------------

def _injected(name, spec, sql):
    def run(spark, sf_dir):
        orders = star_table(spark, sf_dir, "stg_orders")
        return plain(inject(orders, spec(c.order_targets(orders, 100, "case.single"))))
    QUERIES[name] = run
    targets = c.sql_targets("targets", 100, "case.single")
    ORACLES[name] = orders_out(f"({sql('stg_orders', 'true')})", [targets])


_injected("inject_numeric_add", c.numeric, c.sql_numeric)
_injected("inject_duplicate", c.duplicate, c.sql_duplicate)
_injected("inject_null", c.blank, c.sql_blank)
_injected("inject_fk_orphan", c.orphan, c.sql_orphan)
_injected("inject_delete", c.delete, c.sql_delete)


@query(orders_out("mixed", c.sql_mixed()))
def inject_mixed(spark, sf_dir):
    orders = star_table(spark, sf_dir, "stg_orders")
    return plain(inject_all(orders, c.mixed(orders)))


@query("with n as (select count(*) n from orders) select 'stg_orders' node, m mode, 100::bigint targets, "
       "100::bigint hits, n rows_before, n + d rows_after, d::bigint expected_delta, true ok from n, "
       "(values ('numeric_add', 0), ('duplicate_rows', 100), ('delete_rows', -100)) v(m, d)")
def inject_report(spark, sf_dir):
    orders = star_table(spark, sf_dir, "stg_orders")
    t = c.order_targets(orders, 100, "case.single")
    a, b, d = (injection_report(orders, s(t)) for s in (c.numeric, c.duplicate, c.delete))
    return a.unionByName(b).unionByName(d)


# --- signals -----------------------------------------------------------------------------------

_LOOSE = "orderkey, partkey, suppkey, linenumber"


@query(with_sql(LINES, f"select {_LOOSE}, count(*) over (partition by orderkey, linenumber) > 1 "
                       "duplicate_shape from stg_lineitem"))
def signal_duplicate(spark, sf_dir):
    lines = star_table(spark, sf_dir, "stg_lineitem").select(*_LOOSE.split(", "))
    return sig.flag_shape(lines, c.LOOSE_LINE, "duplicate_shape")


@query("select doc_id, count(*) over (partition by text) > 1 duplicate_shape from documents")
def signal_duplicate_text(spark, sf_dir):
    docs = spark.read.schema("doc_id bigint, text string").parquet(f"{sf_dir}/documents.parquet")
    keyed = docs.select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("n"))
    return sig.flag_shape(keyed, sig.Rule(("digest", "n")), "duplicate_shape").select(
        "doc_id", "duplicate_shape")


@query(with_sql(LINES, f"select {_LOOSE}, cast(extended_price as double) extended_price from "
                       "stg_lineitem where extended_price is not null and (extended_price < 1000 "
                       "or extended_price > (select max(extended_price) * 0.5 from stg_lineitem))"))
def signal_numeric_band(spark, sf_dir):
    lines = star_table(spark, sf_dir, "stg_lineitem")
    rule = STAR.rules["stg_lineitem"]
    top = sig.derive_bands({"stg_lineitem": lines}, {"stg_lineitem": rule}, 0.5)["stg_lineitem"][1]
    hit = sig.flag_shape(lines, rule, "numeric_shape", (1000, top)).filter("numeric_shape")
    return plain(hit.select(*_LOOSE.split(", "), "extended_price"))


def _four(spark, sf_dir):
    t = star_tables(spark, sf_dir, "stg_orders", "stg_customer")
    t["dirty"] = inject_all(t["stg_orders"], c.four_shapes(t["stg_orders"]))
    t["band"] = c.order_bands({"stg_orders": t["stg_orders"]})["stg_orders"]
    return t


_FLAGS = f"""flags as materialized (select orderkey, count(*) over (partition by orderkey) > 1
    duplicate_shape, coalesce({c.SQL_OUT}, false) numeric_shape, total_price is null null_shape,
    custkey is not null and custkey not in (select custkey from stg_customer
    where custkey is not null) fk_shape from four)"""
_COUNTS = ", ".join(f"count(*) filter ({s}) {s}" for s in sig.SHAPES)


@query(with_sql(ORDERS + c.sql_four(), "select orderkey from four where total_price is null"))
def signal_null(spark, sf_dir):
    return sig.flag_shape(_four(spark, sf_dir)["dirty"], c.ORDERS_RULE, "null_shape").filter(
        "null_shape").select("orderkey")


@query(with_sql(ORDERS + c.sql_four() + [_FLAGS], "select orderkey, fk_shape from flags"))
def signal_fk(spark, sf_dir):
    t = _four(spark, sf_dir)
    return sig.flag_shape(t["dirty"], c.ORDERS_RULE, "fk_shape", parent=t["stg_customer"]).select(
        "orderkey", "fk_shape")


@query(with_sql(ORDERS + c.sql_four() + [_FLAGS], "select * from flags"))
def signal_flags(spark, sf_dir):
    t = _four(spark, sf_dir)
    return sig.flag(t["dirty"], c.ORDERS_RULE, t["band"], t["stg_customer"]).select(
        "orderkey", *sig.SHAPES)


@query(with_sql(ORDERS + c.sql_four() + [_FLAGS],
                f"select count(*) n_rows, {_COUNTS}, 'multi' verdict from flags"))
def signal_report(spark, sf_dir):
    t = _four(spark, sf_dir)
    return sig.signal_report(t["dirty"], c.ORDERS_RULE, t["band"], t["stg_customer"])


@query(with_sql(ORDERS + c.sql_four() + [_FLAGS],
                "select (select count(*) from flags) n_rows, "
                + ", ".join(f"count(distinct orderkey) filter ({s}) {s}" for s in sig.SHAPES)
                + ", 'multi' verdict from flags"))
def signal_report_keys(spark, sf_dir):
    t = _four(spark, sf_dir)
    return sig.signal_report(t["dirty"], c.ORDERS_RULE, t["band"], t["stg_customer"], unit="keys")


_VERDICT = """with f as (select count(*) over (partition by orderkey) > 1 d, coalesce({out}, false) n
    from {src}), s as (select bool_or(d) d, bool_or(n) n from f)
    select '{src}' as name, case when d and n then 'conflict' when d then 'duplicate_shape'
    when n then 'numeric_shape' else 'clear' end verdict from s"""


@query(with_sql(ORDERS + c.sql_mixed(), " union all ".join(
    f"({_VERDICT.format(out=c.SQL_OUT, src=s)})" for s in ("stg_orders", "m1", "mixed"))))
def signal_verdict(spark, sf_dir):
    orders = star_table(spark, sf_dir, "stg_orders")
    band = c.order_bands({"stg_orders": orders})["stg_orders"]
    specs, out = c.mixed(orders), None
    for name, df in (("stg_orders", orders), ("m1", inject(orders, specs[0])),
                     ("mixed", inject_all(orders, specs, strict=False))):
        row = sig.two_signal_verdict(sig.signal_report(
            df, sig.Rule(c.ORDER_KEY, "total_price"), band, unit="keys")).select(
            F.lit(name).alias("name"), "verdict")
        out = row if out is None else out.unionByName(row)
    return out


@query(with_sql(LINES, """select orderkey, linenumber from stg_lineitem group by 1, 2
    having count(*) > 1 union select orderkey, linenumber from stg_lineitem where
    extended_price > (select max(extended_price) * 0.9 from stg_lineitem)"""))
def signal_detected_keys(spark, sf_dir):
    lines = star_table(spark, sf_dir, "stg_lineitem")
    bands = sig.derive_bands({"l": lines}, {"l": c.LOOSE_LINE}, 0.9)
    return sig.detected_keys(lines, sig.Rule(c.LOOSE_LINE.key, "extended_price"), bands["l"])


@query(with_sql(LINES, """select orderkey, linenumber, true truncated from stg_lineitem group by 1, 2
    having count(*) > 1 order by 1, 2 limit 32"""))
def signal_key_sample(spark, sf_dir):
    lines = star_table(spark, sf_dir, "stg_lineitem")
    return sig.key_sample(sig.duplicate_keys(lines, c.LOOSE_LINE.key), c.LOOSE_LINE.key)


@query(with_sql(ORDERS + c.sql_four() + [_FLAGS], " union all ".join(
    f"select '{s}' shape, count(*) filter ({s}) fired, count(*) n_rows, "
    f"count(*) filter ({s}) / cast(count(*) as double) rate from flags" for s in sig.SHAPES)))
def signal_fire_rates(spark, sf_dir):
    t = _four(spark, sf_dir)
    return sig.fire_rates(t["dirty"], c.ORDERS_RULE, t["band"], t["stg_customer"])


# --- bands -------------------------------------------------------------------------------------

@query(with_sql(star_ctes(), " union all ".join(
    f"select '{n}' as name, '{r.numeric}' as numeric, 0.0::double low, "
    f"cast(max({r.numeric}) as double) * 2 high from {n}"
    for n, r in STAR.rules.items() if r.numeric)))
def band_derive(spark, sf_dir):
    return sig.band_table(star_tables(spark, sf_dir, *STAR.rules), STAR.rules)


@query(with_sql(LINES, """select m::double margin, count(*) filter (extended_price < 0 or
    cast(extended_price as double) > m::double * (select cast(max(extended_price) as double)
    from stg_lineitem)) fired, count(*) n_rows, count(*) filter (extended_price < 0 or
    cast(extended_price as double) > m::double * (select cast(max(extended_price) as double)
    from stg_lineitem)) / cast(count(*) as double) rate
    from stg_lineitem, (values (2.0), (1.0), (0.5), (0.2), (0.05)) v(m) group by m"""))
def band_margin_sweep(spark, sf_dir):
    lines = star_table(spark, sf_dir, "stg_lineitem")
    return sig.margin_sweep(lines, "extended_price", [2.0, 1.0, 0.5, 0.2, 0.05])


@query("""with s as (select o_custkey k, sum(cast(o_totalprice as decimal(18,2))) v,
    o_orderdate <= timestamp '1999-12-31' early from orders group by 1, 3),
    t as (select cast(max(v) filter (early) as double) a, cast(max(v) filter (not early) as double) b
    from s) select 'spend' as name, m::double margin, a train_max, b later_max,
    b > a * m::double false_fires from t, (values (1.2), (1.0), (0.5), (2.0)) v(m)""")
def band_drift(spark, sf_dir):
    orders = star_table(spark, sf_dir, "stg_orders")
    spend = orders.groupBy("custkey", (F.col("order_date") <= F.lit("1999-12-31").cast("date"))
                           .alias("early")).agg(F.sum("total_price").alias("v"))
    return sig.band_drift(spend.filter("early"), spend.filter("not early"), "spend", "v",
                          [1.2, 1.0, 0.5, 2.0])


# --- dispositions ------------------------------------------------------------------------------

_LINE_OUT = ("select * replace (cast(quantity as double) as quantity, cast(extended_price as double) "
             "as extended_price, cast(discount as double) as discount, cast(ship_date as varchar) as "
             "ship_date) from ")
_TWICE = "(select *, count(*) over (partition by orderkey, linenumber) n from stg_lineitem)"


def _loose(spark, sf_dir):
    return sig.flag_shape(star_table(spark, sf_dir, "stg_lineitem"), c.LOOSE_LINE,
                          "duplicate_shape")


@query(with_sql(LINES, f"{_LINE_OUT} (select * exclude n from {_TWICE} where n = 1)"))
def act_quarantine(spark, sf_dir):
    return plain(act.quarantine(_loose(spark, sf_dir), "duplicate_shape")[0].drop(
        "duplicate_shape"))


@query(with_sql(LINES, f"{_LINE_OUT} (select * exclude n from {_TWICE} where n > 1)"))
def act_quarantined_rows(spark, sf_dir):
    return plain(act.quarantine(_loose(spark, sf_dir), "duplicate_shape")[1].drop(
        "duplicate_shape"))


_LINE_COLUMNS = ("orderkey, partkey, suppkey, linenumber, quantity, extended_price, discount, "
                 "ship_date, return_flag, line_status")


@query(with_sql(LINES, f"{_LINE_OUT} ({c.sql_dedup('stg_lineitem', 'orderkey, linenumber', _LINE_COLUMNS)})"))
def act_dedup_all(spark, sf_dir):
    return plain(act.dedup(star_table(spark, sf_dir, "stg_lineitem"), c.LOOSE_LINE.key))


@query(with_sql(LINES + [
    "hit as materialized (select orderkey, linenumber from stg_lineitem where extended_price > "
    "(select max(extended_price) * 0.5 from stg_lineitem))",
    "touched as materialized (select * from stg_lineitem where (orderkey, linenumber) in "
    "(select orderkey, linenumber from hit))"],
    f"{_LINE_OUT} (select * from stg_lineitem where (orderkey, linenumber) not in "
    f"(select orderkey, linenumber from hit) union all "
    f"{c.sql_dedup('touched', 'orderkey, linenumber', _LINE_COLUMNS)})"))
def act_dedup_detected(spark, sf_dir):
    lines = star_table(spark, sf_dir, "stg_lineitem")
    bands = sig.derive_bands({"l": lines}, {"l": c.LOOSE_LINE}, 0.5)
    rule = sig.Rule(c.LOOSE_LINE.key, "extended_price")
    state = act.route_snapshot(lines, rule, {"numeric_shape": "dedup"}, bands["l"])
    return plain(state.df)


@query(with_sql(LINES, f"""{_LINE_OUT} (select * replace (case when extended_price >
    (select max(extended_price) * 0.5 from stg_lineitem) then null else extended_price end
    as extended_price) from stg_lineitem)"""))
def act_null_out(spark, sf_dir):
    lines = star_table(spark, sf_dir, "stg_lineitem")
    rule = STAR.rules["stg_lineitem"]
    band = sig.derive_bands({"l": lines}, {"l": rule}, 0.5)["l"]
    return plain(act.null_out(lines, "extended_price", sig.outside("extended_price", band)))


@query(orders_out("mixed", c.sql_mixed(),
                  "where orderkey not in (select orderkey from targets)"))
def act_oracle_targets(spark, sf_dir):
    orders = star_table(spark, sf_dir, "stg_orders")
    dirty = inject_all(orders, c.mixed(orders))
    state = act.route_live(dirty, c.ORDERS_RULE, {"duplicate_shape": "quarantine"},
                           targets=c.order_targets(orders))
    return plain(state.df)


def _overlap(spark, sf_dir):
    t = star_tables(spark, sf_dir, "stg_orders", "stg_customer")
    dirty = inject_all(t["stg_orders"], c.overlap(t["stg_orders"]))
    return dirty, c.order_bands({"stg_orders": t["stg_orders"]})["stg_orders"], t["stg_customer"]


@query(orders_out("conditional", c.sql_overlap() + c.sql_conditional("overlap")))
def route_live(spark, sf_dir):
    dirty, band, parent = _overlap(spark, sf_dir)
    return plain(act.route_live(dirty, c.ORDERS_RULE, c.CONDITIONAL, band, parent).df)


@query(with_sql(ORDERS + c.sql_overlap() + c.sql_quarantine_all("overlap"), f"""
    select 'duplicate_shape' shape, count(*) fired from overlap where orderkey in (select orderkey
      from overlap group by 1 having count(*) > 1)
    union all select 'numeric_shape', count(*) from qa1 where {c.SQL_OUT}
    union all select 'null_shape', count(*) from qa2 where total_price is null
    union all select 'fk_shape', count(*) from qa3 where custkey not in
      (select custkey from stg_customer)"""))
def route_live_fired(spark, sf_dir):
    dirty, band, parent = _overlap(spark, sf_dir)
    state = act.route_live(dirty, c.ORDERS_RULE, c.QUARANTINE_ALL, band, parent, count=True)
    return spark.createDataFrame(list(state.fired.items()), "shape string, fired bigint")


@query(with_sql(ORDERS + c.sql_overlap(), f"""
    select 'duplicate_shape' shape, 'dedup' disposition, 10::bigint keys_affected,
      10::bigint rows_deleted, 0::bigint cells_nulled union all
    select 'numeric_shape', 'quarantine', count(distinct orderkey), count(distinct orderkey), 0
      from overlap where {c.SQL_OUT}"""))
def action_report(spark, sf_dir):
    dirty, band, parent = _overlap(spark, sf_dir)
    return act.action_report(dirty, c.ORDERS_RULE, c.CONDITIONAL, band, parent)


@query(orders_out("overlap", c.sql_overlap(), f"""where orderkey not in (select orderkey from overlap
    group by 1 having count(*) > 1) and not coalesce({c.SQL_OUT}, false)"""))
def route_snapshot(spark, sf_dir):
    dirty, band, parent = _overlap(spark, sf_dir)
    return plain(act.route_snapshot(dirty, c.ORDERS_RULE, c.QUARANTINE_ALL, band, parent).df)


@query(orders_out("mixed", c.sql_mixed(), f"""where orderkey not in (select orderkey from mixed
    group by 1 having count(*) > 1) and not coalesce({c.SQL_OUT}, false)"""))
def route_verdict(spark, sf_dir):
    orders = star_table(spark, sf_dir, "stg_orders")
    dirty = inject_all(orders, c.mixed(orders))
    band = c.order_bands({"stg_orders": orders})["stg_orders"]
    policy = {"duplicate_shape": "dedup", "numeric_shape": "quarantine", "conflict": "quarantine"}
    return plain(act.route_verdict(dirty, c.ORDERS_RULE, policy, band)[0].df)



