"""Temporal and closed snapshots, digests, load checks and the generic test suite."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators import snapshots as sn
from dqspark.operators import suite as st
from dqspark.operators.injection import inject_all
from dqspark.operators.signals import signal_report
from dqspark.queries import cases as c
from dqspark.queries.common import (plain, read, star_ctes, star_table, star_tables, with_sql)
from dqspark.session import materialize
from dqspark.sources.manifest import load_manifest, load_profile

QUERIES = {}
ORACLES = {}
ORDERS = star_ctes()[:3]


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn
    return add


def _run_sql(table: str, time: str) -> str:
    return (f"(select t, n, sum(n) over (order by t) running, (select count(*) from {table}) total "
            f"from (select {time} t, count(*) n from {table} where {time} is not null group by 1))")


def _cut_sql(name: str, table: str, time: str, q: float) -> str:
    run = _run_sql(table, time)
    return (f"select '{name}' as name, t, cast(running as bigint) running, total from {run} where "
            f"running <= {q}::double * total or running = (select min(running) from {run}) "
            f"qualify row_number() over (order by t desc) = 1")


@query(f"select cast(t as varchar) t, n, cast(running as bigint) running, total "
       f"from {_run_sql('orders', 'cast(o_orderdate as date)')}")
def cut_running_counts(spark, sf_dir):
    return plain(sn.running_counts(star_table(spark, sf_dir, "stg_orders"), "order_date"))


@query(f"select cast(t as varchar) cut, running train_rows, total total_rows, total - running "
       f"validation_rows from ({_cut_sql('e', 'events', 'ts', 0.8)})")
def cut_quantile(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return sn.cut_point(events, "ts", 0.8).select(
        F.date_format("cut", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("cut"), "train_rows",
        "total_rows", "validation_rows")


# Times go missing on one side of the data: orders of status P carry none here.
_TIMES = """ot as materialized (select orderkey, case when status = 'P' then null else order_date end t
    from stg_orders)"""


@query(with_sql(ORDERS + [_TIMES, f"cut as ({_cut_sql('o', 'ot', 't', 0.6)})"],
                """select orderkey, 'train' side from ot where not coalesce(not (t <=
    (select t from cut)), false) union all select orderkey, 'validation' from ot where
    not coalesce(not (t > (select t from cut)), false)"""))
def split_temporal(spark, sf_dir):
    orders = star_table(spark, sf_dir, "stg_orders").select(
        "orderkey", F.when(F.col("status") != "P", F.col("order_date")).alias("t"))
    cut = sn.cut_point(orders, "t", 0.6).first()["cut"]
    train, later = sn.temporal_split(orders, "t", cut)
    return train.select("orderkey", F.lit("train").alias("side")).unionByName(
        later.select("orderkey", F.lit("validation").alias("side")))


@query(with_sql(star_ctes()[:4], "select name, cast(t as varchar) cut, running train_rows, total - "
                "running validation_rows, total total_rows, running / cast(total as double) "
                "train_share from (" + _cut_sql("orders", "stg_orders", "order_date", 0.8)
                + ") union all select name, cast(t as varchar), running, total - running, total, "
                "running / cast(total as double) from ("
                + _cut_sql("lineitem", "stg_lineitem", "ship_date", 0.8) + ")"))
def split_manifest(spark, sf_dir):
    t = star_tables(spark, sf_dir, "stg_orders", "stg_lineitem")
    return sn.split_manifest({"orders": (t["stg_orders"], "order_date"),
                              "lineitem": (t["stg_lineitem"], "ship_date")}, 0.8)


CUTOFF = "1996-06-01"
REFS = (("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("customer", "c_custkey", "orders", "o_custkey"),
        ("part", "p_partkey", "lineitem", "l_partkey"),
        ("supplier", "s_suppkey", "lineitem", "l_suppkey"))
AUDIT = {
    "lineitem_without_order": ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    "orders_without_customer": ("orders", "o_custkey", "customer", "c_custkey"),
    "lineitem_without_part": ("lineitem", "l_partkey", "part", "p_partkey"),
    "lineitem_without_supplier": ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    "customers_without_order": ("customer", "c_custkey", "orders", "o_custkey"),
    "parts_without_line": ("part", "p_partkey", "lineitem", "l_partkey"),
    "suppliers_without_line": ("supplier", "s_suppkey", "lineitem", "l_suppkey"),
}
_CLOSED = [f"c_orders as materialized (select * from orders where o_orderdate < date '{CUTOFF}')"] + [
    f"c_{t} as materialized (select * from {t} x where exists (select 1 from c_{o} o "
    f"where o.{oc} = x.{col}))" for t, col, o, oc in REFS]


def _closed(spark, sf_dir):
    tables = {t: read(spark, sf_dir, t)
              for t in ("orders", "lineitem", "customer", "part", "supplier")}
    return tables, sn.closed_snapshot(tables, "orders", "o_orderdate",
                                      F.lit(CUTOFF).cast("timestamp_ntz"), REFS)


@query(with_sql(_CLOSED, " union all ".join(
    f"select '{t}' as name, count(*) as rows, 0::bigint late, true not_empty from c_{t}"
    for t in ("orders", "lineitem", "customer", "part", "supplier"))))
def snapshot_closure(spark, sf_dir):
    _, closed = _closed(spark, sf_dir)
    return sn.snapshot_guard(closed, "orders", "o_orderdate", F.lit(CUTOFF).cast("timestamp_ntz"))


def _audit_sql(prefix: str) -> str:
    return " union all ".join(
        f"select '{n}' as \"check\", count(*) orphans from {prefix}{t} x where not exists "
        f"(select 1 from {prefix}{o} o where o.{oc} = x.{col})"
        for n, (t, col, o, oc) in AUDIT.items())


@query(with_sql(_CLOSED, _audit_sql("c_")))
def closure_audit(spark, sf_dir):
    return sn.closure_audit(_closed(spark, sf_dir)[1], AUDIT)


@query(_audit_sql(""))
def closure_audit_open(spark, sf_dir):
    return sn.closure_audit(_closed(spark, sf_dir)[0], AUDIT)


def _digest_sql(columns: list[tuple[str, str, str]], table: str) -> str:
    parts = " || '|' || ".join(
        f"coalesce('{tag}:' || length({text}) || ':' || {text}, 'null')" for _, tag, text in columns)
    names = ",".join(n for n, _, _ in columns)
    return (f"with h as (select sha256({parts}) h from {table}), n as (select ('0x' || "
            f"substr(h, 1, 15))::bigint a, ('0x' || substr(h, 16, 15))::bigint b from h) select "
            f"'{names}' as columns, count(*) as rows, cast(sum(a) as varchar) sum_high, "
            f"cast(sum(b) as varchar) sum_low, bit_xor(a) xor_high from n")


@query(_digest_sql([
    ("orderkey", "int", "cast(o_orderkey as varchar)"),
    ("custkey", "int", "cast(o_custkey as varchar)"), ("status", "str", "o_orderstatus"),
    ("total_price", "decimal", "cast(cast(o_totalprice as decimal(18,2)) as varchar)"),
    ("order_date", "date", "cast(cast(o_orderdate as date) as varchar)"),
    ("priority", "str", "o_orderpriority")], "orders"))
def table_digest(spark, sf_dir):
    return sn.digest(star_table(spark, sf_dir, "stg_orders"))


@query(_digest_sql([
    ("doc_id", "int", "cast(doc_id as varchar)"), ("text", "str", "text"), ("lang", "str", "lang"),
    ("source", "str", "source"), ("n_chars", "int", "cast(n_chars as varchar)")], "documents"))
def table_digest_text(spark, sf_dir):
    docs = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return sn.digest(spark.read.schema(docs).parquet(f"{sf_dir}/documents.parquet"))


@query("""select identity, bool_and(claimed = counted) matches, count(*) filter (claimed <> counted) different from (
    select 'lines by order' as identity, 'orders' as "name", count(distinct l_orderkey) claimed, (select count(*) from orders)
    counted from lineitem union all select 'lines by order', 'customer', count(distinct c_custkey), count(*) from customer
    union all select 'orders by customer', 'orders', count(*), count(*) from orders union all select 'orders by customer',
    'customer', count(distinct o_custkey), (select count(*) from customer) from orders) group by 1""")
def snapshot_identity(spark, sf_dir):
    """Row counts claimed by referring tables: orders that have lines, and customers that have orders."""
    tables = {t: read(spark, sf_dir, t) for t in ("orders", "customer")}
    lines = read(spark, sf_dir, "lineitem")
    claims = (("lines by order", "orders", lines.agg(F.count_distinct("l_orderkey"))),
              ("lines by order", "customer", tables["customer"].agg(F.count_distinct("c_custkey"))),
              ("orders by customer", "orders", tables["orders"].agg(F.count(F.lit(1)))),
              ("orders by customer", "customer", tables["orders"].agg(F.count_distinct("o_custkey"))))
    out = None
    for identity, name, n in claims:
        row = n.toDF("rows").select(F.lit(identity).alias("identity"), F.lit(name).alias("name"), "rows")
        out = row if out is None else out.unionByName(row)
    return sn.same_identity(tables, out)


# --- load checks -------------------------------------------------------------------------------

@query("""select 'orders' as "table", 'orders.parquet' as file, (select count(*) from orders) as rows,
    0::bigint rejected, 'ok' status union all select 'customer', 'customer.parquet',
    (select count(*) from customer), 0, 'ok' union all select 'events', 'events.parquet',
    (select count(*) from events), 0, 'ok' union all select 'invoices', 'invoices.parquet', 0, 0, 'missing'""")
def load_manifest_report(spark, sf_dir):
    tables = {t: (f"{t}.parquet", read(spark, sf_dir, t)) for t in ("orders", "customer", "events")}
    return load_manifest(spark, {**tables, "invoices": ("invoices.parquet", None)})


@query("""select 'orders' as "table", count(*) as rows, strftime(min(o_orderdate), '%Y-%m-%d') first,
    strftime(max(o_orderdate), '%Y-%m-%d') last, true ok from orders union all
    select 'lineitem', count(*), strftime(min(l_shipdate), '%Y-%m-%d'),
    strftime(max(l_shipdate), '%Y-%m-%d'), true from lineitem union all
    select 'no_dates', count(*), null, null, false from part""")
def load_profiles(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.lit(None).cast("date").alias("d"))
    return load_profile({"orders": (read(spark, sf_dir, "orders"), "o_orderdate"),
                         "lineitem": (read(spark, sf_dir, "lineitem"), "l_shipdate"),
                         "no_dates": (part, "d")})


# --- generic suite -----------------------------------------------------------------------------

@query("""select l_orderkey as "value", count(*) n from lineitem group by 1 having count(*) > 1""")
def suite_unique(spark, sf_dir):
    return st.unique(read(spark, sf_dir, "lineitem"), "l_orderkey")


@query(with_sql(ORDERS + c.sql_four(), "select orderkey from four where total_price is null"))
def suite_not_null(spark, sf_dir):
    orders = star_table(spark, sf_dir, "stg_orders")
    return st.not_null(inject_all(orders, c.four_shapes(orders)), "total_price").select("orderkey")


@query(with_sql(ORDERS + c.sql_four(), "select orderkey, custkey from four where custkey is not null "
                                       "and custkey not in (select custkey from stg_customer)"))
def suite_relationships(spark, sf_dir):
    t = star_tables(spark, sf_dir, "stg_orders", "stg_customer")
    dirty = inject_all(t["stg_orders"], c.four_shapes(t["stg_orders"]))
    return st.relationships(dirty, "custkey", t["stg_customer"], "custkey").select(
        "orderkey", "custkey")


@query("""select event_type as "value", count(*) n from events
    where event_type not in ('view', 'click', 'purchase') group by 1""")
def suite_accepted_values(spark, sf_dir):
    return st.accepted_values(read(spark, sf_dir, "events"), "event_type",
                              ["view", "click", "purchase"])


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem
    where not (l_extendedprice >= 1000 * l_quantity * (1 - l_discount))""")
def suite_expression(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    return st.expression_is_true(
        lines, "l_extendedprice >= 1000 * l_quantity * (1 - l_discount)").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


_SUITE = ("unique_orderkey", "not_null_total", "customer_known", "status_accepted")


@query(with_sql(ORDERS + c.sql_four(), """
    select 'unique_orderkey' test, count(*) failing_rows, count(*) > 0 fails from (select orderkey
      from four group by 1 having count(*) > 1) union all
    select 'not_null_total', count(*), count(*) > 0 from four where total_price is null union all
    select 'customer_known', count(*), count(*) > 0 from four where custkey not in
      (select custkey from stg_customer) union all
    select 'status_accepted', count(distinct status), count(*) > 0 from four
      where status not in ('O', 'F', 'P')"""))
def suite_run(spark, sf_dir):
    t = star_tables(spark, sf_dir, "stg_orders", "stg_customer")
    dirty = inject_all(t["stg_orders"], c.four_shapes(t["stg_orders"]))
    return st.run_suite(_tests(dirty, t["stg_customer"]))


def _tests(orders, customers):
    return dict(zip(_SUITE, (st.unique(orders, "orderkey"), st.not_null(orders, "total_price"),
                             st.relationships(orders, "custkey", customers, "custkey"),
                             st.accepted_values(orders, "status", ["O", "F", "P"]))))


_IN_BAND = ("shifted as materialized (" + c.sql_numeric("stg_orders", "true", 1000) + ")")


_CASES = {"clean": "stg_orders", "mixed": "mixed", "copied": "copied", "shifted": "shifted", "far": "far"}


def _agree_sql() -> str:
    """Every test of the suite and every rule on every case, written alike for each."""
    rows = []
    for case, src in _CASES.items():
        many = f"(select count(*) from (select 1 from {src} group by orderkey having count(*) > 1))"
        fired = (f"({many} > 0 or exists (select 1 from {src} where {c.SQL_OUT}) or exists (select 1 from {src} "
                 f"where total_price is null) or exists (select 1 from {src} where custkey not in "
                 "(select custkey from stg_customer)))")
        tests = {
            "unique_orderkey": many,
            "not_null_total": f"(select count(*) from {src} where total_price is null)",
            "customer_known": f"(select count(*) from {src} where custkey not in (select custkey from stg_customer))",
            "status_accepted": f"(select count(distinct status) from {src} where status not in ('O', 'F', 'P'))",
            "identity": f"(select count(*) from {src} s join stg_orders o using (orderkey) "
                        "where s.total_price <> o.total_price)"}
        rows += [f"select '{case}' as \"case\", '{test}' test, {n} failing_rows, {fired} fired" for test, n in tests.items()]
    copied = f"copied as materialized ({c.sql_duplicate('stg_orders', 'true')})"
    far = f"far as materialized ({c.sql_numeric('stg_orders', 'true')})"
    every = " union all ".join(rows)
    return with_sql(ORDERS + c.sql_mixed() + [_IN_BAND, copied, far, f"every_test as ({every})"], """
        select *, case when fired and bool_or(failing_rows > 0) over (partition by "case") then 'both' when fired
        then 'contract only' when bool_or(failing_rows > 0) over (partition by "case") then 'suite only'
        else 'none' end seen_by from every_test""")


@query(_agree_sql())
def suite_agreement(spark, sf_dir):
    """The whole suite, an accounting identity (the total equals its booked value) among its
    tests, and all rules on every case: a copy is seen by both, a shift inside the band only by
    the identity, a far shift by the band and the identity."""
    t = star_tables(spark, sf_dir, "stg_orders", "stg_customer")
    orders = t["stg_orders"]
    band = c.order_bands({"stg_orders": orders})["stg_orders"]
    targets = c.order_targets(orders)
    cases = {"clean": orders, "mixed": inject_all(orders, c.mixed(orders)),
             "copied": inject_all(orders, [c.duplicate(targets)]),
             "shifted": inject_all(orders, [c.numeric(targets, 1000)]),
             "far": inject_all(orders, [c.numeric(targets)])}
    booked = orders.select("orderkey", F.col("total_price").alias("booked"))
    signals = suite = None
    for name, df in cases.items():
        s = signal_report(df, c.ORDERS_RULE, band, t["stg_customer"]).select(
            F.lit(name).alias("case"), (F.col("verdict") != "clear").alias("fired"))
        tests = _tests(df, t["stg_customer"]) | {"identity": st.expression_is_true(
            df.join(booked, "orderkey"), "total_price = booked")}
        r = st.run_suite(tests).select(F.lit(name).alias("case"), "test", "failing_rows", "fails")
        signals = s if signals is None else signals.unionByName(s)
        suite = r if suite is None else suite.unionByName(r)
    suite = materialize(suite, "suite")
    seen = st.agreement(signals, suite)
    return suite.drop("fails").join(signals, "case").join(seen, "case")
