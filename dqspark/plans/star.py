"""The lineage built over the supplied order star schema: staging, dimensions, facts, marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dqspark.functions.scalars import mean4, money
from dqspark.functions.skew import lookup_join
from dqspark.operators.signals import Rule
from dqspark.plans.lineage import Lineage, Node, Sink, Tables, cut

# Declared, so that opening a table costs no schema pass.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.schema(s).parquet(f"{sf_dir}/{t}.parquet") for t, s in SCHEMAS.items()}


def stg_part(t: Tables) -> DataFrame:
    return t["part"].select(
        F.col("p_partkey").alias("partkey"), F.col("p_name").alias("part_name"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("part_type"),
        F.col("p_size").alias("size"), money("p_retailprice").alias("retail_price"))


def stg_customer(t: Tables) -> DataFrame:
    return t["customer"].select(
        F.col("c_custkey").alias("custkey"), F.col("c_name").alias("cust_name"),
        F.col("c_nationkey").alias("nationkey"), money("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("segment"))


def stg_orders(t: Tables) -> DataFrame:
    return t["orders"].select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"),
        F.col("o_orderstatus").alias("status"), money("o_totalprice").alias("total_price"),
        F.to_date("o_orderdate").alias("order_date"), F.col("o_orderpriority").alias("priority"))


def stg_lineitem(t: Tables) -> DataFrame:
    return t["lineitem"].select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"), F.col("l_linenumber").alias("linenumber"),
        money("l_quantity").alias("quantity"), money("l_extendedprice").alias("extended_price"),
        money("l_discount").alias("discount"), F.to_date("l_shipdate").alias("ship_date"),
        F.col("l_returnflag").alias("return_flag"), F.col("l_linestatus").alias("line_status"))


def stg_event(t: Tables) -> DataFrame:
    return t["events"].select(
        "event_id", "user_id", "event_type", money("value").alias("value"),
        F.to_date("ts").alias("event_date"))


def dim_customer(t: Tables) -> DataFrame:
    nation = t["nation"].select(F.col("n_nationkey").alias("nationkey"),
                                F.col("n_name").alias("nation_name"), "n_regionkey")
    region = t["region"].select(F.col("r_regionkey").alias("n_regionkey"),
                                F.col("r_name").alias("region_name"))
    named = lookup_join(t["stg_customer"], nation, ["nationkey"])
    return lookup_join(named, region, ["n_regionkey"]).select(
        "custkey", "cust_name", "segment", "acctbal", "nation_name", "region_name")


def dim_part(t: Tables) -> DataFrame:
    return t["stg_part"].select("partkey", "part_name", "brand", "part_type", "size", "retail_price")


def fact_order(t: Tables) -> DataFrame:
    who = t["dim_customer"].select("custkey", "cust_name", "region_name")
    return lookup_join(t["stg_orders"], who, ["custkey"]).select(
        "orderkey", "custkey", "status", "total_price", "order_date", "cust_name", "region_name")


def fact_lineitem(t: Tables) -> DataFrame:
    what = t["dim_part"].select("partkey", "part_name", "brand", "part_type")
    when = t["stg_orders"].select("orderkey", "custkey", "order_date")
    # parts last: their names are not moved again, and what counts by part finds its rows together
    lines = lookup_join(t["stg_lineitem"], when, ["orderkey"])
    lines = lookup_join(lines, what, ["partkey"])
    net = F.col("extended_price") * (F.lit("1.00").cast("decimal(3,2)") - F.col("discount"))
    return lines.select(
        "orderkey", "partkey", "suppkey", "linenumber", "custkey", "quantity", "extended_price",
        net.cast("decimal(18,4)").alias("net"), "ship_date", "part_name", "brand", "part_type")


def _ordinal(col: str):
    return F.year(col) * 10 + F.quarter(col)


def mart_customer_report(t: Tables) -> DataFrame:
    """Per customer the number of orders and the mean order of the latest quarter."""
    per_quarter = t["fact_order"].groupBy("custkey", _ordinal("order_date").alias("ord")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_price").alias("s"),
        F.count("total_price").alias("c"))
    per_customer = per_quarter.groupBy("custkey").agg(
        F.sum("n").alias("n_orders"),
        F.max_by(F.struct("s", "c"), "ord").alias("latest"))
    who = t["dim_customer"].select("custkey", "cust_name", "region_name").distinct()
    return who.join(per_customer, "custkey", "left").select(      # one row per customer on each side
        "custkey", "cust_name", "region_name",
        F.coalesce("n_orders", F.lit(0)).cast("long").alias("n_orders"),
        mean4("latest.s", "latest.c").alias("latest_total"))


def mart_part_report(t: Tables) -> DataFrame:
    g = t["fact_lineitem"].groupBy("partkey", "brand", "part_type").agg(
        F.sum("extended_price").alias("s"), F.count("extended_price").alias("c"),
        F.max("extended_price").alias("max_price"),
        F.sum("quantity").cast("decimal(18,2)").alias("total_qty"),
        F.count(F.lit(1)).alias("n_lines"))
    return g.select("partkey", "brand", "part_type", mean4("s", "c").alias("avg_price"),
                    "max_price", "total_qty", "n_lines")


def mart_order_year(t: Tables) -> DataFrame:
    g = t["fact_order"].groupBy("custkey", "cust_name",
                                F.year("order_date").alias("order_year")).agg(
        F.sum("total_price").alias("s"), F.count("total_price").alias("c"),
        F.count(F.lit(1)).alias("n_orders"))
    return g.select("custkey", "cust_name", "order_year",
                    F.col("s").cast("decimal(18,2)").alias("annual_total"),
                    mean4("s", "c").alias("avg_total"), "n_orders")


def mart_daily_ship(t: Tables) -> DataFrame:
    """Sums and distinct parts apart: the pairs of day and part, almost as many as lines, move without sums."""
    lines = t["fact_lineitem"]
    g = lines.groupBy("ship_date").agg(
        F.sum("extended_price").alias("s"), F.count("extended_price").alias("c"),
        F.sum("quantity").cast("decimal(18,2)").alias("total_qty"))
    parts = lines.groupBy(F.col("ship_date").alias("_day")).agg(F.count_distinct("partkey").alias("n_parts"))
    return g.join(parts, F.col("ship_date").eqNullSafe(F.col("_day"))).select(
        "ship_date", mean4("s", "c").alias("avg_price"), "total_qty", "n_parts")


def mart_region_report(t: Tables) -> DataFrame:
    g = t["fact_order"].filter(F.col("region_name").isNotNull()).groupBy("region_name").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("total_price").alias("s"),
        F.count("total_price").alias("c"), F.count_distinct("custkey").alias("n_customers"))
    return g.select("region_name", "n_orders",
                    F.col("s").cast("decimal(18,2)").alias("total_value"),
                    mean4("s", "c").alias("avg_value"), "n_customers")


def mart_order_detail(t: Tables) -> DataFrame:
    return t["fact_order"].select("orderkey", "cust_name", "order_date", "total_price")


def mart_part_master(t: Tables) -> DataFrame:
    return t["dim_part"].select("partkey", "part_name", "brand", "part_type", "size",
                                "retail_price")


_LINE_KEY = ("orderkey", "partkey", "suppkey", "linenumber")

_LINES = " ".join(_LINE_KEY)

STAR = Lineage(
    nodes=(
        Node("stg_part", ("part",), stg_part, {"part": cut("partkey", part="p_partkey")}),
        Node("stg_customer", ("customer",), stg_customer,
             {"customer": cut("custkey", customer="c_custkey")}),
        Node("stg_orders", ("orders",), stg_orders, {"orders": cut("orderkey", orders="o_orderkey")}),
        Node("stg_lineitem", ("lineitem",), stg_lineitem,
             {"lineitem": cut(_LINES, lineitem="l_orderkey l_partkey l_suppkey l_linenumber")}),
        Node("stg_event", ("events",), stg_event, {"events": cut("event_id", "events")}),
        Node("dim_customer", ("stg_customer", "nation", "region"), dim_customer,
             {"stg_customer": cut("custkey", "stg_customer")}),
        Node("dim_part", ("stg_part",), dim_part, {"stg_part": cut("partkey", "stg_part")}),
        Node("fact_order", ("stg_orders", "dim_customer"), fact_order,
             {"stg_orders": cut("orderkey", "stg_orders"),
              "dim_customer": cut("custkey", "dim_customer", "stg_orders")}),
        Node("fact_lineitem", ("stg_lineitem", "dim_part", "stg_orders"), fact_lineitem,
             {"stg_lineitem": cut(_LINES, "stg_lineitem"),
              "dim_part": cut("partkey", "dim_part", "stg_lineitem", fills=("part_name", "brand", "part_type")),
              "stg_orders": cut("orderkey", "stg_orders", "stg_lineitem", fills=("custkey",))}),
        Node("mart_customer_report", ("dim_customer", "fact_order"), mart_customer_report,
             {p: cut("custkey", "dim_customer", "fact_order") for p in ("dim_customer", "fact_order")}),
        Node("mart_part_report", ("fact_lineitem",), mart_part_report,
             {"fact_lineitem": cut("partkey", "fact_lineitem")}, {"fact_lineitem": ("custkey",)}),
        Node("mart_order_year", ("fact_order",), mart_order_year,
             {"fact_order": cut("custkey", "fact_order")}),
        Node("mart_daily_ship", ("fact_lineitem",), mart_daily_ship,
             {"fact_lineitem": cut("ship_date", "fact_lineitem")},
             {"fact_lineitem": ("custkey", "part_name", "brand", "part_type")}),
        Node("mart_region_report", ("fact_order",), mart_region_report,
             {"fact_order": cut("region_name", "fact_order")}),
        Node("mart_order_detail", ("fact_order",), mart_order_detail,
             {"fact_order": cut("orderkey", "fact_order")}),
        Node("mart_part_master", ("dim_part",), mart_part_master,
             {"dim_part": cut("partkey", "dim_part")}),
    ),
    rules={
        "stg_orders": Rule(("orderkey",), "total_price", "total_price",
                           ("custkey", "stg_customer", "custkey")),
        "fact_order": Rule(("orderkey",), "total_price", "total_price",
                           ("custkey", "dim_customer", "custkey")),
        "stg_lineitem": Rule(_LINE_KEY, "extended_price", "extended_price",
                             ("partkey", "stg_part", "partkey")),
        "fact_lineitem": Rule(_LINE_KEY, "extended_price", "extended_price",
                              ("partkey", "dim_part", "partkey")),
        "stg_customer": Rule(("custkey",)),
        "dim_customer": Rule(("custkey",)),
        "stg_part": Rule(("partkey",), "retail_price", "retail_price"),
        "dim_part": Rule(("partkey",), "retail_price", "retail_price"),
    },
    sinks={
        "mart_customer_report": Sink(("custkey",), "aggregate", ("n_orders", "latest_total")),
        "mart_part_report": Sink(("partkey",), "aggregate",
                                 ("avg_price", "max_price", "total_qty", "n_lines")),
        "mart_order_year": Sink(("custkey", "order_year"), "aggregate",
                                ("annual_total", "avg_total", "n_orders")),
        "mart_daily_ship": Sink(("ship_date",), "aggregate",
                                ("avg_price", "total_qty", "n_parts")),
        "mart_region_report": Sink(("region_name",), "aggregate",
                                   ("n_orders", "total_value", "avg_value", "n_customers")),
        "mart_order_detail": Sink(("orderkey",), "row_preserving", ("total_price",)),
        "mart_part_master": Sink(("partkey",), "row_preserving", ("retail_price",)),
    },
)
