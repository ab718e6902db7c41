"""Raw files through the readers: lines derived from whole tables are written and read back.

Some lines are broken on purpose; the readers must keep and count them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dqspark.operators import targets as tg
from dqspark.plans.brokerage import BROKERAGE
from dqspark.queries.common import plain, read, with_sql
from dqspark.queries.wire import BASE, EXPECTED, raw_tables
from dqspark.session import shared_dir
from dqspark.sources.contracts import FLAT_FILES, SHOP_FILES
from dqspark.sources.load import load_brokerage
from dqspark.sources.manifest import publish, read_shards, shard_counts, write_shard
from dqspark.sources.readers import (read_actions_xml, read_contract, read_delimited,
                                     read_fixed_width_lines)

QUERIES = {}
ORACLES = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn
    return add


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/dqspark/raw-{uuid.uuid4().hex}"


def _line(sep: str, *parts):
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).alias("value")


def _money(col: str):
    return F.col(col).cast("decimal(18,2)")


def _market_lines(lines):
    """Volumes of every 97th part are printed with a fraction, which no whole number holds."""
    volume = F.sum(F.col("l_quantity").cast("long"))
    rows = lines.groupBy(F.to_date("l_shipdate").alias("d"), "l_partkey").agg(
        F.max(_money("l_extendedprice")).alias("hi"), F.min(_money("l_extendedprice")).alias("lo"),
        volume.alias("v"))
    broken = F.when(F.col("l_partkey") % 97 == 0, F.concat(F.col("v").cast("string"), F.lit(".5")))
    return rows.select(_line("|", F.col("d"), F.concat(F.lit("S"), "l_partkey"), F.col("hi"), F.col("hi"),
                             F.col("lo"), F.coalesce(broken, F.col("v").cast("string"))))


_DAYS = """select strftime(d, '%Y-%m-%d') market_date, count(*) n_lines,
    count(*) filter (l_partkey % 97 = 0) n_rejected, cast(sum(case when l_partkey % 97 <> 0 then v end) as bigint) volume
    from (select cast(l_shipdate as date) d, l_partkey, sum(cast(l_quantity as bigint)) v from lineitem group by 1, 2)
    group by 1"""


@query(_DAYS)
def raw_delimited(spark, sf_dir):
    folder = _folder(spark)
    file, sep, schema = FLAT_FILES["raw_dailymarket"]
    _market_lines(read(spark, sf_dir, "lineitem")).write.text(f"{folder}/{file}")
    return read_delimited(spark, f"{folder}/{file}", schema, sep).groupBy("dm_date").agg(
        F.count("*").alias("n_lines"), F.count("_corrupt").alias("n_rejected"),
        F.sum("dm_vol").alias("volume")).select(
        F.col("dm_date").cast("string").alias("market_date"), "n_lines", "n_rejected", "volume")


@query("""select c_nationkey::bigint managerid, count(*) n_lines, count(*) filter (c_custkey % 10 = 3) n_rejected,
    count(distinct c_name || ', Jr') n_names from customer group by 1""")
def raw_quoted(spark, sf_dir):
    """Quoted names hold the separator; every tenth line has a field too few."""
    folder = _folder(spark)
    file, sep, schema = FLAT_FILES["raw_hr"]
    people = read(spark, sf_dir, "customer")
    name = F.concat(F.lit('"'), "c_name", F.lit(', Jr"'))
    whole = _line(",", F.col("c_custkey"), F.col("c_nationkey"), name, F.lit("x"), F.lit("m"), F.lit(314),
                  F.col("c_mktsegment"), F.lit("o"), F.lit("1"))
    short = _line(",", F.col("c_custkey"), F.col("c_nationkey"), name)
    people.select(F.when(F.col("c_custkey") % 10 == 3, short).otherwise(whole).alias("value")) \
        .write.text(f"{folder}/{file}")
    return read_delimited(spark, f"{folder}/{file}", schema, sep).groupBy("managerid").agg(
        F.count("*").alias("n_lines"), F.count("_corrupt").alias("n_rejected"),
        F.count_distinct("employeefirstname").alias("n_names"))


@query("""select o_orderstatus store_id, count(*) n_orders, cast(sum(cast(cast(o_totalprice as decimal(18,2)) * 100
    as bigint)) as bigint) cents, strftime(max(o_orderdate), '%Y-%m-%d') newest from orders group by 1""")
def raw_contract(spark, sf_dir):
    folder = _folder(spark)
    table, schema = SHOP_FILES["raw_orders.csv"]
    cents = (_money("o_totalprice") * 100).cast("long")
    read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("ordered_at"),
        F.col("o_orderstatus").alias("store_id"), cents.alias("subtotal"), F.lit(0).alias("tax_paid"),
        cents.alias("order_total")).write.option("header", True).csv(f"{folder}/{table}")
    return read_contract(spark, f"{folder}/{table}", schema).groupBy("store_id").agg(
        F.count("*").alias("n_orders"), F.sum("order_total").alias("cents"),
        F.date_format(F.max("ordered_at"), "yyyy-MM-dd").alias("newest"))


_TEXTS = """count(*) n_records, cast(sum(length(body)) as bigint) n_chars,
    cast(sum(length(body) - length(replace(body, chr(10), ''))) as bigint) n_breaks,
    max(md5(body)) largest, min(md5(body)) least"""


def _texts(df, by: str):
    body = F.coalesce("body", F.lit(""))
    return df.groupBy(by).agg(
        F.count("*").alias("n_records"), F.sum(F.length(body)).alias("n_chars"),
        F.sum(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))).alias("n_breaks"),
        F.max(F.md5(body)).alias("largest"), F.min(F.md5(body)).alias("least"))


@query(f"""select lang, {_TEXTS} from
    (select lang, coalesce(replace(text, chr(13), ''), '') body from documents) group by 1""")
def raw_line_breaks(spark, sf_dir):
    """Whole texts as quoted fields: line breaks, separators and quotes inside."""
    folder = _folder(spark)
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(body, F.lit('"'), F.lit('""')), F.lit('"'))
    spark.read.parquet(f"{sf_dir}/documents.parquet").select(_line("|", F.col("doc_id"), quoted, F.col("lang"))) \
        .write.text(f"{folder}/Texts.txt")
    return _texts(read_delimited(spark, f"{folder}/Texts.txt", "id bigint, body string, lang string"), "lang")


@query(f"""select origin, {_TEXTS} from (select case when doc_id % 50 = 7 then 'origin' else source end origin,
    case when doc_id % 50 = 7 then 'body' else coalesce(replace(text, chr(13), ''), '') end body
    from documents) group by 1""")
def raw_contract_breaks(spark, sf_dir):
    """A file of Spark's own writer; every fiftieth record equals the header and is data."""
    folder = _folder(spark)
    like_head = F.col("doc_id") % 50 == 7
    spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.when(like_head, "id").otherwise(F.col("doc_id").cast("string")).alias("id"),
        F.when(like_head, "body").otherwise(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(""))).alias("body"),
        F.when(like_head, "origin").otherwise(F.col("source")).alias("origin")) \
        .write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/texts.csv")
    return _texts(read_contract(spark, f"{folder}/texts.csv", "id string, body string, origin string"), "origin")


def _wire_folder(spark, sf_dir) -> str:
    folder = _folder(spark)
    raw_tables(spark, sf_dir)["raw_finwire"].select(F.col("line").alias("value")).write.text(f"{folder}/FINWIRE")
    return folder


@query("""select 'CMP' rec_type, 2 * count(*) n_lines, 2 * count(*) n_places from supplier union all
    select 'SEC', 2 * count(*), 2 * count(*) from part union all select 'FIN', count(*), count(*) from
    (select 1 from lineitem group by l_suppkey, year(l_shipdate), quarter(l_shipdate))""")
def raw_fixed_width(spark, sf_dir):
    """Lines by record type; every line has a place of its own in its file."""
    lines = read_fixed_width_lines(spark, f"{_wire_folder(spark, sf_dir)}/FINWIRE", "part-*")
    return lines.groupBy("rec_type").agg(
        F.count("*").alias("n_lines"), F.count_distinct("source_file", "line_no").alias("n_places"))


@query(with_sql(BASE, EXPECTED["dim_security"]))
def raw_fixed_width_securities(spark, sf_dir):
    """The security dimension from lines that went through the reader."""
    raw = raw_tables(spark, sf_dir)
    raw["raw_finwire"] = read_fixed_width_lines(spark, f"{_wire_folder(spark, sf_dir)}/FINWIRE", "part-*")
    return plain(BROKERAGE.build(raw, ("dim_security",))["dim_security"])


@query("""select o_orderstatus tax_status, count(*) n_accounts, count(distinct o_custkey) n_owners,
    count(*) n_actions from orders group by 1""")
def raw_xml_actions(spark, sf_dir):
    """One action for each customer and each order, in one document of many parts; some wrap their attributes."""
    folder = _folder(spark)
    new = read(spark, sf_dir, "customer").select(F.format_string(
        '<TPCDI:Action ActionType="NEW" ActionTS="2007-07-07T05:00:00"><Customer C_ID="%s"><Name><C_L_NAME> %s '
        "</C_L_NAME></Name></Customer></TPCDI:Action>", "c_custkey", "c_name").alias("value"))
    add = read(spark, sf_dir, "orders").select(F.format_string(
        '<TPCDI:Action\n\tActionType="ADDACCT" ActionTS="2008-01-01T00:00:00"><Customer C_ID="%s"><Account CA_ID="%s" '
        'CA_TAX_ST="%s"><CA_NAME>%s</CA_NAME></Account></Customer></TPCDI:Action>',
        "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority").alias("value"))
    new.unionByName(add).write.text(f"{folder}/CustomerMgmt.xml")
    _, accounts = read_actions_xml(spark, f"{folder}/CustomerMgmt.xml")
    return accounts.groupBy(F.col("ca_tax_st").alias("tax_status")).agg(
        F.count_distinct("ca_id").alias("n_accounts"), F.count_distinct("c_id").alias("n_owners"),
        F.count_distinct("action_seq").alias("n_actions"))


_MISSING = sorted({n: f for n, (f, *_) in FLAT_FILES.items() if n not in ("raw_dailymarket", "raw_industry")}.items())
_MISSING += [("raw_finwire", "FINWIRE*"), ("raw_customer_actions", "CustomerMgmt.xml"),
             ("raw_account_actions", "CustomerMgmt.xml")]


@query("""select 'raw_dailymarket' "table", 'DailyMarket.txt' file, count(*) "rows", count(*) filter (k % 97 = 0)
    rejected, 'rejected lines' status from (select l_partkey k from lineitem group by cast(l_shipdate as date), l_partkey)
    having count(*) filter (k % 97 = 0) > 0
    union all select 'raw_dailymarket', 'DailyMarket.txt', count(*), 0, 'ok' from (select l_partkey k from lineitem
    group by cast(l_shipdate as date), l_partkey) having count(*) filter (k % 97 = 0) = 0
    union all select 'raw_industry', 'Industry.txt', count(*), 0, 'ok' from nation""" + "".join(
    f" union all select '{n}', '{f}', 0, 0, 'missing'" for n, f in _MISSING))
def raw_missing_sources(spark, sf_dir):
    """The manifest of a batch of which two files are there."""
    folder = _folder(spark)
    _market_lines(read(spark, sf_dir, "lineitem")).write.text(f"{folder}/DailyMarket.txt")
    read(spark, sf_dir, "nation").select(_line("|", F.col("n_nationkey"), F.col("n_name"), F.lit("XX"))) \
        .write.text(f"{folder}/Industry.txt")
    return load_brokerage(spark, folder)[1]


@query("""select o_orderstatus status, count(*) n_orders, count(distinct o_custkey) n_customers
    from orders group by 1""")
def raw_published(spark, sf_dir):
    """Orders published as a partitioned, and as a bucketed catalog table, and read by name."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    name = f"dq_orders_{uuid.uuid4().hex}"
    publish(orders, f"{name}_p", partition_by=["o_orderstatus"])
    publish(orders, f"{name}_b", bucket_by=(4, ["o_orderkey"]))
    found = spark.table(f"{name}_p").select("o_orderkey", "o_orderstatus").join(
        spark.table(f"{name}_b").select("o_orderkey", "o_custkey"), "o_orderkey")
    return found.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers"))


@query("""select count(distinct l_returnflag) shards, count(*) "rows", count(*) filter (q % 5 = 0) failures from
    (select l_returnflag, l_suppkey, sum(cast(l_quantity as bigint)) q from lineitem group by 1, 2)""")
def raw_shards(spark, sf_dir):
    """Measurement rows of every supplier, written as one shard for each return flag."""
    folder = _folder(spark)
    rows = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("q")).select(
        "l_returnflag", F.col("l_suppkey").cast("string").alias("campaign"), F.col("q").cast("double").alias("nrd"),
        F.when(F.col("q") % 5 == 0, "technical_failure").otherwise("complete").alias("status"))
    for flag in ("A", "N", "R"):
        write_shard(rows.filter(F.col("l_returnflag") == flag).drop("l_returnflag"), folder, flag)
    return shard_counts(read_shards(spark, folder, "campaign string, nrd double, status string"))


_PICK = """(select o_orderkey k, row_number() over (order by h, o_orderkey) p from (select o_orderkey,
    sha256('disjoint|' || o_orderkey) h from orders {rest} order by h, o_orderkey limit 40))"""


@query(f"""select * from (with a as materialized {_PICK.format(rest='')}, b as materialized {_PICK.format(
    rest='where o_orderkey not in (select k from a)')},
    s as (select 'split' pair, k from a where p <= 20 union all select 'self', k from a union all select 'excluded', k from a),
    t as (select 'split' pair, k from a where p > 20 union all select 'self', k from a union all select 'excluded', k from b)
    select s.pair, count(t.k) = 0 disjoint from s left join t on t.pair = s.pair and t.k = s.k group by 1)""")
def target_disjointness(spark, sf_dir):
    """Halves of a split share no key, a set shares all with itself, exclusion leaves none shared."""
    orders = read(spark, sf_dir, "orders")
    picked = tg.pin(tg.pick_targets(orders, ["o_orderkey"], 40, "disjoint"))
    first, second = tg.split_targets(picked, 20)
    later = tg.pick_targets(orders, ["o_orderkey"], 40, "disjoint", exclude=picked)
    pairs, out = (("split", first, second), ("self", picked, picked), ("excluded", picked, later)), None
    for name, a, b in pairs:
        row = tg.shared_keys(a, b, ["o_orderkey"]).select(F.lit(name).alias("pair"), (F.col("shared") == 0).alias("disjoint"))
        out = row if out is None else out.unionByName(row)
    return out
