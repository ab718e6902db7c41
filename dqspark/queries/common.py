"""Shared pieces of the registered queries: tables, output types, and SQL of the star lineage."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dqspark.plans import star
from dqspark.session import tune

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tune(spark).read.schema(star.SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def star_tables(spark: SparkSession, sf_dir: str, *wanted: str) -> dict[str, DataFrame]:
    """The wanted star tables (default all) as lazy plans."""
    return star.STAR.build(star.sources(tune(spark), sf_dir), wanted or None)


def star_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return star_tables(spark, sf_dir, name)[name]


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, so results compare across engines."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("decimal"):
            c = c.cast("double")
        elif kind == "date":
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


# --- SQL of the star lineage, one template per table; {name} refers to another table ---------

SQL_NODES = {
    "stg_part": """select p_partkey partkey, p_name part_name, p_brand brand, p_type part_type,
        p_size size, cast(p_retailprice as decimal(18,2)) retail_price from part""",
    "stg_customer": """select c_custkey custkey, c_name cust_name, c_nationkey nationkey,
        cast(c_acctbal as decimal(18,2)) acctbal, c_mktsegment segment from customer""",
    "stg_orders": """select o_orderkey orderkey, o_custkey custkey, o_orderstatus status,
        cast(o_totalprice as decimal(18,2)) total_price, cast(o_orderdate as date) order_date,
        o_orderpriority priority from orders""",
    "stg_lineitem": """select l_orderkey orderkey, l_partkey partkey, l_suppkey suppkey,
        l_linenumber linenumber, cast(l_quantity as decimal(18,2)) quantity,
        cast(l_extendedprice as decimal(18,2)) extended_price,
        cast(l_discount as decimal(18,2)) discount, cast(l_shipdate as date) ship_date,
        l_returnflag return_flag, l_linestatus line_status from lineitem""",
    "dim_customer": """select c.custkey, c.cust_name, c.segment, c.acctbal, n.n_name nation_name,
        r.r_name region_name from {stg_customer} c left join nation n on n.n_nationkey = c.nationkey
        left join region r on r.r_regionkey = n.n_regionkey""",
    "dim_part": """select partkey, part_name, brand, part_type, size, retail_price
        from {stg_part}""",
    "fact_order": """select o.orderkey, o.custkey, o.status, o.total_price, o.order_date,
        d.cust_name, d.region_name from {stg_orders} o
        left join {dim_customer} d on d.custkey = o.custkey""",
    "fact_lineitem": """select l.orderkey, l.partkey, l.suppkey, l.linenumber, o.custkey,
        l.quantity, l.extended_price,
        cast(l.extended_price * (1.00 - l.discount) as decimal(18,4)) net, l.ship_date,
        p.part_name, p.brand, p.part_type from {stg_lineitem} l
        left join {dim_part} p on p.partkey = l.partkey
        left join {stg_orders} o on o.orderkey = l.orderkey""",
    "mart_customer_report": """with f as (select *, year(order_date) * 10 + quarter(order_date) o
          from {fact_order}),
        last as (select custkey, max(o) o from f group by 1),
        fin as (select f.custkey, f.total_price from f join last on last.custkey = f.custkey
          and last.o = f.o),
        cnt as (select custkey, count(*) n from f group by 1)
        select d.custkey, d.cust_name, d.region_name, coalesce(c.n, 0) n_orders,
          MEAN4(fin.total_price) latest_total
        from {dim_customer} d left join cnt c on c.custkey = d.custkey
        left join fin on fin.custkey = d.custkey group by 1, 2, 3, 4""",
    "mart_part_report": """select partkey, brand, part_type, MEAN4(extended_price) avg_price,
        max(extended_price) max_price, cast(sum(quantity) as decimal(18,2)) total_qty,
        count(*) n_lines from {fact_lineitem} group by 1, 2, 3""",
    "mart_order_year": """select custkey, cust_name, cast(year(order_date) as int) order_year,
        cast(sum(total_price) as decimal(18,2)) annual_total, MEAN4(total_price) avg_total,
        count(*) n_orders from {fact_order} group by 1, 2, 3""",
    "mart_daily_ship": """select ship_date, MEAN4(extended_price) avg_price,
        cast(sum(quantity) as decimal(18,2)) total_qty, count(distinct partkey) n_parts
        from {fact_lineitem} group by 1""",
    "mart_region_report": """select region_name, count(*) n_orders,
        cast(sum(total_price) as decimal(18,2)) total_value, MEAN4(total_price) avg_value,
        count(distinct custkey) n_customers from {fact_order} where region_name is not null
        group by 1""",
    "mart_order_detail": """select orderkey, cust_name, order_date, total_price
        from {fact_order}""",
    "mart_part_master": """select partkey, part_name, brand, part_type, size, retail_price
        from {dim_part}""",
}


def expand(sql: str) -> str:
    """MEAN4(x): mean of a two-decimal column, rounded half up to four decimals in integers."""
    return re.sub(
        r"MEAN4\(([\w.]+)\)",
        r"cast(case when count(\1) > 0 then cast(sign(sum(\1)) as int) * "
        r"((cast(abs(sum(\1)) * 100 as hugeint) * 200 + count(\1)) // (2 * count(\1))) end "
        r"as decimal(18,0)) * cast(0.0001 as decimal(5,4))", sql)


def star_ctes(over: dict[str, str] | None = None, suffix: str = "", acts: dict[str, str] | None = None
              ) -> list[str]:
    """CTE texts of the whole lineage.

    ``over`` replaces a table's definition; ``acts`` wraps it: the built table is ``{self}``. Tables
    keep their clean name (no suffix) unless they or an ancestor are replaced.
    """
    over, acts = over or {}, acts or {}
    names: dict[str, str] = {}
    out = []
    for table, body in SQL_NODES.items():
        refs = set(re.findall(r"\{(\w+)\}", body))
        touched = table in over or table in acts or any(names.get(r, r) != r for r in refs)
        if suffix and not touched:
            names[table] = table
            continue
        name = names[table] = table + suffix
        text = over.get(table, body)
        if table in acts:
            out.append(f"{name}_in as materialized ({fill(text, names)})")
            text = acts[table].replace("{self}", name + "_in")
        out.append(f"{name} as materialized ({fill(text, names)})")
    return out


def fill(text: str, names: dict[str, str]) -> str:
    return expand(re.sub(r"\{(\w+)\}", lambda m: names.get(m.group(1), m.group(1)), text))


def with_sql(ctes: list[str], final: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + expand(final)


def top_keys(table: str, key: list[str], k: int, salt: str, extra: str = "") -> str:
    """SQL of the hash-ranked targets with their position."""
    text = " || '|' || ".join(f"cast({c} as varchar)" for c in key)
    cols = ", ".join(key)
    return (f"select {cols}, cast(row_number() over (order by h, {cols}) as int) as position from ("
            f"select {cols}, sha256('{salt}|' || {text}) h from {table} {extra} "
            f"order by h, {cols} limit {k})")


def keyed(clean: str, dirty: str, key: list[str], values: list[str], sums: str = "") -> str:
    """Per key of either side: whether each side has it, and the number of unequal row pairs.

    One full join; NULL keys meet each other, but their rows are never pairs. ``sums`` adds columns
    over the joined rows ``c`` and ``d``; ``pair`` is true where both are there.
    """
    meet = " and ".join(f"c.{k} is not distinct from d.{k}" for k in key)
    known = " and ".join(f"c.{k} is not null" for k in key)
    unequal = " or ".join(f"c.{v} is distinct from d.{v}" for v in values)
    names = ", ".join(f"coalesce(c.{k}, d.{k}) {k}" for k in key)
    more = f", {sums.replace('pair', f'(c.here and d.here and {known})')}" if sums else ""
    return (f"select {names}, bool_or(c.here is not null) in_clean, bool_or(d.here is not null) in_dirty, "
            f"count(*) filter (c.here and d.here and {known} and ({unequal})) changed{more} from "
            f"(select *, true here from {clean}) c full join (select *, true here from {dirty}) d "
            f"on {meet} group by {', '.join(str(i + 1) for i in range(len(key)))}")


def damage_counts(clean: str, dirty: str, key: list[str], values: list[str]) -> str:
    return (f"select cast(coalesce(sum(changed), 0) as bigint) changed, count(*) filter (not in_clean) added, "
            f"count(*) filter (not in_dirty) lost, (select count(*) from {clean}) n_clean "
            f"from ({keyed(clean, dirty, key, values)})")


def damage_sql(clean: str, dirty: str, key: list[str], values: list[str]) -> str:
    return (f"select changed, added, lost, n_clean, coalesce(cast(2 * changed + added + lost as "
            f"double) / nullif(2 * n_clean + added - lost, 0), 0.0) damage from "
            f"({damage_counts(clean, dirty, key, values)})")
