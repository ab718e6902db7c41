"""The error cases the queries run: which rows get which error, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dqspark.operators.injection import Injection
from dqspark.operators.signals import Rule, derive_bands
from dqspark.operators.targets import pick_targets, pin, split_targets
from dqspark.plans.star import STAR
from dqspark.queries.common import SQL_NODES, damage_sql, star_ctes, top_keys

ORDER_KEY = ("orderkey",)
LOOSE_LINE = Rule(("orderkey", "linenumber"), "extended_price", "extended_price",
                  ("partkey", "stg_part", "partkey"))
OPERAND = 10_000_000
K = 40
ORPHAN = -1

ORDERS_RULE = STAR.rules["stg_orders"]
CONDITIONAL = {"duplicate_shape": "dedup", "numeric_shape": "quarantine"}
QUARANTINE_ALL = {s: "quarantine" for s in
                  ("duplicate_shape", "numeric_shape", "null_shape", "fk_shape")}


def order_targets(orders: DataFrame, k: int = K, salt: str = "case.mixed") -> DataFrame:
    return pin(pick_targets(orders, ORDER_KEY, k, salt))


def numeric(targets: DataFrame, operand: float = OPERAND) -> Injection:
    return Injection("stg_orders", "numeric_add", targets, ORDER_KEY, ("total_price",), operand)


def duplicate(targets: DataFrame) -> Injection:
    return Injection("stg_orders", "duplicate_rows", targets, ORDER_KEY)


def blank(targets: DataFrame) -> Injection:
    return Injection("stg_orders", "null_out", targets, ORDER_KEY, ("total_price",))


def orphan(targets: DataFrame) -> Injection:
    return Injection("stg_orders", "fk_orphan", targets, ORDER_KEY, ("custkey",), ORPHAN)


def delete(targets: DataFrame) -> Injection:
    return Injection("stg_orders", "delete_rows", targets, ORDER_KEY)


def mixed(orders: DataFrame) -> list[Injection]:
    """Half of the targets get a numeric shift, the other half a physical copy."""
    first, second = split_targets(order_targets(orders), K // 2)
    return [numeric(first), duplicate(second)]


def overlap(orders: DataFrame) -> list[Injection]:
    """Shift and then copy the same rows, so both shapes fire on each key."""
    t = order_targets(orders, 10, "case.overlap")
    return [numeric(t), duplicate(t)]


def four_shapes(orders: DataFrame) -> list[Injection]:
    """Ten rows for each of the four shapes."""
    t = order_targets(orders, 40, "case.four")
    a, rest = split_targets(t, 10)
    b, rest = split_targets(rest, 20)
    c, d = split_targets(rest, 30)
    return [numeric(a), duplicate(b), blank(c), orphan(d)]


def order_bands(tables) -> dict:
    return derive_bands(tables, {n: STAR.rules[n] for n in ("stg_orders", "fact_order")})


# --- SQL ---------------------------------------------------------------------------------------

ORDER_COLUMNS = "orderkey, custkey, status, total_price, order_date, priority"


def sql_targets(name: str = "targets", k: int = K, salt: str = "case.mixed", extra: str = "") -> str:
    return f"{name} as materialized ({top_keys('stg_orders', ['orderkey'], k, salt, extra)})"


def _hit(where: str, table: str = "targets") -> str:
    return f"orderkey in (select orderkey from {table} where {where})"


def sql_numeric(src: str, where: str, operand=OPERAND, table: str = "targets") -> str:
    return (f"select orderkey, custkey, status, case when {_hit(where, table)} then "
            f"cast(total_price + cast({operand} as decimal(18,2)) as decimal(18,2)) "
            f"else total_price end total_price, order_date, priority from {src}")


def sql_duplicate(src: str, where: str, table: str = "targets") -> str:
    return (f"select * from {src} union all select * from {src} where {_hit(where, table)}")


def sql_blank(src: str, where: str, table: str = "targets") -> str:
    return (f"select orderkey, custkey, status, case when {_hit(where, table)} then null "
            f"else total_price end total_price, order_date, priority from {src}")


def sql_orphan(src: str, where: str, table: str = "targets") -> str:
    return (f"select orderkey, case when {_hit(where, table)} then {ORPHAN} else custkey end custkey,"
            f" status, total_price, order_date, priority from {src}")


def sql_delete(src: str, where: str, table: str = "targets") -> str:
    return f"select * from {src} where not ({_hit(where, table)})"


def sql_mixed() -> list[str]:
    half = K // 2
    return [sql_targets(),
            f"m1 as materialized ({sql_numeric('stg_orders', f'position <= {half}')})",
            f"mixed as materialized ({sql_duplicate('m1', f'position > {half}')})"]


def sql_overlap() -> list[str]:
    return [sql_targets("overlap_targets", 10, "case.overlap"),
            f"o1 as materialized ({sql_numeric('stg_orders', 'true', table='overlap_targets')})",
            f"overlap as materialized ({sql_duplicate('o1', 'true', 'overlap_targets')})"]


def sql_four() -> list[str]:
    t = "four_targets"
    return [sql_targets(t, 40, "case.four"),
            f"f1 as materialized ({sql_numeric('stg_orders', 'position <= 10', table=t)})",
            f"f2 as materialized ({sql_duplicate('f1', 'position between 11 and 20', t)})",
            f"f3 as materialized ({sql_blank('f2', 'position between 21 and 30', t)})",
            f"four as materialized ({sql_orphan('f3', 'position > 30', t)})"]


def sql_dedup(src: str, key: str, columns: str) -> str:
    order = ", ".join(f"{c.strip()} nulls first" for c in columns.split(","))
    return (f"select {columns} from (select *, row_number() over (partition by {key} "
            f"order by {order}) rn from {src}) where rn = 1")


SQL_BAND = "(select max(total_price) * 2 from stg_orders)"
SQL_OUT = f"(total_price < 0 or total_price > {SQL_BAND})"


def sql_quarantine_numeric(src: str) -> str:
    return f"select * from {src} where not coalesce({SQL_OUT}, false)"


def sql_conditional(src: str) -> list[str]:
    """Live routing of the conditional policy over ``src``; the last CTE is ``conditional``."""
    return [f"cond1 as materialized ({sql_dedup(src, 'orderkey', ORDER_COLUMNS)})",
            f"conditional as materialized ({sql_quarantine_numeric('cond1')})"]


def sql_quarantine_all(src: str) -> list[str]:
    return [f"qa1 as materialized (select * from {src} where orderkey not in (select orderkey from "
            f"{src} group by 1 having count(*) > 1))",
            f"qa2 as materialized ({sql_quarantine_numeric('qa1')})",
            "qa3 as materialized (select * from qa2 where total_price is not null)",
            "quarantined as materialized (select * from qa3 where custkey is null or custkey in "
            "(select custkey from stg_customer))"]


def branch_ctes(prepare: list[str], dirty_orders: str, suffix: str = "_d") -> list[str]:
    """Clean star, preparation, and the part of the star below the changed orders."""
    return [*star_ctes(), *prepare,
            *star_ctes({"stg_orders": f"select * from {dirty_orders}"}, suffix)]


SINK_KEYS = {n: (list(s.key), s.kind) for n, s in STAR.sinks.items()}
SINK_VALUES = {
    "mart_customer_report": ["cust_name", "region_name", "n_orders", "latest_total"],
    "mart_part_report": ["brand", "part_type", "avg_price", "max_price", "total_qty", "n_lines"],
    "mart_order_year": ["cust_name", "annual_total", "avg_total", "n_orders"],
    "mart_daily_ship": ["avg_price", "total_qty", "n_parts"],
    "mart_region_report": ["n_orders", "total_value", "avg_value", "n_customers"],
    "mart_order_detail": ["cust_name", "order_date", "total_price"],
    "mart_part_master": ["part_name", "brand", "part_type", "size", "retail_price"],
}
# Sinks that hang below stg_orders; mart_part_master does not.
TOUCHED = [n for n in SINK_KEYS if n != "mart_part_master"]


def sql_sinks(suffix: str = "_d", name: str = "sinks", touched: tuple = tuple(TOUCHED)) -> str:
    """CTE with the damage row of every sink; those of ``touched`` have a version under the suffix."""
    parts = []
    for sink, (key, kind) in SINK_KEYS.items():
        dirty = sink + suffix if sink in touched else sink
        parts.append(f"select '{sink}' sink, '{kind}' kind, * from "
                     f"({damage_sql(sink, dirty, key, SINK_VALUES[sink])})")
    return f"{name} as materialized (" + "\nunion all ".join(parts) + ")"


assert "stg_orders" in SQL_NODES
