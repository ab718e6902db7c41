"""Tables of the star lineage and of the raw-record layer."""

from __future__ import annotations

from dqspark.plans.star import STAR
from dqspark.queries.common import SQL_NODES, plain, star_ctes, star_table, with_sql

QUERIES = {}
ORACLES = {}

_DATES = {"stg_orders": ["order_date"], "fact_order": ["order_date"],
          "stg_lineitem": ["ship_date"], "fact_lineitem": ["ship_date"],
          "mart_order_detail": ["order_date"], "mart_daily_ship": ["ship_date"]}


def _table(name):
    return lambda spark, sf_dir: plain(star_table(spark, sf_dir, name))


def _sql(name):
    columns = {"stg_orders": ["total_price"], "stg_lineitem": ["quantity", "extended_price",
                                                             "discount"],
               "dim_customer": ["acctbal"], "fact_order": ["total_price"],
               "fact_lineitem": ["quantity", "extended_price", "net"],
               "mart_order_detail": ["total_price"], "mart_part_master": ["retail_price"]}
    amounts = list(columns.get(name, []))
    if name in STAR.sinks and STAR.sinks[name].kind == "aggregate":
        amounts = [v for v in STAR.sinks[name].values if not v.startswith("n_")]
    swaps = [f"cast({c} as double) as {c}" for c in amounts]
    swaps += [f"cast({c} as varchar) as {c}" for c in _DATES.get(name, [])]
    tail = f"select * replace ({', '.join(swaps)}) from {name}" if swaps else f"select * from {name}"
    return with_sql(star_ctes(), tail)


for _name in ("stg_orders", "stg_lineitem", "dim_customer", "fact_order", "fact_lineitem",
              *STAR.sinks):
    QUERIES[_name] = _table(_name)
    ORACLES[_name] = _sql(_name)

assert set(SQL_NODES) | {"stg_event"} == set(STAR.names())
