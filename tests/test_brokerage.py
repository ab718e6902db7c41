import os

import pytest
from pyspark.sql import functions as F

from dqspark.plans.brokerage import mart_customer_report, mart_market_daily
from dqspark.queries.wire import wire_protected_branch

SF_DIR = "/root/testdata/sf0.001"

DAYS = [("d1", "S1", 1.0, 10), ("d1", "S1", 3.0, 10), ("d1", None, 2.0, 10), ("d1", "S2", None, None),
        ("d2", None, None, None), (None, "S1", 1.0, 1), (None, "S1", 1.0, 1)]
DAY = "market_date string, symbol string, close_price double, volume long"
TRADES = [("C1", "S1", 1.0, 2.0), ("C1", "S1", 2.0, 4.0), ("C1", None, 3.0, 6.0), ("C2", None, None, None),
          (None, "S9", 1.0, 1.0)]
TRADE = "customer_id string, symbol string, trade_price double, trade_value double"


def _pair_tables(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Aggregate(keys=[" in x and "symbol" in x.split("functions=")[0]]


def test_distinct_symbols_are_counted_without_a_table_of_pairs(spark):
    days = mart_market_daily({"fact_market_history": spark.createDataFrame(DAYS, DAY)})
    assert sorted(map(tuple, days.collect()), key=str) == sorted(
        [("d1", 2.0, 30, 2), ("d2", None, None, 0), (None, 1.0, 2, 1)], key=str)
    trades = mart_customer_report({"fact_trade": spark.createDataFrame(TRADES, TRADE)})
    assert sorted(map(tuple, trades.collect())) == [("C1", 3, 12.0, 2.0, 1), ("C2", 1, None, None, 0)]
    assert _pair_tables(days) == [] and _pair_tables(trades) == []
    assert _pair_tables(spark.createDataFrame(DAYS, DAY).groupBy("market_date").agg(F.count_distinct("symbol")))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_branch_reads_stored_securities(spark):
    plan = wire_protected_branch(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" in plan and "p_partkey" not in plan and "s_suppkey" not in plan
