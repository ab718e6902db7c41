"""The 18-table brokerage lineage over raw wire records, market data, trades and accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dqspark.functions.scalars import micros, rounded
from dqspark.functions.skew import lookup_join
from dqspark.operators.signals import Rule
from dqspark.plans.lineage import Lineage, Node, Sink, Tables, cut
from dqspark.sources.contracts import COMPANY, FINANCIAL, SECURITY
from dqspark.sources.readers import latest, slice_records


def _exact(rows: DataFrame, keys: tuple, means: dict[str, tuple[str, int]],
           sums: dict[str, tuple[str, int]], rest: dict[str, Column]) -> DataFrame:
    """Groups with rounded means and sums of doubles that do not depend on the order of rows."""
    measured = {c for c, _ in [*means.values(), *sums.values()]}
    held = rows.groupBy(*keys).agg(
        *[micros(c).alias(f"_sum_{c}") for c in sorted(measured)],
        *[F.count(c).alias(f"_n_{c}") for c in sorted(measured)],
        *[c.alias(n) for n, c in rest.items()])
    out = {n: rounded(f"_sum_{c}", f"_n_{c}", d) for n, (c, d) in means.items()}
    out |= {n: F.when(F.col(f"_n_{c}") > 0, rounded(f"_sum_{c}", "1", d)) for n, (c, d) in sums.items()}
    return held.select(*keys, *[c.alias(n) for n, c in out.items()], *rest)


def _new_pairs(rows: DataFrame, key: str, other: str) -> DataFrame:
    """``rows`` with ``_new``, true on one row of every pair of ``key`` and ``other``, so that distinct values are counted
    without a hash table of all pairs. The pairs lie where the join by ``other`` has put them, and are sorted there."""
    pair = Window.partitionBy(other, key).orderBy(key)
    return rows.withColumn("_new", F.col(other).isNotNull() & (F.row_number().over(pair) == 1))


def stg_company(t: Tables) -> DataFrame:
    return latest(slice_records(t["raw_finwire"], "CMP", COMPANY), ["cik"], "pts").select(
        *COMPANY, "pts")


def stg_security(t: Tables) -> DataFrame:
    return latest(slice_records(t["raw_finwire"], "SEC", SECURITY), ["symbol"], "pts").select(
        *SECURITY)


def stg_financial(t: Tables) -> DataFrame:
    return slice_records(t["raw_finwire"], "FIN", FINANCIAL).select(*FINANCIAL)


def stg_daily_market(t: Tables) -> DataFrame:
    return t["raw_dailymarket"].selectExpr(
        "dm_date as market_date", "dm_s_symb as symbol", "dm_close as close_price",
        "dm_high as high_price", "dm_low as low_price", "dm_vol as volume")


def stg_trade(t: Tables) -> DataFrame:
    return t["raw_trade"].selectExpr(
        "t_id as trade_id", "t_dts as trade_dts", "t_s_symb as symbol", "t_ca_id as account_id",
        "t_qty as quantity", "t_trade_price as trade_price", "t_st_id as status_id",
        "t_tt_id as trade_type_id")


def stg_account(t: Tables) -> DataFrame:
    rows = t["raw_account_actions"].filter("ca_id is not null").selectExpr(
        "ca_id as account_id", "action_seq", "c_id as customer_id", "ca_name as account_name",
        "ca_tax_st as tax_status")
    return latest(rows, ["account_id"], "action_seq").drop("action_seq")


def dim_company(t: Tables) -> DataFrame:
    industry = t["raw_industry"].selectExpr("in_id as industry_id", "in_name as industry_name")
    return lookup_join(t["stg_company"], industry, ["industry_id"]).select(
        "cik", "company_name", "status", "industry_id", "sp_rating", "industry_name")


def dim_security(t: Tables) -> DataFrame:
    """Securities that name their company by text instead of by number stay without one."""
    company = t["dim_company"].selectExpr("cik as co_name_or_cik", "cik", "company_name",
                                          "industry_name")
    return lookup_join(t["stg_security"], company, ["co_name_or_cik"]).select(
        *SECURITY, "cik", "company_name", "industry_name")


def fact_financials(t: Tables) -> DataFrame:
    company = t["dim_company"].select("cik", "company_name", "industry_name")
    return lookup_join(t["stg_financial"], company, ["cik"]).select(
        *FINANCIAL, "company_name", "industry_name")


def fact_market_history(t: Tables) -> DataFrame:
    security = t["dim_security"].select("symbol", "cik", "company_name", "issue_type")
    return lookup_join(t["stg_daily_market"], security, ["symbol"]).select(
        "market_date", "symbol", "close_price", "high_price", "low_price", "volume", "cik",
        "company_name", "issue_type")


def fact_trade(t: Tables) -> DataFrame:
    account = t["stg_account"].select("account_id", "customer_id")
    security = t["dim_security"].select("symbol", "cik", "company_name")
    met = lookup_join(t["stg_trade"], account, ["account_id"])
    met = lookup_join(met, security, ["symbol"])
    return met.select("trade_id", "trade_dts", "symbol", "account_id", "quantity", "trade_price",
                      (F.col("quantity") * F.col("trade_price")).alias("trade_value"),
                      "customer_id", "cik", "company_name")


def mart_company_report(t: Tables) -> DataFrame:
    """Per company the number of securities and the mean figures of its latest reported quarter."""
    quarter = F.col("fin_year") * 10 + F.col("fin_qtr")
    sums = [f(c).alias(f"{name}_{c}") for c in ("revenue", "eps")
            for name, f in (("sum", micros), ("count", F.count))]
    per_quarter = t["fact_financials"].groupBy("cik", quarter.alias("_q")).agg(*sums)
    last = per_quarter.groupBy("cik").agg(F.max_by(F.struct(
        "sum_revenue", "count_revenue", "sum_eps", "count_eps"), "_q").alias("f"))
    held = t["dim_security"].filter("cik is not null").groupBy("cik").agg(
        F.count(F.lit(1)).alias("n"))
    company = t["dim_company"].select("cik", "company_name", "industry_name").distinct()
    met = company.join(held, "cik", "left").join(last, "cik", "left")
    return met.select(
        "cik", "company_name", "industry_name", F.coalesce("n", F.lit(0)).alias("n_securities"),
        rounded("f.sum_revenue", "f.count_revenue", 2).alias("latest_revenue"),
        rounded("f.sum_eps", "f.count_eps", 4).alias("latest_eps"))


def mart_financial_summary(t: Tables) -> DataFrame:
    return _exact(t["fact_financials"], ("cik", "company_name", "fin_year"),
                  {"avg_eps": ("eps", 4)}, {"annual_revenue": ("revenue", 2)},
                  {"n_quarters": F.count(F.lit(1))}).select(
        "cik", "company_name", "fin_year", "annual_revenue", "avg_eps", "n_quarters")


def mart_security_report(t: Tables) -> DataFrame:
    return _exact(t["fact_market_history"], ("symbol", "company_name", "issue_type"),
                  {"avg_close": ("close_price", 4)}, {},
                  {"max_high": F.round(F.max("high_price"), 4), "total_volume": F.sum("volume"),
                   "n_days": F.count(F.lit(1))})


def mart_market_daily(t: Tables) -> DataFrame:
    rows = _new_pairs(t["fact_market_history"], "market_date", "symbol")
    return _exact(rows, ("market_date",), {"avg_close": ("close_price", 4)}, {},
                  {"total_volume": F.sum("volume"), "n_symbols": F.count_if("_new")})


def mart_customer_report(t: Tables) -> DataFrame:
    rows = _new_pairs(t["fact_trade"].filter("customer_id is not null"), "customer_id", "symbol")
    return _exact(rows, ("customer_id",),
                  {"avg_trade_price": ("trade_price", 4)}, {"total_trade_value": ("trade_value", 2)},
                  {"n_trades": F.count(F.lit(1)), "n_symbols": F.count_if("_new")}).select(
        "customer_id", "n_trades", "total_trade_value", "avg_trade_price", "n_symbols")


def mart_financial_detail(t: Tables) -> DataFrame:
    return t["fact_financials"].select(
        "cik", "company_name", "fin_year", "fin_qtr", F.round("revenue", 2).alias("revenue"),
        F.round("eps", 4).alias("eps"), F.round("assets", 2).alias("assets"))


def mart_security_master(t: Tables) -> DataFrame:
    return t["dim_security"].select(
        "symbol", "security_name", "issue_type", "status", "shares_outstanding", "dividend", "cik",
        "company_name", "industry_name")


_QUARTER, _DAY = ("cik", "fin_year", "fin_qtr"), ("market_date", "symbol")

# The deployed rules, and the scored sinks with key, kind and value columns.
BROKERAGE = Lineage(
    nodes=(
        Node("stg_company", ("raw_finwire",), stg_company),
        Node("stg_security", ("raw_finwire",), stg_security),
        Node("stg_financial", ("raw_finwire",), stg_financial),
        Node("stg_daily_market", ("raw_dailymarket",), stg_daily_market,
             {"raw_dailymarket": cut("market_date symbol", raw_dailymarket="dm_date dm_s_symb")}),
        Node("stg_trade", ("raw_trade",), stg_trade, {"raw_trade": cut("trade_id", raw_trade="t_id")}),
        Node("stg_account", ("raw_account_actions",), stg_account,
             {"raw_account_actions": cut("account_id", raw_account_actions="ca_id")}),
        Node("dim_company", ("stg_company", "raw_industry"), dim_company,
             {"stg_company": cut("cik", "stg_company"),
              "raw_industry": cut("industry_id", raw_industry="in_id", stg_company="industry_id")}),
        Node("dim_security", ("stg_security", "dim_company"), dim_security,
             {"stg_security": cut("symbol", "stg_security"),
              "dim_company": cut("co_name_or_cik", dim_company="cik", stg_security="co_name_or_cik")}),
        Node("fact_financials", ("stg_financial", "dim_company"), fact_financials,
             {"stg_financial": cut("cik fin_year fin_qtr", "stg_financial"),
              "dim_company": cut("cik", "dim_company", "stg_financial")}),
        Node("fact_market_history", ("stg_daily_market", "dim_security"), fact_market_history,
             {"stg_daily_market": cut("market_date symbol", "stg_daily_market"),
              "dim_security": cut("symbol", "dim_security", "stg_daily_market")}),
        Node("fact_trade", ("stg_trade", "stg_account", "dim_security"), fact_trade,
             {"stg_trade": cut("trade_id", "stg_trade"),
              "stg_account": cut("account_id", "stg_account", "stg_trade"),
              "dim_security": cut("symbol", "dim_security", "stg_trade")}),
        Node("mart_company_report", ("dim_company", "dim_security", "fact_financials"),
             mart_company_report,
             {p: cut("cik", "dim_company", "dim_security", "fact_financials")
              for p in ("dim_company", "dim_security", "fact_financials")}),
        Node("mart_financial_summary", ("fact_financials",), mart_financial_summary,
             {"fact_financials": cut("cik", "fact_financials")}),
        Node("mart_security_report", ("fact_market_history",), mart_security_report,
             {"fact_market_history": cut("symbol", "fact_market_history")}),
        Node("mart_market_daily", ("fact_market_history",), mart_market_daily,
             {"fact_market_history": cut("market_date", "fact_market_history")}),
        Node("mart_customer_report", ("fact_trade",), mart_customer_report,
             {"fact_trade": cut("customer_id", "fact_trade")}),
        Node("mart_financial_detail", ("fact_financials",), mart_financial_detail,
             {"fact_financials": cut("cik fin_year fin_qtr", "fact_financials")}),
        Node("mart_security_master", ("dim_security",), mart_security_master,
             {"dim_security": cut("symbol", "dim_security")}),
    ),
    rules={
        "stg_financial": Rule(_QUARTER, "revenue", "revenue", ("cik", "stg_company", "cik")),
        "fact_financials": Rule(_QUARTER, "revenue", "revenue", ("cik", "dim_company", "cik")),
        "stg_daily_market": Rule(_DAY, "close_price", "close_price",
                                 ("symbol", "stg_security", "symbol")),
        "fact_market_history": Rule(_DAY, "close_price", "close_price",
                                    ("symbol", "dim_security", "symbol")),
        "stg_company": Rule(("cik",)),
        "dim_company": Rule(("cik",)),
        "stg_security": Rule(("symbol",), "dividend", "dividend"),
        "dim_security": Rule(("symbol",), "dividend", "dividend"),
    },
    sinks={
        "mart_company_report": Sink(("cik",), "aggregate",
                                    ("latest_revenue", "latest_eps", "n_securities")),
        "mart_financial_summary": Sink(("cik", "fin_year"), "aggregate",
                                       ("annual_revenue", "avg_eps", "n_quarters")),
        "mart_security_report": Sink(("symbol",), "aggregate",
                                     ("avg_close", "max_high", "total_volume", "n_days")),
        "mart_market_daily": Sink(("market_date",), "aggregate",
                                  ("avg_close", "total_volume", "n_symbols")),
        "mart_customer_report": Sink(("customer_id",), "aggregate",
                                     ("n_trades", "total_trade_value", "avg_trade_price",
                                      "n_symbols")),
        "mart_financial_detail": Sink(_QUARTER, "row_preserving", ("revenue", "eps", "assets")),
        "mart_security_master": Sink(("symbol",), "row_preserving",
                                     ("shares_outstanding", "dividend")),
    },
)
