"""The brokerage lineage over raw records that are derived from the whole order tables.

The raw records are the input of both engines. What is expected of the lineage is stated from the
base tables themselves, so that it shares nothing with the lineage but the raw layer's rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators.damage import sink_damage
from dqspark.operators.injection import Injection
from dqspark.operators.signals import derive_bands
from dqspark.operators.targets import pick_targets, pin, split_targets
from dqspark.plans.brokerage import BROKERAGE
from dqspark.plans.delta import delta_run
from dqspark.queries.common import damage_sql, plain, read, with_sql

QUERIES = {}
ORACLES = {}

_OLD, _NEW = "19980101-000000", "20000101-000000"
_MONEY = "cast(l_extendedprice as decimal(18,2))"


def slot(expr: str, width: int, left: bool = True, fill: str = " ") -> str:
    """A value in its slot; a wider value is an error, as padding would cut it."""
    side = "lpad" if left else "rpad"
    return (f"case when length({expr}) > {width} then raise_error(concat('too wide: ', {expr})) "
            f"else {side}({expr}, {width}, '{fill}') end")


def _text(expr: str) -> str:
    return f"cast({expr} as varchar(40))"


def _cik(key: str) -> str:
    return slot(_text(key), 10, fill="0")


#: Supplier that stands for a part's company, and the part's total quantity.
_OWNER = ("(select l_partkey, min(l_suppkey) owner, sum(cast(l_quantity as bigint)) qty "
          "from lineitem group by 1)")
_NAMED = "case when {rule} then concat('Supplier ', {key}) else {cik} end"
_QUARTERS = (f"(select l_suppkey k, cast(year(l_shipdate) as int) y, cast(quarter(l_shipdate) as int) q, "
             f"cast(sum({_MONEY}) as decimal(18,2)) rev, count(*) n from lineitem group by 1, 2, 3)")

RAW = {
    "cmp": f"""select concat(pts, 'CMP', {slot(f"concat(s_name, case when pts = '{_OLD}' then ' old' else '' end)", 60, False)},
        {_cik('s_suppkey')}, 'ACTV', {slot(_text('s_nationkey'), 2, fill='0')}, 'AA+ ') line
        from (select *, explode(array('{_OLD}', '{_NEW}')) pts from supplier)""",
    "sec": f"""select concat(pts, 'SEC', {slot("concat('S', p_partkey)", 15, False)}, 'COMMON', 'ACTV',
        {slot('p_name', 70, False)}, 'NYSE  ', {slot(_text('coalesce(qty, 0)'), 13)}, '1999010119990101',
        {slot(_text(f"cast(p_retailprice as decimal(18,2)) + case when pts = '{_OLD}' then 1 else 0 end"), 12)},
        {slot("coalesce(" + _NAMED.format(rule='p_partkey % 3 = 0', key='owner', cik=_cik('owner')) + ", '')", 60, False)}) line
        from (select *, explode(array('{_OLD}', '{_NEW}')) pts from part left join {_OWNER} o on l_partkey = p_partkey)""",
    "fin": f"""select concat(y, 'xxxxxxx0000FIN', y, q, lpad('', 16, '0'), {slot(_text('rev'), 17)},
        {slot(_text('rev - 0.25'), 17)}, {slot(_text('cast(n * 0.01 as decimal(18,2))'), 12)}, lpad('', 41, '0'),
        {slot(_text('rev + 1'), 17)}, {slot(_text('rev + rev'), 17)}, lpad('', 26, '0'),
        {slot(_NAMED.format(rule='k % 7 = 3', key='k', cik=_cik('k')), 60, False)}) line from {_QUARTERS} f""",
    "raw_dailymarket": f"""select cast(l_shipdate as date) dm_date, concat('S', l_partkey) dm_s_symb,
        cast(max({_MONEY}) as double) dm_close, cast(max({_MONEY}) + 0.5 as double) dm_high,
        cast(min({_MONEY}) as double) dm_low, sum(cast(l_quantity as bigint)) dm_vol
        from lineitem group by 1, 2""",
    "raw_trade": f"""select l_orderkey * 10 + l_linenumber t_id, l_shipdate t_dts, 'CMPT' t_st_id,
        l_returnflag t_tt_id, concat('S', l_partkey) t_s_symb, cast(l_quantity as bigint) t_qty,
        concat('A', o_custkey) t_ca_id, cast({_MONEY} as double) t_trade_price
        from lineitem join orders on o_orderkey = l_orderkey""",
    "raw_account_actions": """select o_orderkey action_seq, concat('C', o_custkey, '-', o_orderstatus) c_id,
        concat('A', o_custkey) ca_id, o_orderpriority ca_name, o_orderstatus ca_tax_st from orders""",
    "raw_industry": f"select {slot(_text('n_nationkey'), 2, fill='0')} in_id, n_name in_name from nation",
}
# a literal record type prunes the records a table does not read
_FINWIRE = " union all ".join(f"select substr(line, 1, 15) pts, '{n.upper()}' rec_type, line from {{{n}}}"
                              for n in ("cmp", "sec", "fin"))
_TABLES = ("supplier", "part", "lineitem", "orders", "nation")


def _spark_sql(spark, text: str, tables):
    for t in _TABLES:
        for word in ("from", "join"):
            text = text.replace(f"{word} {t}", f"{word} {{{t}}}")
    used = {t: df for t, df in tables.items() if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def raw_tables(spark, sf_dir):
    tables = {t: read(spark, sf_dir, t) for t in _TABLES}
    raw = {n: _spark_sql(spark, sql, tables) for n, sql in RAW.items()}
    raw["raw_finwire"] = spark.sql(_FINWIRE, **{n: raw[n] for n in ("cmp", "sec", "fin")})
    return raw


def wire_tables(spark, sf_dir, *wanted: str):
    return BROKERAGE.build(raw_tables(spark, sf_dir), wanted or None)


# --- what the lineage must give, from the base tables ---------------------------------------------

_ID = "lpad(cast({0} as varchar), 10, '0')"
_INDUSTRY = "lpad(cast(s_nationkey as varchar), 2, '0')"


def _sum(x: str) -> str:
    """Exact millionths."""
    return f"sum(cast(cast({x} as decimal(28,6)) * 1000000 as hugeint))"


def _half_up(total: str, n: str, digits: int) -> str:
    unit = 10 ** (6 - digits)
    return (f"case when {n} > 0 then cast(cast(sign({total}) as int) * ((abs({total}) * 2 + {unit} * {n}) // "
            f"({2 * unit} * {n})) as double) / {10 ** digits} end")


def _mean(x: str, digits: int) -> str:
    return _half_up(_sum(x), f"count({x})", digits)


BASE = [
    f"firm as (select {_ID.format('s_suppkey')} cik, s_name company_name, {_INDUSTRY} industry_id, "
    "n_name industry_name from supplier left join nation on n_nationkey = s_nationkey)",
    f"share as (select 'S' || p_partkey symbol, p_name security_name, cast(coalesce(qty, 0) as bigint) qty, "
    f"cast(p_retailprice as double) dividend, case when p_partkey % 3 = 0 then 'Supplier ' || owner "
    f"else {_ID.format('owner')} end company, owner, p_partkey % 3 <> 0 numbered from part left join "
    "(select l_partkey, min(l_suppkey) owner, sum(cast(l_quantity as bigint)) qty from lineitem group by 1) "
    "on l_partkey = p_partkey)",
    "held as (select share.*, cik, company_name, industry_name from share left join firm on numbered and "
    f"cik = {_ID.format('owner')})",
    f"quarterly as (select case when k % 7 = 3 then 'Supplier ' || k else {_ID.format('k')} end cik, "
    "y fin_year, q fin_qtr, cast(rev as double) revenue, cast(rev - 0.25 as double) earnings, "
    "cast(cast(n * 0.01 as decimal(18,2)) as double) eps, cast(rev + 1 as double) assets, "
    "cast(rev * 2 as double) liabilities from (select l_suppkey k, cast(year(l_shipdate) as int) y, "
    f"cast(quarter(l_shipdate) as int) q, sum({_MONEY}) rev, count(*) n from lineitem group by 1, 2, 3))",
    "priced as (select cast(l_shipdate as date) market_date, 'S' || l_partkey symbol, "
    "max(l_extendedprice) close_price, cast(max(cast(l_extendedprice as decimal(18,2))) + 0.5 as double) high_price, "
    "min(l_extendedprice) low_price, cast(sum(cast(l_quantity as bigint)) as bigint) volume from lineitem group by 1, 2)",
    "last_order as (select o_custkey, max(o_orderkey) k from orders group by 1)",
    "holder as (select 'A' || o.o_custkey account_id, 'C' || o.o_custkey || '-' || o_orderstatus customer_id, "
    "o_orderpriority account_name, o_orderstatus tax_status from orders o join last_order on k = o_orderkey "
    "and last_order.o_custkey = o.o_custkey)",
    "deal as (select l_orderkey * 10 + l_linenumber trade_id, strftime(l_shipdate, '%Y-%m-%d') trade_dts, "
    "'S' || l_partkey symbol, 'A' || o_custkey account_id, cast(l_quantity as bigint) quantity, "
    "l_extendedprice trade_price, l_returnflag from lineitem, orders where o_orderkey = l_orderkey)",
    "booked as (select d.*, quantity * trade_price trade_value, customer_id, cik, company_name from deal d "
    "left join holder using (account_id) left join held using (symbol))",
]


def _financials(rows: str) -> str:
    return f"(select q.*, company_name, industry_name from {rows} q left join firm using (cik))"


def _company_report(rows: str) -> str:
    newest = (f"(select cik, {_mean('revenue', 2)} latest_revenue, {_mean('eps', 4)} latest_eps from (select *, "
              f"rank() over (partition by cik order by fin_year * 10 + fin_qtr desc) r from {rows}) where r = 1 "
              "group by 1)")
    return (f"select f.cik, f.company_name, f.industry_name, count(symbol) n_securities, "
            f"any_value(latest_revenue) latest_revenue, any_value(latest_eps) latest_eps from firm f "
            f"left join held h on h.cik = f.cik left join {newest} n on n.cik = f.cik group by 1, 2, 3")


def _financial_summary(rows: str) -> str:
    return (f"select cik, company_name, fin_year, {_half_up(_sum('revenue'), '1', 2)} annual_revenue, "
            f"{_mean('eps', 4)} avg_eps, count(*) n_quarters from {_financials(rows)} group by 1, 2, 3")


def _financial_detail(rows: str) -> str:
    return (f"select cik, company_name, fin_year, fin_qtr, round(revenue, 2) revenue, round(eps, 4) eps, "
            f"round(assets, 2) assets from {_financials(rows)}")


_DAY = "strftime(market_date, '%Y-%m-%d') market_date"
_MET = "priced left join held using (symbol)"
EXPECTED = {
    "stg_company": f"select cik, company_name, 'ACTV' status, industry_id, 'AA+' sp_rating, '{_NEW}' pts from firm",
    "stg_security": "select symbol, 'COMMON' issue_type, 'ACTV' status, security_name, 'NYSE' ex_id, "
                    "qty shares_outstanding, dividend, coalesce(company, '') co_name_or_cik from share",
    "stg_financial": "select * from quarterly",
    "stg_daily_market": f"select {_DAY}, * exclude (market_date) from priced",
    "stg_trade": "select * exclude (l_returnflag), 'CMPT' status_id, l_returnflag trade_type_id from deal",
    "stg_account": "select * from holder",
    "dim_company": "select cik, company_name, 'ACTV' status, industry_id, 'AA+' sp_rating, industry_name from firm",
    "dim_security": "select symbol, 'COMMON' issue_type, 'ACTV' status, security_name, 'NYSE' ex_id, "
                    "qty shares_outstanding, dividend, coalesce(company, '') co_name_or_cik, cik, company_name, "
                    "industry_name from held",
    "fact_financials": f"select * from {_financials('quarterly')}",
    "fact_market_history": f"select {_DAY}, symbol, close_price, high_price, low_price, volume, cik, company_name, "
                           f"case when security_name is not null then 'COMMON' end issue_type from {_MET}",
    "fact_trade": "select * exclude (l_returnflag) from booked",
    "mart_company_report": _company_report("quarterly"),
    "mart_financial_summary": _financial_summary("quarterly"),
    "mart_security_report": f"select symbol, any_value(company_name) company_name, 'COMMON' issue_type, "
                            f"{_mean('close_price', 4)} avg_close, max(high_price) max_high, "
                            f"cast(sum(volume) as bigint) total_volume, count(*) n_days from {_MET} group by 1",
    "mart_market_daily": f"select strftime(market_date, '%Y-%m-%d') market_date, {_mean('close_price', 4)} avg_close, "
                         "cast(sum(volume) as bigint) total_volume, count(*) n_symbols from priced group by 1",
    "mart_customer_report": f"select customer_id, count(*) n_trades, {_half_up(_sum('trade_value'), '1', 2)} "
                            f"total_trade_value, {_mean('trade_price', 4)} avg_trade_price, "
                            "count(distinct symbol) n_symbols from booked where customer_id is not null group by 1",
    "mart_financial_detail": _financial_detail("quarterly"),
    "mart_security_master": "select symbol, security_name, 'COMMON' issue_type, 'ACTV' status, "
                            "qty shares_outstanding, dividend, cik, company_name, industry_name from held",
}


def _table(name: str):
    def run(spark, sf_dir):
        df = plain(wire_tables(spark, sf_dir, name)[name])
        if name in ("stg_trade", "fact_trade"):
            df = df.withColumn("trade_dts", F.date_format("trade_dts", "yyyy-MM-dd"))
        return df
    return run


for _name, _sql in EXPECTED.items():
    QUERIES[f"wire_{_name}"] = _table(_name)
    ORACLES[f"wire_{_name}"] = with_sql(BASE, _sql)


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn
    return add


_KEY = ["cik", "fin_year", "fin_qtr"]
#: What several tables read, each of them far shorter than lines and trades.
_STORED = ("stg_company", "stg_security", "stg_financial", "dim_company", "dim_security", "fact_financials")
_COLUMNS = "cik, fin_year, fin_qtr, revenue, earnings, eps, assets, liabilities"
_TARGETS = """wt as materialized (select *, row_number() over (order by h, cik, fin_year, fin_qtr) p from
    (select cik, fin_year, fin_qtr, sha256('wire.mixed|' || cik || '|' || fin_year || '|' || fin_qtr) h
    from quarterly order by h, cik, fin_year, fin_qtr limit 40))"""
_DIRTY = f"""w0 as materialized (select f.* replace (case when wt.p <= 20 then revenue + 1e12 else revenue
    end as revenue), wt.p from quarterly f left join wt using (cik, fin_year, fin_qtr)),
    w1 as materialized (select {_COLUMNS} from w0 union all select {_COLUMNS} from w0 where p > 20),
    w2 as materialized (select {_COLUMNS} from (select *, row_number() over (partition by cik, fin_year,
    fin_qtr order by revenue) rn from w1) where rn = 1 and not coalesce(revenue < 0 or revenue >
    (select max(revenue) * 2 from quarterly), false))"""
_BELOW = {"mart_company_report": _company_report, "mart_financial_summary": _financial_summary,
          "mart_financial_detail": _financial_detail}
_VALUES = {
    "mart_company_report": ["company_name", "industry_name", "n_securities", "latest_revenue",
                            "latest_eps"],
    "mart_financial_summary": ["company_name", "annual_revenue", "avg_eps", "n_quarters"],
    "mart_financial_detail": ["company_name", "revenue", "eps", "assets"],
}
_BRANCH = [x for n, f in _BELOW.items() for x in (f"{n} as materialized ({f('quarterly')})",
                                                  f"{n}_w as materialized ({f('w2')})")]
_UNTOUCHED = [f"{n} as materialized ({EXPECTED[n]})" for n in BROKERAGE.sinks if n not in _BELOW]
_DAMAGE = " union all ".join(
    f"select '{n}' sink, '{s.kind}' kind, * from (" + (
        damage_sql(n, n + "_w", list(s.key), _VALUES[n]) if n in _BELOW else
        f"select 0::bigint changed, 0::bigint added, 0::bigint lost, count(*) n_clean, 0.0::double damage from {n}")
    + ")" for n, s in BROKERAGE.sinks.items())


@query(with_sql([*BASE, _TARGETS, _DIRTY, *_BRANCH, *_UNTOUCHED], _DAMAGE))
def wire_protected_branch(spark, sf_dir):
    """Twenty shifted and twenty copied quarterly records; copies are merged, shifts withheld."""
    node = "stg_financial"
    clean = BROKERAGE.store(wire_tables(spark, sf_dir), _STORED)
    targets = pin(pick_targets(clean[node], _KEY, 40, "wire.mixed"))
    first, second = split_targets(targets, 20)
    specs = [Injection(node, "numeric_add", first, tuple(_KEY), ("revenue",), 1e12),
             Injection(node, "duplicate_rows", second, tuple(_KEY))]
    bands = derive_bands({node: clean[node]}, {node: BROKERAGE.rules[node]})
    run = delta_run(BROKERAGE, clean, specs, {node: {
        "duplicate_shape": "dedup", "numeric_shape": "quarantine"}}, bands)
    return sink_damage(clean, run.tables, BROKERAGE.sinks, changes=run.changes)
