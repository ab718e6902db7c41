import csv
import io
import random

import pytest
from plain_rows import rows

from dqspark.plans.brokerage import BROKERAGE
from dqspark.sources.load import load_brokerage, load_shop
from dqspark.sources.manifest import load_manifest, read_shards, shard_counts, write_shard
from dqspark.sources import readers
from dqspark.sources.readers import (read_actions_xml, read_contract, read_delimited,
                                     read_fixed_width_lines)

NS = 'xmlns:TPCDI="http://www.tpc.org/tpc-di"'


def cmp_line(pts, name, cik):
    return f"{pts:15}CMP{name:60}{cik:10}ACTVMFAA+ "


def sec_line(symbol, company, dividend="1.25", shares="1000"):
    return (f"{'19990101-000000':15}SEC{symbol:15}COMMONACTV{'Share ' + symbol:70}NYSE  {shares:>13}"
            f"{'1999010119990101'}{dividend:>12}{company:60}")


def fin_line(year, quarter, revenue, cik):
    return (f"{'20000101-000000':15}FIN{year}{quarter}{'':16}{revenue:>17}{'10.5':>17}{'0.25':>12}"
            f"{'':41}{'99.5':>17}{'1.5':>17}{'':26}{cik:60}")


XML = f"""<?xml version="1.0" encoding="UTF-8"?>
<TPCDI:Actions {NS}>
<TPCDI:Action ActionType="NEW" ActionTS="2007-07-07T05:00:00"><Customer C_ID="1" C_TAX_ID="t1" C_GNDR="F"
 C_TIER="2" C_DOB="1980-01-01"><Name><C_L_NAME> Li </C_L_NAME><C_F_NAME>Mo</C_F_NAME></Name>
<Address><C_ADLINE1>1 Way</C_ADLINE1><C_ZIPCODE>00123</C_ZIPCODE></Address>
<ContactInfo><C_PRIM_EMAIL>a@b.c</C_PRIM_EMAIL><C_PHONE_1><C_CTRY_CODE>1</C_CTRY_CODE>
<C_AREA_CODE>22</C_AREA_CODE><C_LOCAL>333</C_LOCAL><C_EXT></C_EXT></C_PHONE_1></ContactInfo>
<TaxInfo><C_LCL_TX_ID>L</C_LCL_TX_ID></TaxInfo>
<Account CA_ID="10" CA_TAX_ST="1"><CA_B_ID>5</CA_B_ID><CA_NAME>first</CA_NAME></Account>
<Account CA_ID="11" CA_TAX_ST="0"><CA_B_ID>6</CA_B_ID><CA_NAME>second</CA_NAME></Account>
</Customer></TPCDI:Action>
<TPCDI:Action ActionType="UPDCUST" ActionTS="2007-08-01T00:00:00"><Customer C_ID="2"/></TPCDI:Action>
<TPCDI:Action ActionType="ADDACCT" ActionTS="2008-01-01T00:00:00"><Customer C_ID="1">
<Account CA_ID="10" CA_TAX_ST="2"><CA_B_ID>7</CA_B_ID><CA_NAME>renamed</CA_NAME></Account>
</Customer></TPCDI:Action>
<TPCDI:Action ActionType="CLOSEACCT" ActionTS="2009-01-01T00:00:00" C_ID="1">
<Account CA_ID="11" CA_TAX_ST="9"/></TPCDI:Action>
</TPCDI:Actions>
"""


@pytest.fixture(scope="module")
def batch(tmp_path_factory):
    folder = tmp_path_factory.mktemp("batch")
    (folder / "FINWIRE1999Q1").write_text("\n".join([
        cmp_line("19980101-000000", "Old Name", "0000000001"),
        cmp_line("19990101-000000", "New Name", "0000000001"),
        sec_line("AAA", "0000000001"), sec_line("BBB", "New Name", dividend="x"),
        fin_line(1999, 1, "100.255", "0000000001"), fin_line(1999, 2, "oops", "0000000001")]) + "\n")
    (folder / "FINWIRE1999Q2").write_text("\n".join(
        fin_line(1999, 3, str(i), "0000000009") for i in range(40)) + "\n")
    (folder / "FINWIRE1999Q1_audit.csv").write_text("not,a,wire\n")
    (folder / "Industry.txt").write_text("MF|Manufacturing|XX\n")
    (folder / "DailyMarket.txt").write_text(
        "2000-01-03|AAA|10.5|11|10|100\n2000-01-04|AAA|11.5|12|11|50\n2000-01-03|ZZZ|1|1|1|1\n")
    (folder / "Trade.txt").write_text(
        "1|2000-01-03 10:00:00|CMPT|TMB|1|AAA|10|10|10|X|10.25|0|0|0\n"
        "2|2000-01-04 10:00:00|CMPT|TMB|1|ZZZ|2|5|99|X|5.5|0|0|0\n")
    (folder / "HR.csv").write_text("1,2,Ann,Bo,C,314,B,O,1\n")
    (folder / "CustomerMgmt.xml").write_text(XML)
    return str(folder)


def test_lines_are_numbered_per_file_across_splits(spark, batch):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = read_fixed_width_lines(spark, batch, "FINWIRE*")
        got = rows(lines, "source_file", "line_no", "line")
        assert spark.read.text(batch + "/FINWIRE1999Q2").rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = []
    for name in ("FINWIRE1999Q1", "FINWIRE1999Q2"):
        with open(f"{batch}/{name}") as fh:
            want += [(name, i, line.rstrip("\n")) for i, line in enumerate(fh)]
    assert got == sorted(want, key=lambda t: tuple((False, str(x)) for x in t))


def test_load_and_build_the_brokerage_lineage(spark, batch):
    raw, manifest = load_brokerage(spark, batch)
    status = {r["table"]: (r["rows"], r["status"]) for r in manifest.collect()}
    assert status["raw_finwire"] == (46, "ok") and status["raw_hr"] == (1, "ok")
    assert status["raw_prospect"] == (0, "missing")
    assert status["raw_customer_actions"] == (3, "ok")
    assert status["raw_account_actions"] == (4, "ok")
    t = BROKERAGE.build(raw)
    assert rows(t["dim_company"], "cik", "company_name", "industry_name") == [
        ("0000000001", "New Name", "Manufacturing")]
    assert rows(t["dim_security"], "symbol", "dividend", "cik") == [
        ("AAA", 1.25, "0000000001"), ("BBB", None, None)]
    assert rows(t["mart_company_report"], "cik", "n_securities", "latest_revenue", "latest_eps") == [
        ("0000000001", 1, None, 0.25)]
    assert rows(t["stg_account"]) == [("10", "1", "renamed", "2"), ("11", "1", None, "9")]
    assert rows(t["mart_customer_report"]) == [("1", 1, 102.5, 10.25, 1)]
    assert rows(t["mart_market_daily"].selectExpr("string(market_date)", "n_symbols")) == [
        ("2000-01-03", 2), ("2000-01-04", 1)]
    detail = rows(t["mart_financial_detail"], "cik", "fin_qtr", "revenue")
    assert ("0000000001", 1, 100.26) in detail and ("0000000001", 2, None) in detail


def test_xml_actions(spark, batch):
    raw, _ = load_brokerage(spark, batch)
    c = raw["raw_customer_actions"].orderBy("action_seq").collect()
    assert [r["action_seq"] for r in c] == [1, 2, 3] and len(c[0].asDict()) == 24
    assert c[0]["c_l_name"] == "Li" and c[0]["c_phone_1"] == "1|22|333|" and c[0]["c_zipcode"] == "00123"
    assert c[0]["c_phone_2"] is None and c[1]["c_f_name"] is None
    a = raw["raw_account_actions"]
    assert rows(a, "action_seq", "c_id", "ca_id", "ca_name") == [
        (1, "1", "10", "first"), (1, "1", "11", "second"), (3, "1", "10", "renamed"),
        (4, "1", "11", None)]


def shop(folder, orders_header="id,customer,ordered_at,store_id,subtotal,tax_paid,order_total"):
    texts = {"raw_customers.csv": "id,name\nc1,A\n",
             "raw_order_items.csv": "id,order_id,sku\ni1,o1,s1\n",
             "raw_orders.csv": f"{orders_header}\no1,c1,2020-01-01T00:00:00,st1,10,1,11\n",
             "raw_products.csv": "sku,name,type,price,description\ns1,x,y,700,\"a, b\"\n",
             "raw_stores.csv": "id,name,opened_at,tax_rate\nst1,S,2019-01-01T00:00:00,0.06\n",
             "raw_supplies.csv": "id,name,cost,perishable,sku\nu1,n,5,true,s1\n"}
    for name, text in texts.items():
        (folder / name).write_text(text)
    return str(folder)


def test_header_contract(spark, tmp_path):
    tables = load_shop(spark, shop(tmp_path))
    assert set(tables) == {"raw_customers", "raw_items", "raw_orders", "raw_products", "raw_stores",
                           "raw_supplies"}
    assert tables["raw_products"].first()["description"] == "a, b"
    shop(tmp_path, "id,ordered_at,customer,store_id,subtotal,tax_paid,order_total")
    with pytest.raises(ValueError, match="contract"):
        load_shop(spark, str(tmp_path))
    (tmp_path / "raw_customers.csv").write_text("id,name\n")
    shop_ok = "id string, name string"
    assert read_contract(spark, str(tmp_path / "raw_customers.csv"), shop_ok).count() == 0


def test_absent_file_is_none_and_bad_lines_are_kept(spark, tmp_path):
    assert read_delimited(spark, str(tmp_path / "No.txt"), "a int") is None
    (tmp_path / "T.txt").write_text("1|x\nbad|y\n2\n3|z|more\n\n")
    df = read_delimited(spark, str(tmp_path / "T.txt"), "a int, b string")
    assert rows(df) == [(1, "x", None), (2, None, "2"), (3, "z", "3|z|more"), (None, "y", "bad|y")]
    assert df.filter("_corrupt is not null").count() == 3 and df.select("b").count() == 4
    bad = load_manifest(spark, {"t": ("T.txt", df)}).first()
    assert (bad["rows"], bad["rejected"], bad["status"]) == (4, 3, "rejected lines")


def test_decimal_contract_and_broken_lines(spark, tmp_path):
    (tmp_path / "P.csv").write_text("a,b\n1.50,x\n")
    schema = "a decimal(18,2), b string"
    assert str(read_contract(spark, str(tmp_path / "P.csv"), schema).first()["a"]) == "1.50"
    (tmp_path / "P.csv").write_text("a,b\n1.50,x\nten,y\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_contract(spark, str(tmp_path / "P.csv"), schema).select("b").collect()


@pytest.fixture
def cut(spark):
    """Cuts files into splits of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def set_size(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
    yield set_size
    for n, v in before.items():
        spark.conf.set(n, v)


QUOTED = '1|"a\nb"\n2|"say ""hi""|x"\n3|12" pipe\n4|"\n\n""|\n5|""\n"\n6|plain\n'


@pytest.mark.parametrize("size", [1, 3, 13, 1000])
def test_quoted_line_breaks_survive_any_cut(spark, tmp_path, cut, size):
    (tmp_path / "Q.txt").write_text(QUOTED)
    cut(size)
    df = read_delimited(spark, str(tmp_path / "Q.txt"), "a int, b string")
    want = [(1, "a\nb", None), (2, 'say "hi"|x', None), (3, '12" pipe', None),
            (4, '\n\n"|\n5|"\n', None), (6, "plain", None)]
    assert sorted(tuple(r) for r in df.collect()) == want


@pytest.mark.parametrize("seed", range(2))
def test_random_quoted_records_equal_a_plain_parser(spark, tmp_path, cut, seed):
    rng = random.Random(seed)
    wanted = []
    for name in ("a.txt", "b.txt"):           # states do not run on from one file into the next
        made = [(str(i), "".join(rng.choice('x"|\n') for _ in range(rng.randint(1, 9))), name) for i in range(40)]
        text = io.StringIO()
        csv.writer(text, delimiter="|", lineterminator="\n").writerows(made)
        (tmp_path / name).write_text(text.getvalue())
        wanted += made
    cut(rng.choice([5, 17, 64]))
    df = read_delimited(spark, str(tmp_path / "*.txt"), "id string, text string, file string")
    assert sorted(map(tuple, df.collect())) == sorted((*w, None) for w in wanted)


def test_open_quotes_and_long_records_break_their_lines_only(spark, tmp_path, monkeypatch):
    (tmp_path / "O.txt").write_text('1|"a\nb"\n2|"never\n3|c\n4|d\n')
    df = read_delimited(spark, str(tmp_path / "O.txt"), "a int, b string")
    got = {r["a"]: (r["b"], r["_corrupt"]) for r in df.collect()}
    assert got[1] == ("a\nb", None) and got[3] == ("c", None) and got[4] == ("d", None) and 2 in got
    monkeypatch.setattr(readers, "RECORD_MOST", 4)
    df = read_delimited(spark, str(tmp_path / "O.txt"), "a int, b string")
    assert df.filter("_corrupt is not null").count() >= 1 and df.count() == 5


def test_lines_without_open_quotes_are_not_shuffled(spark, tmp_path):
    (tmp_path / "P.txt").write_text('1|"a"\n2|b "c"\n')
    plan = read_delimited(spark, str(tmp_path / "P.txt"), "a int, b string")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan


@pytest.mark.parametrize("size", [4, 1000])
def test_only_the_first_line_of_a_file_is_its_header(spark, tmp_path, cut, size):
    (tmp_path / "h1.csv").write_text('a,b\n1,"x\ny"\na,b\n')
    (tmp_path / "h2.csv").write_text('a,b\n2,z\n')
    cut(size)
    df = read_contract(spark, str(tmp_path / "h*.csv"), "a string, b string")
    assert rows(df) == [("1", "x\ny"), ("2", "z"), ("a", "b")]
    (tmp_path / "h3.csv").write_text('b,a\n2,z\na,b\n')
    with pytest.raises(ValueError, match="begins with another line"):
        read_contract(spark, str(tmp_path / "h*.csv"), "a string, b string")


def test_lineage_builds_without_the_xml(spark, tmp_path):
    (tmp_path / "DailyMarket.txt").write_text("2000-01-03|AAA|11,5|12|11|50.0\n2000-01-03|AAA|11|12|11|50\n")
    raw, manifest = load_brokerage(spark, str(tmp_path))
    status = {r["table"]: (r["rows"], r["rejected"], r["status"]) for r in manifest.collect()}
    assert status["raw_dailymarket"] == (2, 1, "rejected lines")
    assert status["raw_account_actions"] == (0, 0, "missing")
    t = BROKERAGE.build(raw)
    assert t["mart_customer_report"].count() == 0 and t["mart_market_daily"].count() == 1
    assert raw["raw_customer_actions"].columns[:3] == ["action_seq", "action_type", "action_ts"]


def test_xml_is_cut_into_many_tasks(spark, batch):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        raw, _ = load_brokerage(spark, batch)
        got = rows(raw["raw_account_actions"], "action_seq", "c_id", "ca_id", "ca_name")
        assert spark.read.text(batch + "/CustomerMgmt.xml", lineSep="</TPCDI:Action>").rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(1, "1", "10", "first"), (1, "1", "11", "second"), (3, "1", "10", "renamed"),
                   (4, "1", "11", None)]


def test_xml_actions_with_wrapped_attributes(spark, tmp_path):
    text = XML
    for white in ("\n  ", "\t", "\r\n"):
        text = text.replace('<TPCDI:Action ActionType', f'<TPCDI:Action{white}ActionType', 1)
    (tmp_path / "CustomerMgmt.xml").write_bytes(text.encode())
    customers, accounts = read_actions_xml(spark, str(tmp_path / "CustomerMgmt.xml"))
    assert rows(customers, "action_seq", "c_id") == [(1, "1"), (2, "2"), (3, "1")]
    assert rows(accounts, "action_seq", "ca_id") == [(1, "10"), (1, "11"), (3, "10"), (4, "11")]


def test_result_shards(spark, tmp_path):
    folder = str(tmp_path / "results")
    schema = "campaign string, nrd double, status string"
    write_shard(spark.createDataFrame([("a", 0.5, "complete")], schema), folder, "1")
    write_shard(spark.createDataFrame([("b", None, "technical_failure")], schema), folder, "2")
    got = shard_counts(read_shards(spark, folder, schema)).first()
    assert (got["shards"], got["rows"], got["failures"]) == (2, 2, 1)


def test_actions_without_open_comments_are_not_sorted(spark, tmp_path):
    action = '<TPCDI:Action ActionType="ADDACCT"><Customer C_ID="{0}"><Account CA_ID="a{0}"/></Customer></TPCDI:Action>\n'
    inside = action.replace("<Customer", "<!-- none --><Customer")
    (tmp_path / "plain.xml").write_text("".join(inside.format(i) for i in range(9)))
    (tmp_path / "across.xml").write_text("".join(action.format(i) for i in range(3)) + "<!-- " + action.format(3) + " -->"
                                         + action.format(4))
    for name, ids, windows in (("plain", [*range(9)], False), ("across", [0, 1, 2, 4], True)):
        accounts = read_actions_xml(spark, str(tmp_path / f"{name}.xml"))[1]
        assert [tuple(r) for r in accounts.select("action_seq", "ca_id").orderBy("action_seq").collect()] == [
            (i + 1, f"a{k}") for i, k in enumerate(ids)]
        plan = accounts._jdf.queryExecution().optimizedPlan().toString()
        assert ("row_number" in plan) == windows
