"""Delta runs give the tables of full runs, on every sink, with fewer jobs."""

from threading import Barrier

import pytest
from plain_rows import rows
from pyspark.sql import functions as F

from dqspark.operators.damage import sink_base, sink_damage
from dqspark.operators.injection import Injection, inject_all
from dqspark.operators.signals import Rule, derive_bands, hit_keys, key_profile
from dqspark.operators.targets import pick_targets, pin, split_targets
from dqspark.plans import delta
from dqspark.plans.delta import delta_run
from dqspark.plans.lineage import Lineage, Node, Sink, cut, protected_run
from dqspark.plans.star import STAR, sources
from dqspark.queries import cases
from dqspark.session import materialize

SF = "/root/testdata/sf0.001"
ALL = {"duplicate_shape": "dedup", "numeric_shape": "quarantine", "null_shape": "quarantine", "fk_shape": "null_out"}


@pytest.fixture(scope="module")
def star(spark):
    return STAR.store(STAR.build(sources(spark, SF)))


@pytest.fixture(scope="module")
def bands(star):
    return derive_bands({n: star[n] for n in STAR.rules}, STAR.rules)


def same(lineage, clean, specs, plan, bands, **options):
    """Both runs agree in every table, in what fired and in the damage of every sink."""
    full = protected_run(lineage, clean, specs, plan, bands, keep=materialize, **options)
    part = delta_run(lineage, clean, specs, plan, bands, **options)
    assert (part.fired, part.acted, part.verdicts) == (full.fired, full.acted, full.verdicts)
    assert part.suppressed_at == full.suppressed_at
    for name in lineage.names():
        a, b = full.tables[name], part.tables[name]
        if name not in part.changes:
            assert b is clean[name] and a is b
        elif name in lineage.sinks:
            assert rows(b, *a.columns) == rows(a)
    sizes = materialize(sink_base(clean, lineage.sinks))
    for form, base in (("keyset", sizes), ("multiset", sizes), ("keyset", None))[:None if lineage is TWINS else 1]:
        want = sink_damage(clean, full.tables, lineage.sinks, form)
        got = sink_damage(clean, part.tables, lineage.sinks, form, changes=part.changes, base=base)
        assert rows(got, *want.columns) == rows(want)
    return part


def test_orders_in_every_routing(star, bands):
    specs = cases.four_shapes(star["stg_orders"])
    for routing in ("live", "snapshot"):
        part = same(STAR, star, specs, {"stg_orders": ALL}, bands, routing=routing)
        assert not any(c.whole for c in part.changes.values()) and len(part.changes) == 9
    same(STAR, star, cases.overlap(star["stg_orders"]),
         {"stg_orders": {"duplicate_shape": "dedup", "conflict": "quarantine"}}, bands, scope="chain", routing="verdict")


def test_two_loci_and_planned_tables_below(star, bands):
    part_keys = pin(pick_targets(star["stg_part"], ("partkey",), 5, "delta"))
    a, b = split_targets(part_keys, 3)
    specs = [*cases.mixed(star["stg_orders"]), Injection("stg_part", "numeric_add", a, ("partkey",), ("retail_price",), 1e6),
             Injection("stg_part", "duplicate_rows", b, ("partkey",))]
    part = same(STAR, star, specs, {}, bands)
    assert part.changes["fact_lineitem"].whole         # reached through parts and through orders
    same(STAR, star, specs[2:], {"dim_part": ALL}, bands)
    same(STAR, star, specs, {"fact_order": cases.CONDITIONAL, "stg_part": {"numeric_shape": "null_out"}}, bands, scope="chain")


def test_deleted_and_orphaned_rows_reach_every_sink(star, bands):
    first, second = split_targets(cases.order_targets(star["stg_orders"]), 20)
    same(STAR, star, [cases.delete(first), cases.orphan(second)], {}, bands)
    lines = ("orderkey", "partkey", "suppkey", "linenumber")
    picked = pin(pick_targets(star["stg_lineitem"], lines, 30, "delta"))
    same(STAR, star, [Injection("stg_lineitem", "null_out", picked, lines, ("extended_price",))],
         {"fact_lineitem": {"null_shape": "quarantine"}}, bands)


def test_chain_acts_on_clean_tables_and_stops(star, bands):
    low, high = bands["stg_orders"]
    tight = {**bands, "stg_orders": (low, high / 4)}
    plan = {"stg_orders": {"numeric_shape": "quarantine"}, "fact_order": {"duplicate_shape": "fail_closed"}}
    same(STAR, star, cases.mixed(star["stg_orders"]), plan, tight, scope="chain", with_errors=False)
    same(STAR, star, cases.mixed(star["stg_orders"]), plan, tight, scope="chain")
    same(STAR, star, cases.mixed(star["stg_orders"]), {"stg_orders": {"null_shape": "quarantine"}}, bands, oracle=True)


def test_source_errors(star, bands):
    keys = pin(pick_targets(star["orders"], ("o_orderkey",), 4, "delta"))
    spec = Injection("orders", "numeric_add", keys, ("o_orderkey",), ("o_totalprice",), 1e7)
    same(STAR, star, [spec], {"fact_order": {"numeric_shape": "quarantine"}}, bands, scope="chain")


TWINS = Lineage(
    nodes=(Node("items", ("raw",), lambda t: t["raw"], {"raw": cut("k", "raw")}),
           Node("out", ("items",), lambda t: t["items"].select("g", "v"), {"items": cut("g", "items")})),
    rules={"items": Rule(("k",), "v")},
    sinks={"out": Sink(("g",), "row_preserving", ("v",))})


def test_sinks_with_several_rows_a_key(spark):
    raw = [(i, i % 4 if i % 5 else None, i % 3) for i in range(30)] + [(None, None, 7), (None, 2, 7)]
    clean = TWINS.store(TWINS.build({"raw": spark.createDataFrame(raw, "k int, g int, v int")}))
    t = pin(spark.createDataFrame([(3,), (11,)], "k int"))
    for mode in ("numeric_add", "duplicate_rows", "delete_rows"):
        same(TWINS, clean, [Injection("items", mode, t, ("k",), ("v",) if mode == "numeric_add" else (), 500)],
             {"items": {"numeric_shape": "quarantine", "duplicate_shape": "dedup"}}, {"items": (0, 100)})


def test_hits_are_checked_for_all_errors_at_once(spark, star):
    orders = star["stg_orders"]
    t = cases.order_targets(orders, 6, "delta.hits")
    a, b = split_targets(t, 3)
    twice = [cases.duplicate(a), cases.numeric(a)]
    with pytest.raises(ValueError, match="hits 6 rows of stg_orders, expected 3"):
        inject_all(orders, twice)
    with pytest.raises(ValueError, match="hits 0"):
        inject_all(orders, [cases.delete(a), cases.blank(a)])
    with pytest.raises(ValueError, match="expected 4"):
        more = spark.createDataFrame([(-5, 4)], "orderkey long, position int")
        inject_all(orders, [cases.numeric(a.select("orderkey", "position").unionByName(more))])
    got = inject_all(orders, [cases.delete(a), cases.duplicate(b)])
    assert got.count() == orders.count()


def test_few_jobs_before_the_damage(spark, star, bands):
    specs = cases.mixed(star["stg_orders"])
    tracker, group = spark.sparkContext.statusTracker(), "delta-jobs"
    spark.sparkContext.setJobGroup(group, group)
    delta_run(STAR, star, specs, {"stg_orders": cases.CONDITIONAL}, bands)
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup(None, None)
    print("jobs", jobs)
    assert jobs <= 40


def test_branches_share_what_fires_on_the_clean_table(star, bands, monkeypatch):
    """A second branch does not search the clean orders again, also where other rows were changed."""
    searched = []
    real = delta.hit_keys

    def counted(df, *args):
        searched.append(df)
        return real(df, *args)

    monkeypatch.setattr(delta, "hit_keys", counted)
    specs, fires = cases.four_shapes(star["stg_orders"]), {}
    for with_errors in (True, False):
        part = delta_run(STAR, star, specs, {"stg_orders": ALL}, bands, with_errors=with_errors, fires=fires)
        full = protected_run(STAR, star, specs, {"stg_orders": ALL}, bands, with_errors=with_errors)
        assert part.fired == full.fired
        assert rows(part.tables["stg_orders"]) == rows(full.tables["stg_orders"])
    assert len(searched) == 1 and searched[0] is star["stg_orders"]


def test_a_few_hit_keys_do_not_move_the_table(star, bands):
    """The keys that fire are stored before they meet the table, so Spark knows that they are few."""
    specs = cases.mixed(star["stg_orders"])
    part = delta_run(STAR, star, specs, {"stg_orders": ALL}, bands)
    plan = part.tables["stg_orders"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    moved = Rule(("orderkey",), "total_price", "total_price", ("custkey", "stg_customer", "custkey"))
    tight = (0.0, bands["stg_orders"][1] / 4)
    got = hit_keys(star["stg_orders"], moved, tight, star["stg_customer"])
    want = key_profile(star["stg_orders"], moved, tight, star["stg_customer"]).filter(
        "numeric_shape + null_shape + fk_shape > 0")
    assert rows(got.distinct()) == rows(want.select("orderkey")) and got.count() > 0


def test_lines_move_without_the_names_of_their_parts(spark, star):
    """The join with parts comes last, and a count by part needs no further shuffle."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lines = STAR.node("fact_lineitem").build(star)
        plan = STAR.node("mart_part_report").build({"fact_lineitem": lines})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 4


def test_lookups_that_nothing_reads_do_not_move_lines(star, bands):
    """Orders that go only blank a column of their lines, which no table below reads: the reports by part and
    date stay without reading a line again, and the lines themselves are those of the full run."""
    specs = cases.mixed(star["stg_orders"])
    tight = {"stg_orders": (0.0, bands["stg_orders"][1] / 4)}
    for plan, with_errors in (({"stg_orders": {"numeric_shape": "quarantine"}}, False), ({}, True)):
        full = protected_run(STAR, star, specs, plan, tight, with_errors=with_errors, keep=materialize)
        part = delta_run(STAR, star, specs, plan, tight, with_errors=with_errors)
        for name in ("fact_lineitem", "mart_part_report", "mart_daily_ship", "mart_order_year"):
            assert rows(part.tables[name], *full.tables[name].columns) == rows(full.tables[name])
        assert part.changes["fact_order"].added.count() > 0 or not with_errors
        assert (part.changes["mart_part_report"].keys.count() == 0) == (not with_errors)


def test_lines_that_are_not_stored_meet_only_the_repeated_orders_and_parts(spark, bands):
    raw = sources(spark, SF)
    raw["orders"] = raw["orders"].unionByName(raw["orders"].filter("o_orderkey < 30"))
    raw["part"] = raw["part"].unionByName(raw["part"].filter("p_partkey < 9").withColumn("p_brand", F.lit("other")))
    lost = raw["lineitem"].filter("l_orderkey between 20 and 60").withColumns(
        {"l_shipdate": F.lit(None).cast("timestamp_ntz"), "l_partkey": F.expr("if(l_orderkey % 2 = 0, l_partkey, null)")})
    raw["lineitem"] = raw["lineitem"].unionByName(lost)
    whole = STAR.store(STAR.build(raw))
    thin = STAR.store(STAR.build(raw), [*STAR.sinks, "stg_orders", "fact_order"])
    assert not whole.lean
    assert set(thin.lean) == {(m, "fact_lineitem") for m in ("mart_part_report", "mart_daily_ship")}
    plan = thin.lean["mart_part_report", "fact_lineitem"]._jdf.queryExecution().optimizedPlan().toString()
    assert "o_custkey" not in plan                      # the lines do not meet the whole orders
    for name in STAR.sinks:
        assert rows(thin[name]) == rows(whole[name])
    lines = whole["fact_lineitem"]
    assert rows(thin["mart_daily_ship"].select("ship_date", "n_parts")) == rows(
        lines.groupBy("ship_date").agg(F.count_distinct("partkey").alias("n_parts")))
    specs = [*cases.mixed(thin["stg_orders"]), cases.delete(cases.order_targets(thin["stg_orders"], 5, "delta.thin"))]
    a = same(STAR, thin, specs, {}, bands, strict=False)
    b = delta_run(STAR, whole, specs, {}, bands, strict=False)
    assert a.changes.keys() == b.changes.keys()
    for name in STAR.sinks:
        assert rows(a.tables[name]) == rows(b.tables[name])
    same(STAR, thin, specs, {"stg_orders": ALL}, bands, strict=False)
    parts = pin(pick_targets(thin["stg_part"], ("partkey",), 5, "delta"))
    copies = Injection("stg_part", "duplicate_rows", parts, ("partkey",))
    same(STAR, thin, [copies], {"stg_part": {"duplicate_shape": "dedup"}}, bands, strict=False)
    same(STAR, thin, [copies], {}, bands, strict=False)


def test_sink_base_compares_rows_only_where_keys_repeat(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (None, 1), (None, 2)], "k int, v int")
    more = df.union(spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "k int, v int"))
    sinks = {n: Sink(("k",), "row_preserving", ("v",)) for n in ("once", "more")}
    got = sink_base({"once": df, "more": more}, sinks)
    assert sorted(map(tuple, got.collect())) == [("more", 7, 4), ("once", 4, 0)]
    plan = sink_base({"once": df}, {"once": sinks["once"]})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "xxhash64" not in plan


def test_rows_that_a_tight_rule_finds_are_searched_once(star, bands, monkeypatch):
    low, high = bands["stg_orders"]
    searched, within = [], delta.within
    monkeypatch.setattr(delta, "within", lambda df, keys, cols: searched.append(df) or within(df, keys, cols))
    run = delta_run(STAR, star, cases.mixed(star["stg_orders"]), {"stg_orders": {"numeric_shape": "quarantine"}},
                    {**bands, "stg_orders": (low, high / 4)}, with_errors=False)
    assert run.acted["stg_orders"] and sum(df is star["stg_orders"] for df in searched) == 1
    gone = star["stg_orders"].filter(F.col("total_price") > high / 4)
    assert rows(run.changes["stg_orders"].removed) == rows(gone)
    assert run.changes["stg_orders"].added.isEmpty()


def test_branches_of_a_snapshot_run_at_the_same_time(spark, monkeypatch):
    clean = TWINS.store(TWINS.build({"raw": spark.createDataFrame([(i, i % 4, i % 3) for i in range(30)], "k int, g int, v int")}))
    spec = Injection("items", "numeric_add", pin(spark.createDataFrame([(3,), (11,)], "k int")), ("k",), ("v",), 500)
    families = {"shifts": ([spec], "items", "numeric_shape", ("quarantine", "null_out"))}
    want = rows(delta.responses(TWINS, clean, families, {"items": (0, 100)}))
    met, run = Barrier(3), delta.delta_run
    monkeypatch.setattr(delta, "delta_run", lambda *a, **o: (met.wait(30), run(*a, **o))[1])
    assert rows(delta.responses(TWINS, clean, families, {"items": (0, 100)})) == want
    monkeypatch.setattr(delta, "delta_run", run)
    monkeypatch.setattr(delta, "BRANCHES", 1)
    assert rows(delta.responses(TWINS, clean, families, {"items": (0, 100)})) == want and len(want) == 2
