import pytest
from pyspark.sql import functions as F

from dqspark.operators.damage import macro_damage, sink_damage
from dqspark.operators.injection import Injection
from dqspark.operators.signals import Rule
from dqspark.operators.targets import disjoint, pick_targets, split_targets, universe_report
from dqspark.plans.delta import measure, placement_grid
from dqspark.plans.lineage import Lineage, Node, Sink, protected_run
from dqspark.session import materialize

BANDS = {"items": (0, 100), "lines": (0, 100)}


def _lines(t):
    return t["items"].join(t["names"], "g", "left").select("k", "g", "v", "name")


def _sums(t):
    return t["lines"].groupBy("g").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


LINEAGE = Lineage(
    nodes=(Node("items", ("raw",), lambda t: t["raw"]),
           Node("names", ("raw_names",), lambda t: t["raw_names"]),
           Node("lines", ("items", "names"), _lines),
           Node("sums", ("lines",), _sums),
           Node("detail", ("lines",), lambda t: t["lines"].select("k", "v")),
           Node("labels", ("names",), lambda t: t["names"])),
    rules={"items": Rule(("k",), "v", "v"), "lines": Rule(("k",), "v", "v"),
           "names": Rule(("g",))},
    sinks={"sums": Sink(("g",), "aggregate", ("total", "n")),
           "detail": Sink(("k",), "row_preserving", ("v",)),
           "labels": Sink(("g",), "row_preserving", ("g",))})


@pytest.fixture(scope="module")
def clean(spark):
    return LINEAGE.build({
        "raw": spark.createDataFrame([(i, i % 5, i + 1) for i in range(20)], "k int, g int, v int"),
        "raw_names": spark.createDataFrame([(i, f"n{i}") for i in range(5)], "g int, name string")})


def shift(spark, *ks):
    t = spark.createDataFrame([(k,) for k in ks], "k int")
    return [Injection("items", "numeric_add", t, ("k",), ("v",), 1000)]


def by_sink(clean, run):
    return {r["sink"]: r for r in sink_damage(clean, run.tables, LINEAGE.sinks).collect()}


def test_suffix_rebuild_touches_descendants_only(spark, clean):
    assert LINEAGE.descendants(["items"]) == ["lines", "sums", "detail"]
    run = protected_run(LINEAGE, clean, shift(spark, 3, 8), {}, BANDS)
    got = by_sink(clean, run)
    assert run.tables["labels"] is clean["labels"]
    assert (got["sums"]["changed"], got["detail"]["changed"], got["labels"]["damage"]) == (1, 2, 0.0)
    means = {r["kind"]: r["damage"] for r in macro_damage(
        sink_damage(clean, run.tables, LINEAGE.sinks)).collect()}
    assert means["aggregate"] == pytest.approx(1 / 5)
    assert means["all"] == pytest.approx((1 / 5 + 2 / 20) / 3)


def test_a_plan_without_fires_does_no_harm(spark, clean):
    plan = {"items": {"numeric_shape": "quarantine", "duplicate_shape": "dedup"}}
    run = protected_run(LINEAGE, clean, shift(spark, 3), plan, BANDS, with_errors=False)
    assert run.fired["items"] == {"numeric_shape": 0, "duplicate_shape": 0} and not run.acted["items"]
    assert all(run.tables[s] is clean[s] for s in LINEAGE.sinks)


def test_cone_scope_leaves_other_tables_alone(spark, clean):
    dup = Injection("names", "duplicate_rows", spark.createDataFrame([(1,)], "g int"), ("g",))
    plan = {"items": {"numeric_shape": "quarantine"}, "lines": {"duplicate_shape": "dedup"}}
    tight = {"items": (0, 5), "lines": (0, 100)}
    run = protected_run(LINEAGE, clean, [dup], plan, tight)
    assert "items" not in run.acted and run.tables["items"] is clean["items"]
    assert run.fired["lines"] == {"duplicate_shape": 8}
    assert by_sink(clean, run)["sums"]["damage"] == 0.0          # the fan-out is undone
    chain = protected_run(LINEAGE, clean, [dup], plan, tight, scope="chain")
    assert chain.acted["items"] == {"numeric_shape": "quarantine"}
    assert by_sink(clean, chain)["detail"]["lost"] == 15


def test_oracle_targets_at_the_first_locus(spark, clean):
    plan = {"items": {"null_shape": "quarantine"}}
    run = protected_run(LINEAGE, clean, shift(spark, 3, 8), plan, BANDS, oracle=True)
    assert by_sink(clean, run)["detail"]["lost"] == 2


def test_fail_closed_keeps_stale_tables(spark, clean):
    plan = {"items": {"numeric_shape": "fail_closed"}}
    run = protected_run(LINEAGE, clean, shift(spark, 3), plan, BANDS, scope="chain")
    assert run.suppressed_at == "items" and run.availability_loss == 1.0
    assert all(r["damage"] == 0.0 for r in by_sink(clean, run).values())


def test_errors_in_a_source_table(spark, clean):
    spec = Injection("raw", "numeric_add", spark.createDataFrame([(4,)], "k int"), ("k",), ("v",), 1000)
    run = protected_run(LINEAGE, clean, [spec], {"lines": {"numeric_shape": "quarantine"}}, BANDS,
                        scope="chain", keep=materialize)
    got = by_sink(clean, run)
    assert got["detail"]["lost"] == 1 and run.fired["lines"]["numeric_shape"] == 1


def test_measure_relates_to_doing_nothing(spark, clean):
    plans = {"none": {"items": {"numeric_shape": "no_op"}},
             "quarantine": {"items": {"numeric_shape": "quarantine"}}}
    got = {r["plan"]: r for r in measure(LINEAGE, clean, "c1", shift(spark, 3), plans, BANDS).collect()}
    assert got["none"]["nrd"] == pytest.approx(1.0)
    # detail: 1/39 instead of 1/20; sums still changes in one of five groups
    assert got["quarantine"]["nrd"] == pytest.approx((1 / 5 + 1 / 39) / (1 / 5 + 1 / 20))
    assert got["quarantine"]["clean_absolute_damage"] == 0.0


def test_placement_grid(spark, clean):
    grid = placement_grid(LINEAGE, clean, "c1", shift(spark, 3),
                          {"quarantine": {"numeric_shape": "quarantine"}}, ("items", "lines"), BANDS)
    got = {r["placement"]: r["nrd"] for r in grid.collect()}
    assert got["items"] == pytest.approx(got["lines"])


def test_targets(spark, clean):
    first = pick_targets(clean["items"], ("k",), 6, "a")
    assert [r["position"] for r in first.collect()] == [1, 2, 3, 4, 5, 6]
    again = pick_targets(clean["items"].repartition(3), ("k",), 6, "a")
    assert sorted(first.collect()) == sorted(again.collect())
    fresh = pick_targets(clean["items"], ("k",), 6, "a", exclude=first)
    assert disjoint(first, fresh, ("k",)) and not disjoint(first, again, ("k",))
    a, b = split_targets(first, 2)
    assert (a.count(), b.count()) == (2, 4)
    got = universe_report({"items": clean["items"]}, {"items": first}).first()
    assert (got["universe"], got["excluded"]) == (20, 6)
