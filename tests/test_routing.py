import pytest
from plain_rows import rows

from dqspark.operators.dispositions import (action_report, route_live, route_snapshot,
                                            route_verdict)
from dqspark.operators.injection import Injection, inject_all
from dqspark.operators.signals import (Rule, detected_keys, fire_rates, flag, key_sample,
                                       orphan_values, signal_report)

SCHEMA = "k int, ref int, v double"
RULE = Rule(("k",), "v", "v", ("ref", "parent", "id"))
BAND = (0.0, 1000.0)
ALL = {s: "quarantine" for s in ("duplicate_shape", "numeric_shape", "null_shape", "fk_shape")}


@pytest.fixture(scope="module")
def parent(spark):
    return spark.createDataFrame([(i,) for i in range(10)] + [(None,)], "id int")


def clean(spark, n=40):
    return spark.createDataFrame([(i, i % 10, float(i)) for i in range(n)], SCHEMA)


def keys(spark, n):
    return spark.createDataFrame([(i,) for i in range(n)], "k int")


def overlap(spark, mode):
    """The same ten rows are corrupted and then copied."""
    first = (Injection("t", "numeric_add", keys(spark, 10), ("k",), ("v",), 1e12)
             if mode == "numeric" else
             Injection("t", "null_out", keys(spark, 10), ("k",), ("v",)))
    return inject_all(clean(spark), [first, Injection("t", "duplicate_rows", keys(spark, 10), ("k",))])


# Fire counts of the two overlap cells under live routing.
LIVE = [
    ("numeric", {"duplicate_shape": "dedup", "numeric_shape": "quarantine",
                 "null_shape": "quarantine"}, (20, 10, 0), 30),
    ("numeric", {"duplicate_shape": "dedup"}, (20,), 40),
    ("numeric", {"numeric_shape": "quarantine"}, (20,), 30),
    ("numeric", {"null_shape": "quarantine"}, (0,), 50),
    ("numeric", {s: "quarantine" for s in list(ALL)[:3]}, (20, 0, 0), 30),
    ("null", {"duplicate_shape": "dedup", "numeric_shape": "quarantine",
              "null_shape": "quarantine"}, (20, 0, 10), 30),
    ("null", {"null_shape": "quarantine"}, (20,), 30),
    ("null", {s: "quarantine" for s in list(ALL)[:3]}, (20, 0, 0), 30),
]


@pytest.mark.parametrize("mode,policy,fired,left", LIVE)
def test_live_fire_counts(spark, parent, mode, policy, fired, left):
    state = route_live(overlap(spark, mode), RULE, policy, BAND, parent, count=True)
    assert tuple(state.fired.values()) == fired
    assert state.df.count() == left


def test_snapshot_counts_every_shape_on_the_arriving_state(spark, parent):
    dirty = overlap(spark, "numeric")
    state = route_snapshot(dirty, RULE, ALL, BAND, parent, count=True)
    assert state.fired == {"duplicate_shape": 10, "numeric_shape": 10, "null_shape": 0, "fk_shape": 0}
    assert state.df.count() == 30


def test_report_in_rows_and_keys(spark, parent):
    df = clean(spark).unionByName(spark.createDataFrame(
        [(1, 1, 1.0), (50, 77, 5.0), (51, None, 5.0), (None, 1, None), (None, 1, 2e9)], SCHEMA))
    by_row = signal_report(df, RULE, BAND, parent).first()
    assert [by_row[s] for s in ALL] == [2, 1, 1, 1] and by_row["verdict"] == "multi"
    by_key = signal_report(df, RULE, BAND, parent, unit="keys").first()
    assert [by_key[s] for s in ALL] == [2, 1, 1, 1]         # the NULL key is a detected group
    flagged = flag(df, RULE, BAND, parent)
    assert flagged.filter("duplicate_shape").count() == 2
    rates = {r["shape"]: r["rate"] for r in fire_rates(df, RULE, BAND, parent).collect()}
    assert rates["fk_shape"] == pytest.approx(1 / 45)
    assert signal_report(clean(spark), RULE, BAND, parent).first()["verdict"] == "clear"
    assert detected_keys(df, RULE, BAND, parent).count() == 3


def test_absent_rules_never_fire(spark):
    got = signal_report(clean(spark), Rule(("k",)), None).first()
    assert [got[s] for s in ALL] == [0, 0, 0, 0]


def test_parent_null_silences_the_unguarded_rule(spark, parent):
    child = spark.createDataFrame([(99,), (99,), (1,), (None,)], "ref int")
    assert rows(orphan_values(child, "ref", parent, "id")) == [(99, 2)]
    assert orphan_values(child, "ref", parent, "id", null_guard=False).count() == 0
    whole = parent.filter("id is not null")
    assert orphan_values(child, "ref", whole, "id", null_guard=False).count() == 1


def test_payload_rule(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, name string")
    got = signal_report(df, Rule(("k",), fk_payload="name")).first()
    assert got["fk_shape"] == 1 and got["verdict"] == "fk_shape"


def test_dedup_of_another_shape_waits_for_its_signal(spark, parent):
    twice = inject_all(clean(spark), [Injection("t", "duplicate_rows", keys(spark, 5), ("k",))])
    policy = {"numeric_shape": "dedup"}
    assert route_live(twice, RULE, policy, BAND, parent).df.count() == 45
    shifted = inject_all(twice, [Injection("t", "numeric_add", spark.createDataFrame(
        [(30,)], "k int"), ("k",), ("v",), 1e9)])
    assert route_live(shifted, RULE, policy, BAND, parent).df.count() == 40
    # Snapshot routing treats the detected keys only.
    assert route_snapshot(shifted, RULE, policy, BAND, parent).df.count() == 45


def test_fail_closed_changes_nothing_and_suppresses(spark, parent):
    dirty = overlap(spark, "numeric")
    state = route_snapshot(dirty, RULE, {"duplicate_shape": "fail_closed"}, BAND, parent)
    assert state.suppressed and state.df.count() == 50
    quiet = route_snapshot(clean(spark), RULE, {"duplicate_shape": "fail_closed"}, BAND, parent)
    assert not quiet.suppressed
    with pytest.raises(ValueError, match="unknown disposition"):
        route_live(dirty, RULE, {"duplicate_shape": "fail_closed"}, BAND, parent)


def test_verdict_policy(spark):
    dirty = overlap(spark, "numeric")
    policy = {"duplicate_shape": "dedup", "numeric_shape": "quarantine", "conflict": "quarantine"}
    state, verdict = route_verdict(dirty, RULE, policy, BAND)
    assert verdict == "conflict" and state.df.count() == 30
    state, verdict = route_verdict(dirty, RULE, {"conflict": "fail_closed"}, BAND)
    assert state.suppressed and state.df.count() == 50
    state, verdict = route_verdict(clean(spark), RULE, policy, BAND)
    assert verdict == "clear" and not state.acted


@pytest.mark.parametrize("policy", [
    {"duplicate_shape": "dedup", "numeric_shape": "quarantine"},
    {"duplicate_shape": "dedup", "numeric_shape": "null_out"},
    {"duplicate_shape": "null_out", "numeric_shape": "dedup", "null_shape": "quarantine"},
    {"duplicate_shape": "quarantine", "fk_shape": "null_out"}])
def test_action_report_matches_the_action(spark, parent, policy):
    dirty = overlap(spark, "numeric").unionByName(spark.createDataFrame(
        [(60, 99, 3.0), (61, 99, None), (62, 1, None)], SCHEMA))
    got = action_report(dirty, RULE, policy, BAND, parent).collect()
    after = route_snapshot(dirty, RULE, policy, BAND, parent).df
    assert sum(r["rows_deleted"] for r in got) == dirty.count() - after.count()
    if "quarantine" not in policy.values():
        blank = after.filter("v is null").count() - 2
        assert sum(r["cells_nulled"] for r in got) >= blank


def test_key_sample_says_when_it_is_cut(spark):
    short = key_sample(keys(spark, 5), ["k"]).collect()
    assert len(short) == 5 and not short[0]["truncated"]
    long = key_sample(keys(spark, 40), ["k"]).collect()
    assert len(long) == 32 and long[0]["truncated"]
