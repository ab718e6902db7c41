import math

import pytest
from plain_rows import rows

from dqspark.analytics import responses as ra
from dqspark.analytics import stats
from dqspark.operators import snapshots as sn
from dqspark.operators import suite as st

DIFFS = "comparison string, campaign string, diff double"


def diffs(spark, **groups):
    return spark.createDataFrame([(c, f"{i:03}", float(d)) for c, ds in groups.items()
                                  for i, d in enumerate(ds)], DIFFS)


def test_sign_flip_closed_form(spark):
    # m equal-signed non-zero differences (zeros do not matter): p = 2^-m
    df = diffs(spark, a=[-1] * 12 + [0] * 6, b=[-0.5] * 5, c=[0.0] * 4, d=[1.0, 1.0])
    got = {r["comparison"]: r["p"] for r in stats.sign_flip(df).collect()}
    assert got == {"a": 2 ** -12, "b": 2 ** -5, "c": 1.0, "d": 1.0}
    assert got["a"] == 0.000244140625


def test_sign_flip_beyond_listing(spark):
    # 40 equal differences: the number of positive signs is binomial
    import math
    ones = [1] * 25 + [-1] * 15
    hits = sum(math.comb(40, k) for k in range(26))
    got = {r["comparison"]: (r["n"], r["p"], r["status"]) for r in stats.sign_flip(
        diffs(spark, a=[-1] * 40, b=ones, c=[-1] * 51, d=[-1] * 3)).collect()}
    assert got == {"a": (40, 2 ** -40, "exact"), "b": (40, hits / 2 ** 40, "exact"),
                   "c": (51, None, "refused"), "d": (3, 0.125, "exact")}


def test_sign_flip_against_listing(spark):
    import itertools
    import random
    rng = random.Random(5)
    groups = {f"g{n}": [rng.choice((-3, -1, 0, 1, 2)) / 10 for _ in range(n)] for n in (1, 2, 5, 9, 13)}
    got = {r["comparison"]: r["p"] for r in stats.sign_flip(diffs(spark, **groups)).collect()}
    for name, ds in groups.items():
        tens = [round(10 * d) for d in ds]
        hits = sum(sum(s * d for s, d in zip(signs, tens)) <= sum(tens)
                   for signs in itertools.product((1, -1), repeat=len(ds)))
        assert got[name] == hits / 2 ** len(ds)


def test_sign_flip_leaves_null_differences_out(spark):
    df = diffs(spark, a=[-1, -1]).unionByName(spark.createDataFrame([("a", "z", None), ("b", "z", None)], DIFFS))
    assert {r["comparison"]: (r["n"], r["p"]) for r in stats.sign_flip(df).collect()} == {"a": (2, 0.25), "b": (0, None)}


def test_bootstrap(spark):
    df = diffs(spark, same=[-0.25] * 8, mixed=[-1, 1, 0, 2])
    got = {r["comparison"]: r for r in stats.bootstrap_ci(df, resamples=400, seed="s").collect()}
    same, mixed = got["same"], got["mixed"]
    assert (same["mean"], same["lower"], same["upper"], same["below_zero"]) == (-0.25, -0.25, -0.25, 1.0)
    means = sorted(r["mean"] for r in stats.bootstrap_means(df, 400, "s").collect()
                   if r["comparison"] == "mixed")
    assert len(means) == 400
    assert mixed["lower"] == means[int(0.025 * 400)] and mixed["upper"] == means[int(0.975 * 400) - 1]
    assert abs(mixed["mean"] - 0.5) < 0.2


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("g", "a", 0.6)],
                               "family string, name string, p double")
    got = {(r["family"], r["name"]): r["adjusted"] for r in stats.holm(df).collect()}
    assert got[("f", "a")] == pytest.approx(0.03) and got[("f", "c")] == pytest.approx(0.06)
    assert got[("f", "b")] == pytest.approx(0.06) and got[("g", "a")] == 0.6


def test_holm_leaves_refused_out(spark):
    df = spark.createDataFrame([("f", "a", 0.02), ("f", "b", None), ("f", "c", 0.5), ("g", "a", None)],
                               "family string, name string, p double")
    got = {(r["family"], r["name"]): (r["rank"], r["adjusted"]) for r in stats.holm(df).collect()}
    assert got == {("f", "a"): (1, 0.04), ("f", "c"): (2, 0.5), ("f", "b"): (None, None), ("g", "a"): (None, None)}


def test_area_under_curve(spark):
    bound = spark.createDataFrame([("m", 0.0, "c", 1.0), ("m", 2.0, "c", 0.5), ("m", 4.0, "c", 0.25),
                                   ("n", 0.0, "c", None), ("n", 4.0, "c", 1.0)],
                                  "method string, budget double, campaign string, nrd double")
    assert rows(ra.aurd(bound, 4), "method", "aurd") == [("m", 0.5625), ("n", None)]


def test_derived_map_needs_a_real_gain(spark):
    resp = spark.createDataFrame([("num", "a", "dedup", 1.0), ("num", "a", "quarantine", 0.5),
                                  ("num", "b", "quarantine", 1.2), ("num", "c", "null_out", 0.5),
                                  ("num", "c", "dedup", 0.5)],
                                 "family string, node string, disposition string, nrd double")
    pure = spark.createDataFrame([("num", "numeric_shape")], "family string, shape string")
    grid = spark.createDataFrame([(n, "numeric_shape") for n in "abcd"], "node string, shape string")
    assert rows(ra.derive_policy(resp, pure, grid), "node", "disposition") == [
        ("a", "quarantine"), ("b", "no_op"), ("c", "dedup"), ("d", "no_op")]


def test_inert_entries_leave_the_signature(spark):
    plans = spark.createDataFrame([("p", "a", "numeric_shape", "dedup"), ("p", "b", "numeric_shape",
                                   "quarantine"), ("q", "a", "numeric_shape", "dedup")],
                                  "plan string, node string, shape string, disposition string")
    fire = spark.createDataFrame([("f", "a", "numeric_shape"), ("f", "b", "numeric_shape"),
                                  ("g", "z", "fk_shape")], "family string, node string, shape string")
    sig = ra.effective_signature(plans, fire)
    assert rows(sig, "plan", "family", "signature") == [
        ("p", "f", "b/numeric_shape/quarantine"), ("p", "g", ""), ("q", "f", ""), ("q", "g", "")]
    measured = spark.createDataFrame([("f", "other", 0.5)], "family string, signature string, nrd double")
    pred = ra.predict(sig, measured)
    roster = spark.createDataFrame([("f", 3), ("g", 1)], "family string, weight int")
    assert rows(ra.score(pred, roster)) == [("q", 1.0)]          # p has an unseen composition


def test_conflicts_and_choice(spark):
    m = spark.createDataFrame([("f", 1, 0.5), ("f", 2, 0.75), ("g", 1, 0.1), ("g", 2, 0.1)],
                              "family string, seq int, nrd double")
    assert rows(ra.response_table(m, ["family"]), "family", "nrd", "conflict") == [
        ("f", 0.75, True), ("g", 0.1, False)]
    assert rows(ra.response_table(m, ["family"], "smallest"), "family", "nrd")[0] == ("f", 0.5)


def test_dose_line_is_exact_for_a_pure_numeric_round(spark):
    n, k, x1 = 10, 4, 0.25
    observed = (n / (2 * n - k) - 1) * 0.5 * (1 - x1 / 2)
    parts = spark.createDataFrame([(f"mix-{k}x3", 0.2, 0.4, observed)],
                                  "campaign string, d_num double, d_mixed double, observed double")
    assert abs(ra.dose_line(parts, n, x1).first()["residual"]) < 1e-15


def test_extrapolation_brute_force(spark):
    data = [("f", k, n, "dedup", (k * 7 + len(n) * 3 + ord(n[-1])) % 11 / 8)
            for k in (1, 4, 10, 100) for n in ("a1", "a2", "a3", "b1")]
    resp = spark.createDataFrame(data, "family string, k int, node string, disposition string, nrd double")
    forks = spark.createDataFrame([(n, n[0]) for n in ("a1", "a2", "a3", "b1")], "node string, fork string")
    got = {(r["k"], r["node"]): r for r in ra.extrapolate(resp, forks).collect()}
    for _, k, n, _, _ in data:
        near = min((d for d in data if d[2] == n and d[1] != k), key=lambda d: (abs(d[1] - k), d[1]))
        same = sorted(d for d in data if d[1] == k and d[2] != n and d[2][0] == n[0])
        assert got[(k, n)]["nearest"] == near[4]
        assert got[(k, n)]["location"] == (same[0][4] if same else None)
    q = {r["predictor"]: r for r in ra.extrapolation_quality(ra.extrapolate(resp, forks)).collect()}
    errors = sorted(abs(1 - d[4]) for d in data)
    assert q["inert"]["median_error"] == errors[len(errors) // 2]
    assert q["location"]["covered"] == 12 and math.isclose(q["inert"]["mae"], sum(errors) / 16)


@pytest.mark.parametrize("few, accuracy", [(100_000, 10_000), (5, 10), (1, 100)])
def test_cut_point_against_sorting(spark, monkeypatch, few, accuracy):
    import datetime
    import random
    monkeypatch.setattr(sn, "FEW_ROWS", few)
    monkeypatch.setattr(sn, "ACCURACY", accuracy)
    rng, day = random.Random(few), datetime.datetime(2020, 1, 1)
    lists = [[rng.randrange(300) for _ in range(200)], [5] * 60 + [7] * 3 + [9], [None] * 30 + list(range(20)), [None, None], []]
    for times in lists:
        df = spark.createDataFrame([(None if x is None else day + datetime.timedelta(hours=x, microseconds=x),) for x in times],
                                   "d timestamp")
        for q in (0.01, 0.4, 0.8, 1.0):
            known = sorted(x for x in times if x is not None)
            cuts = [x for x in known if sum(y <= x for y in known) <= q * len(times)] or known[:1]
            got = sn.cut_point(df, "d", q).first()
            if not known:
                assert (got["cut"], got["train_rows"]) == (None, None)
                continue
            n = sum(y <= cuts[-1] for y in known)
            assert got["cut"] == day + datetime.timedelta(hours=cuts[-1], microseconds=cuts[-1])
            assert (got["train_rows"], got["total_rows"], got["validation_rows"]) == (n, len(times), len(times) - n)


def test_cut_point_rules(spark):
    df = spark.sql("select date_add(date'2020-01-25', t) as d from values (0), (0), (1), (9), (40), "
                   "(null), (null) as v(t)")
    got = sn.cut_point(df, "d", 0.5).first()
    assert str(got["cut"]) == "2020-01-26" and (got["train_rows"], got["total_rows"]) == (3, 7)
    first = sn.cut_point(df, "d", 0.01).first()         # at least the first time value
    assert str(first["cut"]) == "2020-01-25" and first["train_rows"] == 2
    train, later = sn.temporal_split(df, "d", got["cut"])
    assert (train.count(), later.count()) == (5, 4)     # rows without a time stay on both sides


def test_digest_ignores_order_and_sees_every_change(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1.5), (2, "y", 1.5)], "k int, s string, v double")
    base = sn.digest(a).first()
    assert sn.digest(a.repartition(3)).first() == base
    for other in (a.filter("k = 1"), a.distinct(), a.replace("x", "z"), a.fillna(0.0),
                  a.withColumnRenamed("s", "t")):
        assert sn.digest(other).first() != base
    shifted = spark.createDataFrame([("a|", "b")], "p string, q string")
    glued = spark.createDataFrame([("a", "|b")], "p string, q string")
    assert sn.digest(shifted).first() != sn.digest(glued).first()
    with pytest.raises(TypeError):
        sn.digest(spark.sql("select array(1) as a"))
    with pytest.raises(Exception, match="non-finite"):
        sn.digest(spark.sql("select double('NaN') as a")).collect()


def test_suite_null_semantics(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, None, 3), (None, "z", None), (None, "b", 1)],
                               "k int, s string, v int")
    assert rows(st.unique(df, "k")) == [(1, 2)]
    assert st.accepted_values(df, "s", ["a", "b"]).count() == 1
    assert st.expression_is_true(df, "v < 3").count() == 1
    assert st.relationships(df, "k", df.filter("k = 7"), "k").count() == 2


def test_same_plan_everywhere_is_one_class(spark):
    m = spark.createDataFrame([(a, c, c / 4 if a != "odd" else 0.3) for a in ("x", "y", "odd")
                               for c in (1, 2, 3)], "action string, cell int, nrd double")
    cost = spark.createDataFrame([("x", 5), ("y", 2), ("odd", 1)], "action string, cost int")
    assert rows(ra.equivalent_actions(m, cost)) == [("odd", "odd", 1), ("x", "y", 2), ("y", "y", 2)]


def test_resampling_by_arrays_and_by_joins_draws_the_same(spark, monkeypatch):
    data = [(c, f"k{i}", None if i == 3 else (i * 7 % 11) / 8.0) for c, n in (("a", 9), ("b", 4), ("c", 1))
            for i in range(n)] + [("b", None, 100.0)]
    df = spark.createDataFrame(data, "comparison string, campaign string, diff double")
    monkeypatch.setattr(stats, "DRAW_BLOCK", 7)

    def means():
        return {(r["comparison"], r["resample"]): round(r["mean"], 12) if r["mean"] is not None else None
                for r in stats.bootstrap_means(df, 60, "z").collect()}
    arrays = means()
    monkeypatch.setattr(stats, "DRAW_ARRAY", 0)
    assert len(arrays) == 180 and means() == arrays
    monkeypatch.setattr(stats, "DRAW_ARRAY", 4)              # one comparison by joins, two by arrays
    assert means() == arrays
