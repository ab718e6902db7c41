import itertools
import random
from collections import Counter

import pytest

from dqspark.operators.damage import distance_damage, exact_damage, explain_rows
from dqspark.operators.dispositions import dedup, route_snapshot
from dqspark.operators.injection import Injection, inject, inject_all, injection_report
from dqspark.operators.signals import Rule

SCHEMA = "k int, v int"
RULE = Rule(("k",), "v", "v")


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def keys(spark, *ks):
    return spark.createDataFrame([(k,) for k in ks], "k int")


def damage(clean, dirty, form="keyset"):
    return exact_damage(clean, dirty, ("k",), form).first()["damage"]


def ten(spark):
    return table(spark, [(i, 10 * i) for i in range(1, 11)])


@pytest.mark.parametrize("k", [1, 3, 9])
def test_closed_forms(spark, k):
    clean, n = ten(spark), 10
    some = keys(spark, *range(1, k + 1))
    copied = inject(clean, Injection("t", "duplicate_rows", some, ("k",)))
    assert damage(clean, copied, "multiset") == pytest.approx(k / (2 * n + k), abs=1e-12)
    assert damage(clean, copied) == 0                      # identical copies change no key
    shifted = inject(clean, Injection("t", "numeric_add", some, ("k",), ("v",), 1000))
    assert damage(clean, shifted) == pytest.approx(k / n, abs=1e-12)
    withheld = route_snapshot(shifted, RULE, {"numeric_shape": "quarantine"}, (0, 200)).df
    assert damage(clean, withheld) / damage(clean, shifted) == pytest.approx(n / (2 * n - k))
    merged = route_snapshot(copied, RULE, {"duplicate_shape": "dedup"}, (0, 200)).df
    assert damage(clean, merged, "multiset") == 0
    back = inject(shifted, Injection("t", "numeric_add", some, ("k",), ("v",), -1000))
    assert damage(clean, back, "multiset") == 0
    gone = inject(clean, Injection("t", "delete_rows", some, ("k",)))
    assert damage(clean, gone) == pytest.approx(k / (2 * n - k))


def test_known_ratios_on_ten_rows(spark):
    clean, one = ten(spark), keys(spark, 1)
    copied = inject(clean, Injection("t", "duplicate_rows", one, ("k",)))
    base = damage(clean, copied, "multiset")
    quarantined = route_snapshot(copied, RULE, {"duplicate_shape": "quarantine"}, (0, 200)).df
    assert damage(clean, quarantined, "multiset") / base == pytest.approx(21 / 19)
    blanked = route_snapshot(copied, RULE, {"duplicate_shape": "null_out"}, (0, 200)).df
    assert damage(clean, blanked, "multiset") / base == pytest.approx(3.0)
    nine = inject(clean, Injection("t", "duplicate_rows", keys(spark, *range(2, 11)), ("k",)))
    assert damage(clean, nine, "multiset") / 5 == pytest.approx(0.062069, abs=1e-6)
    mix = inject(nine, Injection("t", "numeric_add", one, ("k",), ("v",), 1000))
    assert damage(clean, mix, "multiset") / 5 == pytest.approx(0.075862, abs=1e-6)


def _bag(rng, n):
    return [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 0, 1, 5, -7, 30])) for _ in range(n)]


def _brute(clean, dirty):
    ck, dk = {k for k, _ in clean}, {k for k, _ in dirty}
    added, lost = len(dk - ck), len(ck - dk)
    pairs = [(c, d) for c, d in itertools.product(clean, dirty) if c[0] is not None and c[0] == d[0]]
    changed = sum(c[1] != d[1] for c, d in pairs)
    n = len(clean)
    den = 2 * n + added - lost
    exact = (2 * changed + added + lost) / den if den else 0.0
    val = lambda r: r[1] or 0                                                # noqa: E731
    far = sum(abs(val(c) - val(d)) for c, d in pairs)
    far += sum(abs(val(c)) for c in clean if c[0] is not None and c[0] not in dk)
    far += sum(abs(val(d)) for d in dirty if d[0] is not None and d[0] not in ck)
    size = sum(abs(val(c)) for c in clean)
    rel = sum(abs(val(c) - val(d)) / abs(val(c)) for c, d in pairs if val(c))
    return exact, far / size if size else 0.0, (rel + added + lost) / n if n else 0.0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_bags_with_null_keys(spark, seed):
    rng = random.Random(seed)
    clean, dirty = _bag(rng, 12), _bag(rng, 9)
    exact, weighted, relative = _brute(clean, dirty)
    got = distance_damage(table(spark, clean), table(spark, dirty), ("k",), ("v",)).first()
    assert got["damage"] == pytest.approx(exact)
    assert got["damage_value_weighted"] == pytest.approx(weighted)
    assert got["damage_relative_error"] == pytest.approx(relative)
    multi = exact_damage(table(spark, clean), table(spark, dirty), ("k",), "multiset").first()
    c = a = l = 0
    for k in {r[0] for r in clean + dirty}:
        nc, nd = [Counter(r for r in side if r[0] == k) for side in (clean, dirty)]
        m = sum((nc & nd).values())
        ch = min(sum(nc.values()) - m, sum(nd.values()) - m)
        c, a, l = c + ch, a + sum(nd.values()) - m - ch, l + sum(nc.values()) - m - ch
    assert (multi["changed"], multi["added"], multi["lost"]) == (c, a, l)


def test_explained_rows(spark):
    clean = table(spark, [(1, 1), (2, 2), (3, 3)])
    dirty = table(spark, [(1, 1), (2, 9), (4, 4)])
    got = {r["k"]: r["change"] for r in explain_rows(clean, dirty, ("k",)).collect()}
    assert got == {2: "changed", 3: "lost", 4: "added"}


def test_empty_tables_do_no_damage(spark):
    empty = table(spark, [])
    assert damage(empty, empty) == 0
    assert distance_damage(empty, empty, ("k",), ("v",)).first()["damage_relative_error"] == 0


def test_dedup_is_deterministic_and_groups_null_keys(spark):
    df = table(spark, [(1, 5), (1, None), (1, 3), (None, 8), (None, 2), (2, 7)])
    got = sorted(map(tuple, dedup(df.repartition(4), ("k",)).collect()), key=str)
    assert got == sorted([(1, None), (None, 2), (2, 7)], key=str)


def test_copy_then_shift_is_refused(spark):
    one = keys(spark, 1)
    specs = [Injection("t", "duplicate_rows", one, ("k",)),
             Injection("t", "numeric_add", one, ("k",), ("v",), 5)]
    with pytest.raises(ValueError, match="hits 2 rows"):
        inject_all(ten(spark), specs)
    assert inject_all(ten(spark), specs[::-1]).count() == 11


def test_injection_report_counts(spark):
    spec = Injection("t", "delete_rows", keys(spark, 1, 2, 99), ("k",))
    got = injection_report(ten(spark), spec).first()
    assert (got["targets"], got["hits"], got["rows_before"], got["rows_after"]) == (3, 2, 10, 8)
    assert not got["ok"]
    with pytest.raises(ValueError, match="unknown injection mode"):
        Injection("t", "scramble", keys(spark, 1), ("k",))
