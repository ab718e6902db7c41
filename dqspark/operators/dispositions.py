"""What is done with flagged rows, and how a policy routes each shape to a disposition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from dqspark.functions.skew import any_null, lookup_join, mark
from dqspark.operators.signals import (
    SHAPES, Rule, duplicate_keys, flag_shape, key_profile, orphan_values, row_flags, signal_report,
    two_signal_verdict)

# The dispositions a policy may name.
DISPOSITIONS = ("no_op", "quarantine", "dedup", "null_out", "fail_closed")


@dataclass
class Acted:
    """State after a policy; ``quarantined`` is what was removed, where it was asked for."""

    df: DataFrame
    fired: dict[str, int] = field(default_factory=dict)
    acted: dict[str, str] = field(default_factory=dict)
    suppressed: bool = False


def quarantine(flagged: DataFrame, shape: str) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined) rows of a flagged relation."""
    return flagged.filter(~F.col(shape)), flagged.filter(F.col(shape))


def dedup(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key over the whole table: the smallest row in column order (NULL first).

    A minimum over the remaining columns combines on the map side, so a key held by a third of
    the rows never meets in one task. NULL keys form one group.
    """
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    best = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row"))
    return best.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def dedup_flagged(flagged: DataFrame, key: Sequence[str], shape: str) -> DataFrame:
    """One row per key among the flagged rows; all other rows stay as they are."""
    kept, hit = quarantine(flagged, shape)
    return kept.unionByName(dedup(hit, key))


def null_out(df: DataFrame, col: str, when: Column) -> DataFrame:
    """Blank one column on the rows where ``when`` holds, keep the rows."""
    kind = dict(df.dtypes)[col]
    return df.withColumn(col, F.when(when, F.lit(None).cast(kind)).otherwise(F.col(col)))


def _blank_column(rule: Rule, numeric_only: bool = False) -> str:
    col = rule.numeric or (None if numeric_only else rule.null)
    if col is None:
        raise ValueError("null_out needs a numeric or nullable column in the rule")
    return col


def _has_signal(rule: Rule, shape: str, band) -> bool:
    return {"duplicate_shape": True, "numeric_shape": bool(rule.numeric and band is not None),
            "null_shape": bool(rule.null),
            "fk_shape": rule.fk is not None or rule.fk_payload is not None}[shape]


def _fires(df: DataFrame, rule: Rule, shape: str, band, parent) -> int:
    """Rows a shape fires on now; duplicates and orphans are counted without joining rows."""
    if shape == "duplicate_shape":
        got = duplicate_keys(df, rule.key).agg(F.sum("_n").alias("n"))
    elif shape == "fk_shape" and rule.fk is not None:
        col, _, parent_col = rule.fk
        got = orphan_values(df, col, parent, parent_col, rule.parent_null_guard).agg(
            F.sum("_n").alias("n"))
    else:
        got = df.agg(F.count_if(row_flags(rule, band)[shape]).alias("n"))
    return got.first()["n"] or 0


def route_live(df: DataFrame, rule: Rule, policy: Mapping[str, str], band: Sequence | None = None,
               parent: DataFrame | None = None, targets: DataFrame | None = None,
               count: bool = False) -> Acted:
    """Route each shape in the fixed order; every rule looks at the state its predecessor left.

    ``dedup`` keeps one row per key of the whole table, once its shape fires anywhere. With
    ``targets`` the predicate of every mapped shape is the given key set. Counting (``count``, and
    always before a dedup, which depends on it) runs one small aggregation per mapped shape.
    """
    state = Acted(df)
    for shape in SHAPES:
        action = policy.get(shape, "no_op")
        if action == "no_op":
            continue
        if action not in ("quarantine", "dedup", "null_out"):
            raise ValueError(f"unknown disposition {action}")
        if targets is None and not _has_signal(rule, shape, band):
            continue
        if targets is not None:
            wanted = targets.select(*rule.key).distinct().withColumn(shape, F.lit(True))
            flagged = lookup_join(state.df, wanted, rule.key).withColumn(
                shape, F.coalesce(shape, F.lit(False)))
        else:
            flagged = flag_shape(state.df, rule, shape, band, parent)
        if count or action == "dedup":
            n = (flagged.filter(F.col(shape)).count() if targets is not None
                 else _fires(state.df, rule, shape, band, parent))
            state.fired[shape] = n
            if n == 0:
                continue
        if action == "quarantine":
            state.df = quarantine(flagged, shape)[0].drop(shape)
        elif action == "dedup":
            state.df = dedup(state.df, rule.key)
        else:
            state.df = null_out(flagged, _blank_column(rule), F.col(shape)).drop(shape)
        state.acted[shape] = action
    return state


def route_snapshot(df: DataFrame, rule: Rule, policy: Mapping[str, str],
                   band: Sequence | None = None, parent: DataFrame | None = None,
                   count: bool = False) -> Acted:
    """Detect all shapes on the arriving state, then treat the detected keys in the fixed order.

    One key profile feeds every shape. ``fail_closed`` changes nothing and suppresses what lies
    downstream when its shape fires; only that decision (or ``count``) needs a count.
    """
    used = {s: policy.get(s, "no_op") for s in SHAPES}
    bad = set(used.values()) - set(DISPOSITIONS)
    if bad:
        raise ValueError(f"unknown disposition {sorted(bad)}")
    state = Acted(df)
    if count or "fail_closed" in used.values():
        row = signal_report(df, rule, band, parent, unit="keys").first()
        state.fired = {s: row[s] for s in SHAPES}
        state.suppressed = any(a == "fail_closed" and row[s] > 0 for s, a in used.items())
    moves = {s: a for s, a in used.items() if a not in ("no_op", "fail_closed")
             and state.fired.get(s, 1) > 0}
    if not moves:
        return state
    wanted = F.lit(False)
    for s in moves:
        wanted = wanted | (F.col(s) > 0)
    keys = key_profile(df, rule, band, parent).filter(wanted).select(
        *rule.key, "_n", *[(F.col(s) > 0).alias(s) for s in moves])
    out = mark(df, keys, rule.key, list(moves))
    for shape, action in moves.items():
        if action == "quarantine":
            out = out.filter(~F.col(shape))
        elif action == "dedup":
            out = dedup_flagged(out, rule.key, shape)
        else:
            out = null_out(out, _blank_column(rule, numeric_only=True), F.col(shape))
        state.acted[shape] = action
    state.df = out.select(*df.columns)
    return state


def route_verdict(df: DataFrame, rule: Rule, policy: Mapping[str, str],
                  band: Sequence | None = None) -> tuple[Acted, str]:
    """One disposition for the table's verdict, applied to the union of both key sets."""
    shapes = ("duplicate_shape", "numeric_shape")
    two = Rule(rule.key, rule.numeric)
    verdict = two_signal_verdict(signal_report(df, two, band, unit="keys")).first()["verdict"]
    action = policy.get(verdict, "no_op")
    state = Acted(df)
    if action == "fail_closed":
        state.suppressed = verdict != "clear"
    elif action != "no_op" and verdict != "clear":
        hit = (F.col(shapes[0]) > 0) | (F.col(shapes[1]) > 0)
        keys = key_profile(df, two, band).filter(hit).select(
            *rule.key, "_n", F.lit(True).alias("_hit"))
        marked = mark(df, keys, rule.key, ["_hit"])
        if action == "quarantine":
            out = marked.filter(~F.col("_hit"))
        elif action == "dedup":
            out = dedup_flagged(marked, rule.key, "_hit")
        elif action == "null_out":
            out = null_out(marked, _blank_column(rule, numeric_only=True), F.col("_hit"))
        else:
            raise ValueError(f"unknown disposition {action}")
        state.df = out.select(*df.columns)
        state.acted[verdict] = action
    return state, verdict


def action_report(df: DataFrame, rule: Rule, policy: Mapping[str, str],
                  band: Sequence | None = None, parent: DataFrame | None = None) -> DataFrame:
    """Per mapped and fired shape: keys affected, rows deleted, cells nulled (snapshot routing).

    Computed from one aggregation per key: the effect of a sequence of dispositions on a key
    depends only on its row count and on how many of its numeric cells are filled.
    """
    profile = key_profile(df, rule, band, parent)
    if rule.numeric:
        rest = [c for c in df.columns if c not in rule.key]
        survivor = F.min(F.struct(*rest))[rule.numeric].isNotNull().cast("long")
        filled = df.groupBy(*rule.key).agg(F.count(rule.numeric).alias("_filled"),
                                           survivor.alias("_survivor_filled"))
    else:
        filled = df.groupBy(*rule.key).agg(F.lit(0).alias("_filled"),
                                           F.lit(0).alias("_survivor_filled"))
    on = [profile[k].eqNullSafe(filled[k]) for k in rule.key]
    state = profile.join(filled, on).drop(*[filled[k] for k in rule.key])
    state = state.withColumn("_acts", ~any_null(rule.key)).withColumn("_alive", F.col("_n"))
    out = []
    for shape in SHAPES:
        action = policy.get(shape, "no_op")
        if action == "no_op":
            continue
        hit = F.col("_acts") & (F.col(shape) > 0)
        gone = {"quarantine": F.col("_alive"),
                "dedup": F.greatest(F.col("_alive") - 1, F.lit(0))}.get(action, F.lit(0))
        nulled = F.col("_filled") if action == "null_out" else F.lit(0)
        state = state.withColumn(f"_d_{shape}", F.when(hit, gone).otherwise(0)) \
            .withColumn(f"_z_{shape}", F.when(hit, nulled).otherwise(0))
        left = F.col("_alive") - F.col(f"_d_{shape}")
        if action == "quarantine":
            now = F.when(hit, F.lit(0)).otherwise(F.col("_filled"))
        elif action == "dedup":
            now = F.when(hit & (F.col("_alive") > 1), F.col("_survivor_filled")) \
                .otherwise(F.col("_filled"))
        elif action == "null_out":
            now = F.when(hit, F.lit(0)).otherwise(F.col("_filled"))
            state = state.withColumn("_survivor_filled",
                                     F.when(hit, F.lit(0)).otherwise(F.col("_survivor_filled")))
        else:
            now = F.col("_filled")
        state = state.withColumn("_filled", now).withColumn("_alive", left)
        out.append((shape, action))
    if not out:
        raise ValueError("the policy maps no shape")
    sums = state.agg(*[F.coalesce(f, F.lit(0)).cast("long").alias(a) for s, _ in out for f, a in (
        (F.count_if(F.col(s) > 0), f"k_{s}"), (F.sum(f"_d_{s}"), f"d_{s}"),
        (F.sum(f"_z_{s}"), f"z_{s}"))])
    stack = ", ".join(f"'{s}', '{a}', k_{s}, d_{s}, z_{s}" for s, a in out)
    return sums.selectExpr(
        f"stack({len(out)}, {stack}) as (shape, disposition, keys_affected, rows_deleted, "
        "cells_nulled)").filter("keys_affected > 0")
