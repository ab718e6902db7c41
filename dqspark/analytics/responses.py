"""From measurements to policies, plans and comparisons.

Measurements are long tables with one row per measured branch. Columns used throughout: ``family``
(kind of error), ``k`` (rows injected), ``node``, ``shape``, ``disposition``, ``nrd`` (damage relative
to doing nothing), ``campaign``, ``method``, ``budget``, ``plan``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dqspark.functions.scalars import cumulate, medians, ranked, ratio
from dqspark.functions.skew import product

TOL = 1e-9
# Dispositions in the order in which ties are resolved.
DISPOSITION_ORDER = ("dedup", "quarantine", "null_out")


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("_one", F.lit(1))


def attach(df: DataFrame, single: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (an aggregate without grouping) to every row."""
    return _one(df).join(F.broadcast(_one(single)), "_one").drop("_one")


# --- policies over cells -----------------------------------------------------------------------

def policy_summary(m: DataFrame) -> DataFrame:
    """Per policy the mean over all cells, what fired, and its safety on clean data.

    A policy that misses a cell is ``incomplete`` and has no mean.
    """
    done = m.filter((F.col("status") == "complete") & F.col("nrd").isNotNull())
    cells = m.groupBy("cell").agg(F.lit(1).alias("x")).agg(F.count("x").alias("expected_cells"))
    per = m.select("policy").distinct().join(done.groupBy("policy").agg(
        F.count(F.lit(1)).alias("complete_cells"), F.avg("nrd").alias("macro_nrd"),
        F.count_if("fired").alias("fired_cells"),
        F.count_if(F.coalesce("clean_damage", F.lit(0.0)) > 0).alias("collateral_cells"),
        F.count_if(F.coalesce("availability_loss", F.lit(0.0)) > 0).alias("lossy_cells")),
        "policy", "left")
    out = attach(per.fillna(0, ["complete_cells"]), cells)
    whole = F.col("complete_cells") == F.col("expected_cells")
    return out.select(
        "policy", F.when(whole, "complete").otherwise("incomplete").alias("status"),
        "complete_cells", "expected_cells",
        *[F.when(whole, F.col(c)).alias(c) for c in (
            "macro_nrd", "fired_cells", "collateral_cells", "lossy_cells")],
        (whole & (F.col("collateral_cells") == 0)).alias("clean_collateral_free"),
        (whole & (F.col("lossy_cells") == 0)).alias("availability_preserved"))


def collateral_cells(m: DataFrame) -> DataFrame:
    """The cells behind the counts: where a policy damaged clean data or withheld tables."""
    bad, gone = F.col("clean_damage") > 0, F.col("availability_loss") > 0
    return m.filter((F.col("status") == "complete") & (bad | gone)).select(
        "policy", "cell", bad.alias("collateral"), gone.alias("availability_lost"))


def error_type_means(m: DataFrame) -> DataFrame:
    return m.filter(F.col("status") == "complete").groupBy("policy", "error_type").agg(
        F.avg("nrd").alias("mean_nrd"), F.count("nrd").alias("cells"))


def verdict_histogram(m: DataFrame) -> DataFrame:
    """Cells per policy, branch (dirty, clean) and verdict."""
    return m.filter(F.col("status") == "complete").select("policy", F.explode(F.array(
        F.struct(F.lit("dirty").alias("branch"), F.col("dirty_verdict").alias("verdict")),
        F.struct(F.lit("clean").alias("branch"), F.col("clean_verdict").alias("verdict")))
    ).alias("v")).filter("v.verdict is not null").groupBy("policy", "v.branch", "v.verdict").agg(
        F.count(F.lit(1)).alias("cells"))


def against_reference(summary: DataFrame, reference: str, least: float = 0.10) -> DataFrame:
    """Improvement over a reference policy, whether it is large enough, and admissible."""
    ref = summary.filter(F.col("policy") == reference).agg(F.first("macro_nrd").alias("_ref"))
    gain = F.when(F.col("_ref") == 0, F.lit(0.0)).otherwise(
        ratio(F.col("_ref") - F.col("macro_nrd"), "_ref"))
    return attach(summary.filter(F.col("status") == "complete"), ref).select(
        "policy", "macro_nrd", gain.alias("relative_improvement"),
        (gain >= least).alias("clears_least"),
        (F.col("clean_collateral_free") & F.col("availability_preserved")).alias("admissible"))


def anchor_check(means: DataFrame, policy: str, expected: DataFrame) -> DataFrame:
    """Known values (error_type, expected) against the measured means of one policy."""
    got = means.filter(F.col("policy") == policy).select("error_type", "mean_nrd")
    return expected.join(got, "error_type", "left").select(
        "error_type", "expected", F.col("mean_nrd").alias("measured"),
        F.coalesce(F.abs(F.col("mean_nrd") - F.col("expected")) < TOL, F.lit(False))
        .alias("matches"))


def placement_means(m: DataFrame) -> DataFrame:
    """Mean per (policy, placement); NULL unless every cell is measured there."""
    done = m.filter((F.col("status") == "complete") & F.col("nrd").isNotNull())
    cells = m.select("cell").distinct().agg(F.count(F.lit(1)).alias("_cells"))
    per = done.groupBy("policy", "placement").agg(F.count(F.lit(1)).alias("cells"),
                                                  F.avg("nrd").alias("macro_nrd"))
    return attach(per, cells).select("policy", "placement", "cells", F.when(
        F.col("cells") == F.col("_cells"), F.col("macro_nrd")).alias("macro_nrd"))


def placement_spread(m: DataFrame) -> DataFrame:
    """Best and worst placement per policy and whether placement matters at all."""
    per = placement_means(m).filter("macro_nrd is not null")
    return per.groupBy("policy").agg(
        F.min("macro_nrd").alias("best"), F.max("macro_nrd").alias("worst"),
        F.min(F.struct("macro_nrd", "placement"))["placement"].alias("best_placement")).select(
        "policy", "best", "worst", (F.col("worst") - F.col("best")).alias("range"),
        (F.col("worst") != F.col("best")).alias("discriminating"), "best_placement")


# --- response classes --------------------------------------------------------------------------

def cell_classes(m: DataFrame) -> DataFrame:
    """Per cell the distinct responses and the number of actions with that response."""
    return m.groupBy("cell", F.round("nrd", 9).alias("response")).agg(
        F.count_distinct("action").alias("actions"))


def equivalent_actions(m: DataFrame, costs: DataFrame) -> DataFrame:
    """Actions whose responses agree on every cell share a class; its cheapest member stands for it.

    An action's signature is an order-free digest of its (cell, response) rows, so no list of
    cells is ever built.
    """
    line = F.sha2(F.concat_ws("|", F.col("cell").cast("string"),
                              F.round("nrd", 9).cast("string")), 256)
    lanes = [F.sum(F.conv(F.substring("_h", s, 15), 16, 10).cast("decimal(38,0)")).alias(f"_s{s}")
             for s in (1, 16, 31)]
    sig = m.select("action", "cell", line.alias("_h")).distinct().groupBy("action").agg(
        F.count(F.lit(1)).alias("_n"), *lanes)
    keys = ["_n", "_s1", "_s16", "_s31"]
    known = sig.join(costs, "action")
    rep = known.groupBy(*keys).agg(
        F.min(F.struct("cost", "action"))["action"].alias("representative"),
        F.count(F.lit(1)).alias("members"))
    return known.join(rep, keys).select("action", "representative", "members")


def amplifying(m: DataFrame) -> DataFrame:
    """Branches that end with more damage than doing nothing."""
    return m.filter(F.col("nrd") > 1 + 1e-12)


def q_law(k: Column | str, n: Column | str) -> Column:
    """Response of removing k of n shifted rows: n / (2n - k)."""
    k = F.col(k) if isinstance(k, str) else k
    n = F.col(n) if isinstance(n, str) else n
    return ratio(n, 2 * n - k)


def escape(m: DataFrame) -> DataFrame:
    """Per cell the best static action, the conditional one, and the relative gap."""
    best = m.groupBy("cell").agg(
        F.min(F.when(F.col("action").startswith("static-"), F.col("nrd"))).alias("best_static"),
        F.min(F.when(F.col("action").startswith("cond"), F.col("nrd"))).alias("conditional"))
    gap = F.when(F.col("best_static") == 0, F.lit(0.0)).otherwise(
        ratio(F.col("best_static") - F.col("conditional"), "best_static"))
    return best.filter("best_static is not null and conditional is not null").withColumn(
        "escape", gap)


# --- responses, maps, plans --------------------------------------------------------------------

def response_table(m: DataFrame, key: Sequence[str], keep: str = "last") -> DataFrame:
    """One response per key; ``conflict`` marks keys measured with different values.

    keep ``last``: the value with the highest ``seq``; ``smallest``: the lowest value.
    """
    value = {"last": F.max_by("nrd", F.struct("seq", "nrd")), "smallest": F.min("nrd")}[keep]
    return m.filter("nrd is not null").groupBy(*key).agg(
        value.alias("nrd"), F.count(F.lit(1)).alias("measurements"),
        (F.max("nrd") - F.min("nrd") > TOL).alias("conflict"))


def inert(disposition: Column, shape: Column) -> Column:
    """Entries that cannot change state: no_op, or dedup where nothing is duplicated."""
    return (disposition == "no_op") | ((disposition == "dedup") & (shape != "duplicate_shape"))


def acting_signatures(plans: DataFrame, fireable: DataFrame) -> DataFrame:
    """(plan, family, signature) where a plan has an entry that can act on the family: the entries as text.

    plans: (plan, node, shape, disposition). fireable: (family, node, shape). A plan has at most
    one entry per node and shape, which bounds the list that is joined to text. Pairs on which nothing
    acts have no row: their response is 1.
    """
    acting = plans.join(fireable, ["node", "shape"]).filter(
        ~inert(F.col("disposition"), F.col("shape")))
    text = F.concat_ws("/", "node", "shape", "disposition")
    return acting.groupBy("plan", "family").agg(
        F.concat_ws(";", F.array_sort(F.collect_set(text))).alias("signature"))


def effective_signature(plans: DataFrame, fireable: DataFrame) -> DataFrame:
    """``acting_signatures`` for a report of every plan and family; '' where nothing acts."""
    every = product(plans.select("plan").distinct(), fireable.select("family").distinct())
    return every.join(acting_signatures(plans, fireable), ["plan", "family"], "left").fillna("", ["signature"])


def derive_policy(responses: DataFrame, pure: DataFrame, grid: DataFrame) -> DataFrame:
    """Per (node, shape) of ``grid`` the disposition with the smallest response over the pure
    families of the shape (family, shape); ``no_op`` unless it lowers damage at all."""
    order = F.array_position(F.array(*[F.lit(d) for d in DISPOSITION_ORDER]), F.col("disposition"))
    known = responses.filter("nrd is not null").join(pure, "family").groupBy("node", "shape").agg(
        F.min(F.struct("nrd", order.alias("o"), "disposition")).alias("_best"))
    return grid.select("node", "shape").distinct().join(known, ["node", "shape"], "left").select(
        "node", "shape",
        F.when(F.col("_best.nrd") < 1 - 1e-12, F.col("_best.disposition")).otherwise("no_op")
        .alias("disposition"),
        F.when(F.col("_best.nrd") < 1 - 1e-12, F.col("_best.nrd")).otherwise(F.lit(1.0))
        .alias("nrd"))


def predict(signatures: DataFrame, measured: DataFrame) -> DataFrame:
    """(plan, family) -> response of the plan's effective signature; 1 when inert, NULL when that
    signature was never measured. measured: (family, signature, nrd)."""
    return signatures.join(measured.select("family", "signature", "nrd"),
                           ["family", "signature"], "left").select(
        "plan", "family", "signature",
        F.when(F.col("signature") == "", F.lit(1.0)).otherwise(F.col("nrd")).alias("nrd"))


def score(predictions: DataFrame, roster: DataFrame) -> DataFrame:
    """Roster-weighted mean per plan; plans with an unpredicted family are left out."""
    met = predictions.join(roster.select("family", "weight"), "family")
    return met.groupBy("plan").agg(
        F.sum(F.col("nrd") * F.col("weight")).alias("_s"), F.sum("weight").alias("_w"),
        F.count_if(F.col("nrd").isNull()).alias("_open")).filter("_open = 0").select(
        "plan", ratio("_s", "_w").alias("score"))


def sparse_score(plans: DataFrame, fireable: DataFrame, measured: DataFrame, roster: DataFrame) -> DataFrame:
    """``score`` of every plan of (plan, node, shape, disposition) without a row for what it leaves alone.

    Inert families answer 1, so the mean is 1 + sum of w (nrd - 1) over the acting ones by all weight.
    """
    acting = predict(acting_signatures(plans, fireable), measured)
    rated = roster.select("family", "weight").join(fireable.select("family").distinct(), "family", "left_semi")
    whole = rated.agg(F.sum("weight").alias("_all")).withColumn("_one", F.lit(1))
    moved = acting.join(rated, "family").groupBy("plan").agg(
        F.sum((F.col("nrd") - 1) * F.col("weight")).alias("_s"), F.count_if(F.col("nrd").isNull()).alias("_open"))
    every = plans.select("plan").distinct().join(moved, "plan", "left").filter("coalesce(_open, 0) = 0")
    return every.withColumn("_one", F.lit(1)).join(whole, "_one").filter("_all is not null").select(
        "plan", ratio(F.col("_all") + F.coalesce("_s", F.lit(0.0)), F.col("_all")).alias("score"))


def best_per_budget(scored: DataFrame, budgets: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """The best given plan within each budget: lowest score (12 digits), cost, size, then name.

    scored: (plan, score, cost, size), and ``by`` for separate selections. The short budget list is a literal, so each plan is
    repeated only for the budgets it fits, and a budget keeps one row per task.
    """
    grid = F.array(*[F.lit(float(b)) for b in budgets])
    fits = scored.withColumn("budget", F.explode(F.filter(grid, lambda b: b >= F.col("cost"))))
    rank = F.struct(F.round("score", 12).alias("r"), F.col("cost"), F.col("size"), F.col("plan"))
    best = fits.groupBy(*by, "budget").agg(F.min(F.struct(rank.alias("rank"), "score")).alias("b"))
    return best.select(*by, "budget", F.col("b.rank.plan").alias("plan"), F.col("b.score").alias("score"),
                       F.col("b.rank.cost").alias("cost"), F.col("b.rank.size").alias("size"))


def bind(methods: DataFrame, measured: DataFrame, campaigns: DataFrame) -> DataFrame:
    """(method, budget, campaign) -> nrd through the method's plan; no plan means 1.

    methods: (method, budget, plan or NULL). Rows that stay NULL are missing measurements.
    """
    every = product(campaigns.select("campaign").distinct(), methods)
    done = measured.filter(F.col("status") == "complete").select("campaign", "plan",
                                                                 F.col("nrd").alias("_nrd"))
    return every.join(done, ["campaign", "plan"], "left").select(
        "method", "budget", "campaign", "plan",
        F.when(F.col("plan").isNull(), F.lit(1.0)).otherwise(F.col("_nrd")).alias("nrd"))


def missing(bound: DataFrame) -> DataFrame:
    return bound.filter("nrd is null").select("method", "budget", "campaign")


def aurd(bound: DataFrame, total: float, by: Sequence[str] = ("method", "campaign")) -> DataFrame:
    """Area under the residual-damage curve over budget / total (trapezoids over the budget grid).

    A curve has one point per budget, so the window holds a grid, not the data. Curves with a
    missing point are NULL.
    """
    w = Window.partitionBy(*by).orderBy("budget")
    x = F.col("budget") / F.lit(float(total))
    step = (F.col("nrd") + F.lag("nrd").over(w)) / 2 * (x - F.lag(x).over(w))
    return bound.withColumn("_a", step).groupBy(*by).agg(
        F.when(F.count_if(F.col("nrd").isNull()) == 0, F.sum("_a")).alias("aurd"))


def paired(areas: DataFrame, first: str, second: str) -> DataFrame:
    """Per campaign the two areas and their difference, from one aggregation."""
    pick = {m: F.max(F.when(F.col("method") == m, F.col("aurd"))) for m in (first, second)}
    return areas.filter(F.col("method").isin(first, second)).groupBy("campaign").agg(
        pick[first].alias("primary"), pick[second].alias("comparator")).withColumn(
        "diff", F.col("primary") - F.col("comparator"))


def paired_summary(diffs: DataFrame) -> DataFrame:
    t = diffs.agg(
        F.count("diff").alias("campaigns"), F.avg("diff").alias("mean_diff"),
        F.avg("primary").alias("mean_primary"), F.avg("comparator").alias("mean_comparator"),
        F.count_if(F.abs("diff") > 1e-12).alias("nonzero"),
        F.count_distinct(F.round("diff", 12)).alias("distinct_values"))
    return t.withColumn("relative_improvement",
                        F.coalesce(ratio(-F.col("mean_diff"), "mean_comparator"), F.lit(0.0)))


def family_means(areas: DataFrame, families: DataFrame) -> DataFrame:
    """Mean area per family and method, where every campaign of the family has one."""
    return areas.join(families.select("campaign", "family").distinct(), "campaign").groupBy(
        "family", "method").agg(F.avg("aurd").alias("mean_aurd"),
                                F.count_if(F.col("aurd").isNull()).alias("_open")).filter(
        "_open = 0").drop("_open")


def worst_case(bound: DataFrame, total: float) -> DataFrame:
    """Area under the curve of the worst campaign at each budget."""
    worst = bound.groupBy("method", "budget").agg(
        F.when(F.count_if(F.col("nrd").isNull()) == 0, F.max("nrd")).alias("nrd"))
    return aurd(worst, total, by=("method",))


def safety(placements: DataFrame) -> DataFrame:
    """Clean collateral and availability over the measured placements; all must be zero."""
    zero = [F.coalesce(c, F.lit(0.0)) for c in (
        "clean_absolute_damage", "availability_loss", "clean_availability_loss")]
    return placements.agg(
        F.count(F.lit(1)).alias("placements"), F.max(zero[0]).alias("max_clean_collateral"),
        F.bool_and(zero[0] == 0).alias("clean_collateral_zero"),
        F.bool_and((zero[1] == 0) & (zero[2] == 0)).alias("availability_full"))


def criteria(facts: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Named boolean criteria over one row of facts, and the decision: GO when all hold."""
    checked = facts.select(*[F.coalesce(F.expr(e), F.lit(False)).alias(n) for n, e in rules.items()])
    whole = F.lit(True)
    for n in rules:
        whole = whole & F.col(n)
    return checked.withColumn("decision", F.when(whole, "GO").otherwise("NO_GO"))


# --- audits ------------------------------------------------------------------------------------

def _direction(v: Column) -> Column:
    return F.when(v < 1 - TOL, "helps").when(v > 1 + TOL, "hurts").otherwise("no-op")


def extrapolate(responses: DataFrame, forks: DataFrame) -> DataFrame:
    """Leave-one-out predictions of every (family, k, node, disposition) response.

    inert: 1. location: another node of the same fork (the first by name), all else equal.
    nearest: the nearest other k at the same node (smaller k on ties). combined: location,
    else nearest, else inert. forks: (node, fork).
    Neighbours are running maxima over k from both sides; no pairs of responses are formed.
    """
    base = responses.join(forks, "node")
    place = ["family", "k", "fork", "disposition"]
    first = base.groupBy(*place).agg(F.min(F.struct("node", "nrd")).alias("_first"))
    met = base.join(first, place)
    second = met.filter(F.col("node") != F.col("_first.node")).groupBy(*place).agg(
        F.min(F.struct("node", "nrd")).alias("_second"))
    met = met.join(second, place, "left").withColumn(
        "location", F.when(F.col("node") == F.col("_first.node"), F.col("_second.nrd"))
        .otherwise(F.col("_first.nrd")))
    met = met.withColumn("_up", F.struct("k", "nrd")).withColumn("_nk", -F.col("k")).withColumn(
        "_down", F.struct("_nk", "nrd"))
    part = ["family", "node", "disposition"]
    met = cumulate(met, part, ["k"], maxima={"_below": "_up"}, inclusive=False)
    met = cumulate(met, part, ["_nk"], maxima={"_above": "_down"},
                   inclusive=False)
    below, above = F.col("k") - F.col("_below.k"), -F.col("_above._nk") - F.col("k")
    near = (F.when(below.isNull(), F.col("_above.nrd")).when(above.isNull(), F.col("_below.nrd"))
            .when(below <= above, F.col("_below.nrd")).otherwise(F.col("_above.nrd")))
    return met.withColumn("nearest", near).select(
        "family", "k", "node", "disposition", F.col("nrd").alias("measured"),
        F.lit(1.0).alias("inert"), "location", "nearest",
        F.coalesce("location", "nearest", F.lit(1.0)).alias("combined"))


def extrapolation_quality(predictions: DataFrame) -> DataFrame:
    """Coverage, absolute errors and direction accuracy per predictor."""
    names = ("inert", "location", "nearest", "combined")
    stack = ", ".join(f"'{n}', {n}" for n in names)
    long = predictions.selectExpr("measured", f"stack({len(names)}, {stack}) as (predictor, value)")
    err = F.abs(F.col("value") - F.col("measured"))
    same = _direction(F.col("value")) == _direction(F.col("measured"))
    long = long.withColumn("error", err)
    total = long.groupBy("predictor").agg(
        F.count("value").alias("covered"), F.count(F.lit(1)).alias("keys"),
        F.avg("error").alias("mae"), F.max("error").alias("max_error"),
        F.count_if(same & F.col("value").isNotNull()).alias("_right"))
    upper = ranked(long.filter("error is not null"), ["predictor"], "error").filter(
        F.col("rank") == F.floor(F.col("size") / 2) + 1).select(
        "predictor", F.col("error").alias("median_error"))
    return total.join(upper, "predictor", "left").select(
        "predictor", "covered", ratio("covered", "keys").alias("coverage"), "mae", "median_error",
        "max_error", ratio("_right", "covered").alias("direction_accuracy"))


def map_stability(m: DataFrame, pure: DataFrame, grid: DataFrame) -> DataFrame:
    """Policy entries that change when one cell is held out: (held_out, node, shape, full, reduced).

    Holding out a cell can only change an entry whose best response comes from that cell, so the
    re-derivation needs, per entry, the best response per cell and the best of all other cells:
    two running minima per entry instead of one derivation per fold.
    """
    order = F.array_position(F.array(*[F.lit(d) for d in DISPOSITION_ORDER]), F.col("disposition"))
    per_cell = m.filter("nrd is not null").join(pure, "family").groupBy("node", "shape", "cell").agg(
        F.min(F.struct("nrd", order.alias("o"), "disposition")).alias("best"))
    best = per_cell.groupBy("node", "shape").agg(F.min(F.struct("best", "cell")).alias("first"))
    rest = per_cell.join(best, ["node", "shape"]).filter(
        F.col("cell") != F.col("first.cell")).groupBy("node", "shape").agg(
        F.min("best").alias("second"))

    def entry(c: str) -> Column:
        return F.when(F.col(f"{c}.nrd") < 1 - 1e-12, F.col(f"{c}.disposition")).otherwise("no_op")

    both = best.join(rest, ["node", "shape"], "left").select(
        F.col("first.cell").alias("held_out"), "node", "shape",
        F.col("first.best").alias("a"), F.col("second").alias("b"))
    return both.join(grid.select("node", "shape").distinct(), ["node", "shape"], "left_semi").select(
        "held_out", "node", "shape", entry("a").alias("full"), entry("b").alias("reduced")).filter(
        F.col("full") != F.col("reduced"))


def selection_stability(changes: DataFrame, policy: DataFrame, candidates: DataFrame,
                        fireable: DataFrame, measured: DataFrame, roster: DataFrame,
                        costs: DataFrame, budgets: Sequence[float]) -> DataFrame:
    """Budgets whose selected candidate differs once a cell is held out of the map derivation.

    changes: output of ``map_stability``. policy: (node, shape, disposition). candidates:
    (plan, node). measured, roster and costs score every candidate from the full data, so only the
    derivation step is starved. Only held-out cells that change an entry can move a selection, and a
    fold scores only the candidates that hold such an entry; its best one is the best of these and of
    the first others in the full ranking.
    """
    base = candidates.join(policy.select("node", "shape", "disposition"), "node").select(
        "plan", "node", "shape", "disposition")
    moved = changes.select(F.col("held_out").cast("string").alias("fold"), "node", "shape", "reduced")
    touched = base.join(moved, ["node", "shape"]).select("fold", "plan").distinct()
    anew = base.join(touched, "plan").join(moved, ["fold", "node", "shape"], "left").select(
        F.concat_ws("|", "fold", "plan").alias("plan"), "node", "shape",
        F.coalesce("reduced", "disposition").alias("disposition"))

    def rated(entries: DataFrame) -> DataFrame:
        return sparse_score(entries, fireable, measured, roster)

    def fitting(scored: DataFrame) -> DataFrame:
        grid = F.array(*[F.lit(float(b)) for b in budgets])
        return scored.join(costs, "plan").withColumn("budget", F.explode(F.filter(grid, lambda b: b >= F.col("cost")))) \
            .withColumn("r", F.round("score", 12))

    # among the first n + 1 candidates one is not among the n that a fold changes
    order = ["r", "cost", "size", "plan"]
    placed = cumulate(fitting(rated(base)).withColumn("_c", F.lit(1)), ["budget"], order, sums={"place": "_c"})
    placed = placed.select("budget", *order, F.col("place").cast("long").alias("place"))
    first = touched.groupBy("fold").agg(F.count("*").alias("_n")).select(
        "fold", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n") + 1)).alias("place"))
    same = first.join(placed, "place").join(touched, ["fold", "plan"], "left_anti").select("fold", "budget", *order)
    split = rated(anew).select(F.substring_index("plan", "|", 1).alias("fold"),
                               F.substring_index("plan", "|", -1).alias("plan"), "score")
    every = same.unionByName(fitting(split).select("fold", "budget", *order))
    best = every.groupBy("fold", "budget").agg(F.min(F.struct(*order)).alias("b"))
    full = placed.filter("place = 1").select("budget", F.col("plan").alias("full"))
    rest = best.select(F.col("fold").alias("held_out"), "budget", F.col("b.plan").alias("reduced"))
    return rest.join(full, "budget", "left").filter(~F.col("full").eqNullSafe(F.col("reduced"))).select(
        "held_out", "budget", "full", "reduced")


def dose_line(parts: DataFrame, n: int, x1: float) -> DataFrame:
    """Predicted against observed differences of a mixture round.

    parts: (campaign like ``..-<k>x<k2>``, d_num, d_mixed, observed). predicted =
    (q(k) - 1) * (d_num / d_mixed) * (1 - x1 / 2), with x1 the first budget step as a share.
    """
    k = F.regexp_extract("campaign", r"-(\d+)x[^-]*$", 1).cast("int")
    out = parts.withColumn("k_num", k).withColumn("q", q_law(F.col("k_num"), F.lit(n))).withColumn(
        "share", ratio("d_num", "d_mixed"))
    out = out.withColumn("predicted", (F.col("q") - 1) * F.col("share") * F.lit(1 - x1 / 2))
    return out.select("campaign", "k_num", "q", "share", "predicted", "observed",
                      (F.col("observed") - F.col("predicted")).alias("residual"))


def trial_costs(trials: DataFrame) -> DataFrame:
    """(node, step) -> median over trials, then the largest over workloads."""
    med = medians(trials, ["node", "step", "workload"], "micros")
    return med.groupBy("node", "step").agg(F.max("median").alias("micros"))


def cost_view(costs: DataFrame) -> DataFrame:
    """Per node deploy, detect, worst disposition, their total, and total / deploy.

    costs: (node, step, micros) with steps ``deploy``, ``detect`` and disposition names.
    """
    def of(step):
        return F.max(F.when(F.col("step") == step, F.col("micros")))

    worst = F.max(F.when(~F.col("step").isin("deploy", "detect"), F.col("micros")))
    per = costs.groupBy("node").agg(of("deploy").alias("deploy"), of("detect").alias("detect"),
                                    worst.alias("worst_disposition")).filter("deploy is not null")
    total = F.col("deploy") + F.coalesce("detect", F.lit(0.0)) + F.coalesce(
        "worst_disposition", F.lit(0.0))
    return per.withColumn("total", total).withColumn("understatement", ratio("total", "deploy"))


def budget_grid(view: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Nothing, the cheapest node, the given shares of the total, and the total."""
    t = view.agg(F.sum("total").alias("all"), F.min("total").alias("least"))
    steps = [F.lit(0.0), F.col("least"), *[F.col("all") * F.lit(s) for s in shares], F.col("all")]
    return t.select(F.posexplode(F.array(*steps)).alias("step", "budget"))


def round_check(predicted: DataFrame, observed: DataFrame) -> DataFrame:
    """(round, predicted) against (round, observed): the gap in percentage points."""
    return predicted.join(observed, "round").select(
        "round", "predicted", "observed",
        ((F.col("observed") - F.col("predicted")) * 100).alias("gap_points"))
