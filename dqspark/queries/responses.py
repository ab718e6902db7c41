"""Analytics over measurement tables derived from the order lines.

Every measurement table is an aggregation of all lines. Its SQL is shared by both engines; responses
are multiples of 1/1024, so sums and means are exact in any order.
"""

from __future__ import annotations

from dqspark.analytics import responses as ra
from dqspark.analytics import stats
from dqspark.queries.common import read
from pyspark.sql import functions as F

QUERIES = {}
ORACLES = {}

_COLUMNS = """l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag rf, l_linestatus ls,
    cast(cast(l_extendedprice as decimal(18,2)) * 100 as bigint) cents,
    cast(l_quantity as bigint) qty"""
LINES = f"select {_COLUMNS} from lineitem"
#: For the tables that use the part's columns; lines without a part have kind and brand 'none'.
PART_LINES = f"""select {_COLUMNS}, coalesce(p_type, 'none') kind, coalesce(p_brand, 'none') brand,
    coalesce(p_size, 0) size from lineitem left join part on p_partkey = l_partkey"""
#: Mean price of a unit in 1,024ths.
NRD = "cast(sum(cents) div (sum(qty) * 100) as double) / 1024"

BASE = {
    # one row per policy and cell
    "cells": f"""select rf policy, l_partkey cell, case when l_partkey % 2 = 0 then 'numeric'
        else 'duplicate' end error_type, {NRD} nrd,
        case when sum(qty) % 2 = 0 then 'numeric_shape' else 'clear' end dirty_verdict,
        case when sum(qty) % 50 = 0 and rf = 'A' then 'numeric_shape' else 'clear' end clean_verdict,
        sum(qty) % 2 = 0 fired,
        case when sum(qty) % 50 = 0 and rf = 'A' then 0.5e0 else 0.0e0 end clean_damage,
        case when sum(qty) % 70 = 0 and rf = 'N' then 1.0e0 else 0.0e0 end availability_loss,
        case when count(*) > 0 then 'complete' else 'technical_failure' end status
        from lines group by 1, 2, 3""",
    "spread": f"""select rf policy, concat('node', l_linenumber) placement, l_suppkey cell, {NRD} nrd,
        'complete' status from lines group by 1, 2, 3""",
    # several measurements per key: l_suppkey is the order in which they were taken
    "tries": f"""select kind family, size k, concat('node', l_linenumber) node,
        case rf when 'A' then 'dedup' when 'N' then 'quarantine' else 'null_out' end disposition,
        l_suppkey seq, brand cell, {NRD} nrd from lines group by 1, 2, 3, 4, 5, 6""",
    "actions": f"""select l_suppkey cell, case when l_linenumber <= 3 then concat('static-', rf)
        when l_linenumber <= 5 then concat('cond-', rf) else concat('other-', rf) end action,
        {NRD} nrd from lines group by 1, 2""",
    # three actions that always answer alike, two of them under another name
    "twins": f"""select a.action || s.suffix action, cell, nrd from (select l_suppkey cell, rf action,
        {NRD} nrd from lines group by 1, 2) a, (select '-x' suffix union all select '-y') s""",
    "costs": """select rf || s.suffix action, sum(qty) + s.extra cost from lines,
        (select '-x' suffix, 5 extra union all select '-y', 0) s group by rf, s.suffix, s.extra""",
    "pure": """select kind family, case when min(length(kind)) % 2 = 0 then 'numeric_shape' else
        'duplicate_shape' end shape from lines group by 1""",
    "fireable": """select kind family, concat('node', least(l_linenumber, 4)) node,
        case when min(length(kind)) % 2 = 0 then 'numeric_shape' else 'duplicate_shape' end shape
        from lines group by 1, 2""",
    # one candidate plan per brand, at most one entry per node and shape
    "plans": """select brand as "plan", case when l_linenumber <= 3 then 'node1' else 'node6' end node,
        case when ls = 'F' then 'numeric_shape' else 'duplicate_shape' end shape,
        case max(cents) % 4 when 0 then 'dedup' when 1 then 'quarantine' when 2 then 'null_out'
        else 'no_op' end disposition from lines group by 1, 2, 3""",
    "plan_costs": """select brand as "plan", cast(count(distinct l_partkey) as double) cost,
        count(distinct l_linenumber) size from lines group by 1""",
    "plan_runs": f"""select brand as "plan", kind family, max(l_orderkey) seq, {NRD} nrd,
        case when sum(qty) % 2 = 0 then 'complete' else 'technical_failure' end status
        from lines group by 1, 2""",
    "roster": "select kind family, count(*) weight from lines group by 1",
    # budgets 0..4 of 4, campaigns are suppliers, methods are return flags
    "methods": """select rf method, least(l_linenumber, 5) - 1 budget, case when l_linenumber = 1 then
        null else concat('plan', least(l_linenumber, 5) % 3) end as "plan" from lines
        group by 1, 2, 3""",
    "runs": f"""select l_suppkey campaign, concat('plan', l_linenumber % 3) as "plan",
        case when l_suppkey % 2 = 0 then 'even' else 'odd' end family, {NRD} nrd,
        case when l_suppkey % 10 = 7 and l_linenumber % 3 = 2 then 'technical_failure' else 'complete'
        end status, 0.0e0 clean_absolute_damage, 0.0e0 availability_loss,
        0.0e0 clean_availability_loss from lines group by 1, 2, 3, 5""",
    # one comparison per brand, twelve campaigns each
    "diffs": f"""select brand comparison, concat(rf, ls, case when qty > 25 then 'h' else 'l' end) campaign,
        {NRD} - 1.25e0 diff from lines
        group by 1, 2""",
    # three comparisons of up to 28 campaigns
    "long_diffs": f"""select rf comparison, concat(ls, l_linenumber, case when qty > 25 then 'h' else 'l' end) campaign,
        {NRD} - 1.25e0 diff from lines group by 1, 2""",
    "pvals": """select kind family, cast(l_partkey as varchar(20)) as "name",
        cast((sum(qty) * 65536) div (50 * count(*) + 1) as double) / 65536 p from lines group by 1, 2""",
    "trials": """select concat('node', l_linenumber) node, case rf when 'A' then 'deploy' when 'N' then
        'detect' else concat('act', ls) end step, l_suppkey workload, cast(cents as double) micros
        from lines""",
    "parts": f"""select concat('camp-', l_linenumber, 'x', 8 - l_linenumber) campaign,
        cast(sum(case when rf = 'A' then cents end) div (sum(case when rf = 'A' then qty end) * 100) as double)
        / 1024 d_num, {NRD} + 1 d_mixed, {NRD} - 1 observed
        from lines group by l_linenumber""",
}


def _parts(name: str) -> bool:
    return any(w in BASE[name] for w in ("kind", "brand", "size k"))


def _frame(spark, sf_dir, name: str):
    args = {"lineitem": read(spark, sf_dir, "lineitem")}
    if _parts(name):
        args["part"] = read(spark, sf_dir, "part")
    text = (PART_LINES if _parts(name) else LINES).replace("from lineitem", "from {lineitem}")
    lines = spark.sql(text.replace("join part", "join {part}"), **args)
    sql = BASE[name].replace('"plan"', "`plan`").replace('"name"', "`name`").replace(
        "from lines", "from {lines}")
    return spark.sql(sql, lines=lines)


def frames(spark, sf_dir, *names):
    return [_frame(spark, sf_dir, n) for n in names]


def query(names: str, sql: str):
    ctes = [f"lines as materialized ({PART_LINES})"] + [
        f"{n} as materialized ({BASE[n].replace(' div ', ' // ')})" for n in names.split()]

    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = "with " + ",\n".join(ctes) + "\n" + sql
        return fn
    return add


_SUMMARY = """s as (select policy, count(*) complete_cells, avg(nrd) macro_nrd,
    count(*) filter (fired) fired_cells, count(*) filter (clean_damage > 0) collateral_cells,
    count(*) filter (availability_loss > 0) lossy_cells from cells group by 1),
    e as (select count(distinct cell) expected_cells from cells)"""


@query("cells", f"""select * from (with {_SUMMARY} select policy, case when w then 'complete' else
    'incomplete' end status, complete_cells, expected_cells, case when w then macro_nrd end macro_nrd,
    case when w then fired_cells end fired_cells, case when w then collateral_cells end collateral_cells,
    case when w then lossy_cells end lossy_cells, w and collateral_cells = 0 clean_collateral_free,
    w and lossy_cells = 0 availability_preserved
    from (select *, complete_cells = expected_cells w from s, e))""")
def policy_summary(spark, sf_dir):
    return ra.policy_summary(_frame(spark, sf_dir, "cells"))


@query("cells", "select policy, cell, clean_damage > 0 collateral, availability_loss > 0 "
                "availability_lost from cells where clean_damage > 0 or availability_loss > 0")
def policy_collateral_cells(spark, sf_dir):
    return ra.collateral_cells(_frame(spark, sf_dir, "cells"))


@query("cells", "select policy, error_type, avg(nrd) mean_nrd, count(nrd) cells from cells group by 1, 2")
def policy_error_types(spark, sf_dir):
    return ra.error_type_means(_frame(spark, sf_dir, "cells"))


@query("cells", "select policy, 'dirty' branch, dirty_verdict verdict, count(*) cells from cells "
                "group by 1, 3 union all select policy, 'clean', clean_verdict, count(*) from cells "
                "group by 1, 3")
def policy_verdicts(spark, sf_dir):
    return ra.verdict_histogram(_frame(spark, sf_dir, "cells"))


@query("cells", f"""select * from (with {_SUMMARY}, r as (select macro_nrd ref from s where policy = 'A')
    select policy, macro_nrd, (ref - macro_nrd) / ref relative_improvement,
    (ref - macro_nrd) / ref >= 0.1 clears_least, collateral_cells = 0 and lossy_cells = 0 admissible
    from s, e, r where complete_cells = expected_cells)""")
def policy_vs_reference(spark, sf_dir):
    return ra.against_reference(ra.policy_summary(_frame(spark, sf_dir, "cells")), "A")


@query("cells", """select error_type, expected, measured, coalesce(abs(measured - expected) < 1e-9, false) matches from
    (select error_type, floor(avg(nrd) * 64) / 64 expected from cells where policy = 'N' group by 1
    union all select 'null', 1.0e0) left join (select error_type, avg(nrd) measured from cells where policy = 'A' group by 1)
    using (error_type) union all select error_type, avg(nrd), sum(nrd) / count(*), true from cells where policy = 'A' and
    error_type = 'numeric' group by 1""")
def anchor_check(spark, sf_dir):
    """Policy A against the rounded means of another policy, a type without cells, and its own numeric mean
    by another sum."""
    cells = _frame(spark, sf_dir, "cells")
    means = ra.error_type_means(cells)
    known = cells.filter("policy = 'N'").groupBy("error_type").agg((F.floor(F.avg("nrd") * 64) / 64).alias("expected"))
    other = spark.range(1).select(F.lit("null").alias("error_type"), F.lit(1.0).alias("expected"))
    own = cells.filter("policy = 'A' and error_type = 'numeric'").groupBy("error_type").agg(
        (F.sum("nrd") / F.count("nrd")).alias("expected"))
    return ra.anchor_check(means, "A", known.unionByName(other).unionByName(own))


@query("spread", """select policy, min(m) best, max(m) worst, max(m) - min(m) "range",
    max(m) <> min(m) discriminating, arg_min(placement, (m, placement)) best_placement from
    (select policy, placement, avg(nrd) m from spread group by 1, 2 having count(*) =
    (select count(distinct cell) from spread)) group by 1""")
def placement_spread(spark, sf_dir):
    return ra.placement_spread(_frame(spark, sf_dir, "spread"))


@query("actions", "select cell, round(nrd, 9) response, count(distinct action) actions from actions "
                  "group by 1, 2")
def response_classes(spark, sf_dir):
    return ra.cell_classes(_frame(spark, sf_dir, "actions"))


@query("twins costs", """select t.action, r.representative, r.members from (select action,
    string_agg(cell || ':' || nrd, ',' order by cell) sig from twins group by 1) t join
    (select sig, arg_min(action, (cost, action)) representative, count(*) members from (select action,
    string_agg(cell || ':' || nrd, ',' order by cell) sig from twins group by 1) join costs
    using (action) group by 1) r using (sig)""")
def response_equivalence(spark, sf_dir):
    twins, costs = frames(spark, sf_dir, "twins", "costs")
    return ra.equivalent_actions(twins, costs)


@query("actions", "select * from actions where nrd > 1 + 1e-12")
def response_amplifying(spark, sf_dir):
    return ra.amplifying(_frame(spark, sf_dir, "actions"))


@query("actions", """select * from (select cell, min(nrd) filter (action like 'static-%') best_static,
    min(nrd) filter (action like 'cond%') conditional, case when min(nrd) filter
    (action like 'static-%') = 0 then 0.0e0 else (min(nrd) filter (action like 'static-%') -
    min(nrd) filter (action like 'cond%')) / min(nrd) filter (action like 'static-%') end "escape"
    from actions group by 1) where best_static is not null and conditional is not null""")
def response_escape(spark, sf_dir):
    return ra.escape(_frame(spark, sf_dir, "actions"))


@query("cells", """select policy, error_type, k, n, n / cast(2 * n - k as double) q from (select policy,
    error_type, count(*) filter (fired) k, count(*) n from cells group by 1, 2)""")
def response_q_law(spark, sf_dir):
    n = _frame(spark, sf_dir, "cells").groupBy("policy", "error_type").agg(
        F.count_if("fired").alias("k"), F.count(F.lit(1)).alias("n"))
    return n.withColumn("q", ra.q_law("k", "n"))


KEY = ("family", "k", "node", "disposition")
_KEY = ", ".join(KEY)
_LAST = f"""resp as materialized (select {_KEY}, arg_max(nrd, (seq, nrd)) nrd, count(*) measurements,
    max(nrd) - min(nrd) > 1e-9 conflict from tries group by {_KEY})"""


@query("tries", f"select * from (with {_LAST} select * from resp)")
def response_conflicts(spark, sf_dir):
    return ra.response_table(_frame(spark, sf_dir, "tries"), KEY)


@query("tries", f"select {_KEY}, min(nrd) nrd, count(*) measurements, max(nrd) - min(nrd) > 1e-9 "
                f"conflict from tries group by {_KEY}")
def response_smallest(spark, sf_dir):
    return ra.response_table(_frame(spark, sf_dir, "tries"), KEY, keep="smallest")


_ORDER = "case disposition when 'dedup' then 1 when 'quarantine' then 2 else 3 end"


@query("tries pure fireable", f"""select * from (with {_LAST}, b as (select node, shape,
    arg_min(disposition, (nrd, {_ORDER})) d, min(nrd) v from resp join pure using (family) group by 1, 2)
    select g.node, g.shape, case when v < 1 - 1e-12 then d else 'no_op' end disposition,
    case when v < 1 - 1e-12 then v else 1.0e0 end nrd from (select distinct node, shape from fireable) g
    left join b using (node, shape))""")
def policy_map_argmin(spark, sf_dir):
    tries, pure, fire = frames(spark, sf_dir, "tries", "pure", "fireable")
    return ra.derive_policy(ra.response_table(tries, KEY), pure, fire)


_SIG = """sig as materialized (select p."plan", f.family, coalesce(s.signature, '') signature from
    (select distinct "plan" from plans) p cross join (select distinct family from fireable) f left join
    (select "plan", family, string_agg(distinct node || '/' || shape || '/' || disposition, ';' order by
    node || '/' || shape || '/' || disposition) signature from plans join fireable using (node, shape)
    where disposition <> 'no_op' and not (disposition = 'dedup' and shape <> 'duplicate_shape')
    group by 1, 2) s on s."plan" = p."plan" and s.family = f.family)"""
# A plan whose run failed is still predicted when another plan acts the same way.
_MEAS = _SIG + """, measured as materialized (select family, signature, arg_max(nrd, (seq, nrd)) nrd
    from plan_runs join sig using ("plan", family) where status = 'complete' group by 1, 2),
    pred as materialized (select "plan", family, signature, case when signature = '' then 1.0e0 else nrd
    end nrd from sig left join measured using (family, signature))"""
_SCORE = _MEAS + """, scored as materialized (select "plan", sum(nrd * weight) / sum(weight) score from
    pred join roster using (family) group by 1 having count(*) filter (nrd is null) = 0)"""


@query("plans fireable", f"select * from (with {_SIG} select * from sig)")
def plan_signature(spark, sf_dir):
    return ra.effective_signature(*frames(spark, sf_dir, "plans", "fireable"))


def _plan_frames(spark, sf_dir):
    """Plans, what can fire, and the responses measured for the signatures that act."""
    plans, fire, runs = frames(spark, sf_dir, "plans", "fireable", "plan_runs")
    run = runs.join(ra.acting_signatures(plans, fire), ["plan", "family"]).filter("status = 'complete'")
    return plans, fire, ra.response_table(run, ["family", "signature"])


@query("plans fireable plan_runs", f"select * from (with {_MEAS} select * from pred)")
def plan_predict(spark, sf_dir):
    plans, fire, measured = _plan_frames(spark, sf_dir)
    return ra.predict(ra.effective_signature(plans, fire), measured)


@query("plans fireable plan_runs roster",
       f"select * from (with {_SCORE} select * from scored)")
def plan_score(spark, sf_dir):
    return ra.sparse_score(*_plan_frames(spark, sf_dir), _frame(spark, sf_dir, "roster"))


BUDGETS = (0.0, 40.0, 70.0, 80.0, 90.0, 1e12)


@query("plan_runs plan_costs roster", """select * from (with s as (select "plan", sum(nrd * weight) /
    sum(weight) score, cost, size from plan_runs join roster using (family) join plan_costs
    using ("plan") group by 1, 3, 4) select cast(b as double) budget, "plan", score, cost, size from s,
    (values (0.0), (40.0), (70.0), (80.0), (90.0), (1e12)) v(b) where cost <= b qualify row_number()
    over (partition by b order by round(score, 12), cost, size, "plan") = 1)""")
def plan_best_per_budget(spark, sf_dir):
    runs, costs, roster = frames(spark, sf_dir, "plan_runs", "plan_costs", "roster")
    scored = ra.score(runs, roster).join(costs, "plan")
    return ra.best_per_budget(scored, BUDGETS)


_BIND = """bound as materialized (select m.method, m.budget, c.campaign, m."plan", case when m."plan" is
    null then 1.0e0 else r.nrd end nrd from methods m cross join (select distinct campaign from runs) c
    left join runs r on r.campaign = c.campaign and r."plan" = m."plan" and r.status = 'complete')"""
_AURD = _BIND + """, areas as materialized (select method, campaign, case when count(*) filter
    (nrd is null) = 0 then sum(a) end aurd from (select *, (nrd + lag(nrd) over w) / 2 * (budget -
    lag(budget) over w) / 4.0e0 a from bound window w as (partition by method, campaign order by budget))
    group by 1, 2)"""
_PAIR = _AURD + """, diffs as materialized (select a.campaign, a.aurd as "primary", b.aurd comparator,
    a.aurd - b.aurd diff from areas a join areas b on a.campaign = b.campaign and a.method = 'A' and
    b.method = 'N')"""


def _bound(spark, sf_dir):
    methods, runs = frames(spark, sf_dir, "methods", "runs")
    return ra.bind(methods, runs, runs)


@query("methods runs", f"select * from (with {_BIND} select * from bound)")
def plan_binding(spark, sf_dir):
    return _bound(spark, sf_dir)


@query("methods runs", f"select * from (with {_BIND} select method, budget, campaign from bound "
                       "where nrd is null)")
def plan_binding_missing(spark, sf_dir):
    return ra.missing(_bound(spark, sf_dir))


@query("methods runs", f"select * from (with {_AURD} select * from areas)")
def aurd(spark, sf_dir):
    return ra.aurd(_bound(spark, sf_dir), 4)


@query("methods runs", f"select * from (with {_PAIR} select * from diffs)")
def paired_diff(spark, sf_dir):
    return ra.paired(ra.aurd(_bound(spark, sf_dir), 4), "A", "N")


_PSUM = """p as (select count(diff) campaigns, avg(diff) mean_diff, avg("primary") mean_primary,
    avg(comparator) mean_comparator, count(*) filter (abs(diff) > 1e-12) nonzero,
    count(distinct round(diff, 12)) distinct_values from diffs)"""


@query("methods runs", f"select * from (with {_PAIR}, {_PSUM} select *, coalesce(-mean_diff / "
                       "nullif(mean_comparator, 0), 0.0e0) relative_improvement from p)")
def paired_summary(spark, sf_dir):
    return ra.paired_summary(ra.paired(ra.aurd(_bound(spark, sf_dir), 4), "A", "N"))


@query("methods runs", f"select * from (with {_AURD} select family, method, avg(aurd) mean_aurd from "
                       "areas join (select distinct campaign, family from runs) using (campaign) "
                       "group by 1, 2 having count(*) filter (aurd is null) = 0)")
def family_mean_aurd(spark, sf_dir):
    runs = _frame(spark, sf_dir, "runs")
    return ra.family_means(ra.aurd(_bound(spark, sf_dir), 4), runs)


@query("methods runs", f"""select * from (with {_BIND}, w as (select method, budget, case when count(*)
    filter (nrd is null) = 0 then max(nrd) end nrd from bound group by 1, 2) select method,
    case when count(*) filter (nrd is null) = 0 then sum(a) end aurd from (select *, (nrd + lag(nrd)
    over x) / 2 * (budget - lag(budget) over x) / 4.0e0 a from w window x as (partition by method
    order by budget)) group by 1)""")
def worst_case_aurd(spark, sf_dir):
    return ra.worst_case(_bound(spark, sf_dir), 4)


@query("runs", """select count(*) placements, max(clean_absolute_damage) max_clean_collateral,
    bool_and(clean_absolute_damage = 0) clean_collateral_zero, bool_and(availability_loss = 0 and
    clean_availability_loss = 0) availability_full from runs""")
def safety_check(spark, sf_dir):
    return ra.safety(_frame(spark, sf_dir, "runs"))


@query("methods runs", f"""select * from (with {_PAIR}, {_PSUM}, m as (select count(*) open from bound
    where nrd is null) select campaigns > 1 campaigns_complete, open = 0 bindings_complete,
    nonzero > 0 distinguishable, mean_diff < 0 mean_negative, coalesce(-mean_diff /
    nullif(mean_comparator, 0), 0.0e0) >= 0.1 large_enough, case when campaigns > 1 and open = 0 and
    nonzero > 0 and mean_diff < 0 and coalesce(-mean_diff / nullif(mean_comparator, 0), 0.0e0) >= 0.1
    then 'GO' else 'NO_GO' end decision from p, m)""")
def gate_criteria(spark, sf_dir):
    bound = _bound(spark, sf_dir)
    facts = ra.paired_summary(ra.paired(ra.aurd(bound, 4), "A", "N"))
    opened = ra.missing(bound).agg(F.count(F.lit(1)).alias("open"))
    return ra.criteria(ra.attach(facts, opened), {
        "campaigns_complete": "campaigns > 1", "bindings_complete": "open = 0",
        "distinguishable": "nonzero > 0", "mean_negative": "mean_diff < 0",
        "large_enough": "relative_improvement >= 0.1"})


# --- audits ------------------------------------------------------------------------------------

_LOO = _LAST + """, forks as (select distinct node, case when node <= 'node3' then 'a' else 'b' end fork
    from resp), r as (select * from resp join forks using (node)),
    loo as materialized (select family, k, node, disposition, nrd measured, 1.0e0 inert,
    (select arg_min(o.nrd, o.node) from r o where o.family = r.family and o.k = r.k and
      o.disposition = r.disposition and o.fork = r.fork and o.node <> r.node) "location",
    (select arg_min(o.nrd, (abs(o.k - r.k), o.k)) from r o where o.family = r.family and
      o.node = r.node and o.disposition = r.disposition and o.k <> r.k) nearest from r),
    lo as materialized (select *, coalesce("location", nearest, 1.0e0) combined from loo)"""


def _loo(spark, sf_dir):
    resp = ra.response_table(_frame(spark, sf_dir, "tries"), KEY)
    forks = resp.select("node").distinct().withColumn(
        "fork", F.when(F.col("node") <= "node3", "a").otherwise("b"))
    return ra.extrapolate(resp, forks)


@query("tries", f"select * from (with {_LOO} select * from lo)")
def extrapolation_loo(spark, sf_dir):
    return _loo(spark, sf_dir)


_DIR = "case when {0} < 1 - 1e-9 then 'helps' when {0} > 1 + 1e-9 then 'hurts' else 'no-op' end"


@query("tries", f"""select * from (with {_LOO}, l as (select measured, u.predictor, u.v from lo,
    lateral (values ('inert', inert), ('location', "location"), ('nearest', nearest),
    ('combined', combined)) u(predictor, v)) select predictor, count(v) covered,
    count(v) / cast(count(*) as double) coverage, avg(abs(v - measured)) mae,
    list_sort(list(abs(v - measured)) filter (v is not null))[cast(floor(count(v) / 2) as int) + 1]
    median_error, max(abs(v - measured)) max_error, count(*) filter (v is not null and
    {_DIR.format('v')} = {_DIR.format('measured')}) / cast(count(v) as double) direction_accuracy
    from l group by 1)""")
def extrapolation_quality(spark, sf_dir):
    return ra.extrapolation_quality(_loo(spark, sf_dir))


@query("tries pure fireable", f"""select * from (with c as (select distinct cell from tries),
    f as (select 'full' fold, * from tries union all select c.cell, t.* from c join tries t
      on t.cell <> c.cell),
    b as (select fold, node, shape, arg_min(disposition, (nrd, {_ORDER})) d, min(nrd) v from f
      join pure using (family) group by 1, 2, 3),
    e as (select fold, node, shape, case when v < 1 - 1e-12 then d else 'no_op' end d from b),
    g as (select distinct node, shape from fireable)
    select r.fold held_out, node, shape, x.d as "full", r.d reduced from e x join e r
    using (node, shape) join g using (node, shape) where x.fold = 'full' and r.fold <> 'full'
    and x.d <> r.d)""")
def map_stability(spark, sf_dir):
    return ra.map_stability(*frames(spark, sf_dir, "tries", "pure", "fireable"))


# Single tables as candidate plans, scored on what the full data says about each of them.
_SELECT = f"""{_LAST}, c as (select distinct cell from tries),
    f as (select '' fold, * from tries union all select c.cell, t.* from c join tries t
      on t.cell <> c.cell),
    b as (select fold, node, shape, arg_min(disposition, (nrd, {_ORDER})) d, min(nrd) v from f
      join pure using (family) group by 1, 2, 3),
    g as (select distinct node, shape from fireable),
    e as (select fold, node, shape, case when v < 1 - 1e-12 then d else 'no_op' end d from b join g
      using (node, shape)),
    ch as (select distinct r.fold from e x join e r using (node, shape) where x.fold = '' and
      r.fold <> '' and x.d <> r.d),
    folds as (select fold from ch union all select ''),
    m as (select family, node || '/' || p.shape || '/' || disposition signature, min(nrd) nrd from tries
      join pure p using (family) group by 1, 2),
    s as (select f.fold, e.node "plan", p.family, string_agg(e.node || '/' || e.shape || '/' || e.d, ';')
      filter (e.d <> 'no_op' and not (e.d = 'dedup' and e.shape <> 'duplicate_shape') and fr.shape is not
      null) signature from folds f join e on e.fold = f.fold cross join (select distinct family from
      fireable) p left join fireable fr on fr.family = p.family and fr.node = e.node and
      fr.shape = e.shape group by 1, 2, 3),
    q as (select s.fold, s."plan", sum(case when s.signature is null then 1.0e0 else m.nrd end * weight)
      / sum(weight) score from s left join m using (family, signature) join roster using (family)
      group by 1, 2 having count(*) filter (s.signature is not null and m.nrd is null) = 0),
    k as (select node "plan", cast(count(*) as double) cost, 1 size from resp group by 1),
    w as (select fold, b.budget, arg_min("plan", (round(score, 12), cost, size, "plan")) p from q join k
      using ("plan") join (values (0.0e0), (1000.0e0), (1e12)) b(budget) on k.cost <= b.budget
      group by 1, 2)"""


@query("tries pure fireable roster", f"""select * from (with {_SELECT} select r.fold held_out, budget,
    x.p "full", r.p reduced from w r left join w x using (budget) where r.fold <> '' and x.fold = ''
    and x.p <> r.p)""")
def map_selection_stability(spark, sf_dir):
    tries, pure, fire, roster = frames(spark, sf_dir, "tries", "pure", "fireable", "roster")
    resp = ra.response_table(tries, KEY)
    changes = ra.map_stability(tries, pure, fire)
    policy = ra.derive_policy(tries, pure, fire)
    measured = tries.join(pure, "family").groupBy("family", F.concat_ws(
        "/", "node", "shape", "disposition").alias("signature")).agg(F.min("nrd").alias("nrd"))
    costs = resp.groupBy(F.col("node").alias("plan")).agg(
        F.count(F.lit(1)).cast("double").alias("cost"), F.lit(1).alias("size"))
    candidates = fire.select(F.col("node").alias("plan"), "node").distinct()
    return ra.selection_stability(changes, policy, candidates, fire, measured, roster, costs,
                                  (0.0, 1000.0, 1e12))


@query("parts", """select *, observed - predicted residual from (select campaign, k_num, q, share,
    (q - 1) * share * 0.875e0 predicted, observed from (select campaign, cast(regexp_extract(campaign,
    '-(\\d+)x[^-]*$', 1) as int) k_num, 10 / cast(20 - cast(regexp_extract(campaign, '-(\\d+)x[^-]*$', 1)
    as int) as double) q, d_num / d_mixed share, observed from parts))""")
def dose_line(spark, sf_dir):
    return ra.dose_line(_frame(spark, sf_dir, "parts"), 10, 0.25)


_COST = """c as (select node, step, max(m) micros from (select node, step, workload, median(micros) m
    from trials group by 1, 2, 3) group by 1, 2),
    v as (select node, max(micros) filter (step = 'deploy') deploy, max(micros) filter
    (step = 'detect') detect, max(micros) filter (step not in ('deploy', 'detect')) worst_disposition
    from c group by 1)"""


@query("trials", f"""select * from (with {_COST} select *, deploy + detect + worst_disposition total,
    (deploy + detect + worst_disposition) / deploy understatement from v)""")
def cost_view(spark, sf_dir):
    return ra.cost_view(ra.trial_costs(_frame(spark, sf_dir, "trials")))


@query("trials", f"""select * from (with {_COST}, t as (select sum(deploy + detect + worst_disposition) a,
    min(deploy + detect + worst_disposition) b from v) select u.step::int step, u.budget from t,
    lateral (values (0, 0.0e0), (1, b), (2, a * 0.25e0), (3, a * 0.5e0), (4, a)) u(step, budget))""")
def cost_budget_grid(spark, sf_dir):
    view = ra.cost_view(ra.trial_costs(_frame(spark, sf_dir, "trials")))
    return ra.budget_grid(view, [0.25, 0.5])


@query("cells", """select a.error_type as round, a.m predicted, b.m observed, (b.m - a.m) * 100 gap_points
    from (select error_type, avg(nrd) m from cells where policy = 'A' group by 1) a join
    (select error_type, avg(nrd) m from cells where policy = 'N' group by 1) b using (error_type)""")
def round_check(spark, sf_dir):
    means = ra.error_type_means(_frame(spark, sf_dir, "cells"))

    def side(policy, name):
        return means.filter(F.col("policy") == policy).select(
            F.col("error_type").alias("round"), F.col("mean_nrd").alias(name))
    return ra.round_check(side("A", "predicted"), side("N", "observed"))


# --- statistics --------------------------------------------------------------------------------

_H = "('0x' || substr(sha256({0}), 1, 15))::bigint"
_BOOT = f"""v as materialized (select comparison, diff, row_number() over (partition by comparison
    order by {_H.format('campaign')}, campaign) - 1 i, count(*) over (partition by comparison) n from diffs),
    d as materialized (select comparison, r, {_H.format("'7|' || r || '|' || i")} % n i from v,
    range(0, 1000) t(r)),
    means as materialized (select comparison, r, avg(diff) m from d join v using (comparison, i)
    group by 1, 2)"""


@query("diffs", f"""select * from (with {_BOOT} select comparison, round(avg(m), 9) mean, list_sort(list(m))[26] lower,
    list_sort(list(m))[975] upper, count(*) filter (m < 0) / 1000.0e0 below_zero from means group by 1)""")
def bootstrap_ci(spark, sf_dir):
    out = stats.bootstrap_ci(_frame(spark, sf_dir, "diffs"), resamples=1000, seed="7")
    return out.withColumn("mean", F.round("mean", 9))


_FLIP = """s as (select comparison, list(diff order by campaign) d, count(*) n, sum(diff) / count(*) o
    from diffs group by 1), m as (select comparison, n, o, list_sum(list_transform(range(0, n), lambda i:
    case when (mask >> i) & 1 = 1 then d[i + 1] else -d[i + 1] end)) t from s,
    range(0, 4096) x(mask) where mask < (1 << n))"""


@query("diffs", f"""select * from (with {_FLIP} select comparison, n, count(*) filter (t / n <= o + 1e-15)
    / cast(count(*) as double) p, 'exact' status from m group by 1, 2)""")
def sign_flip(spark, sf_dir):
    return stats.sign_flip(_frame(spark, sf_dir, "diffs"))


_HALVES = """s as (select comparison, list(diff order by campaign) d, count(*) n, sum(diff) + count(*) * 1e-15 o
    from long_diffs group by 1),
    h as (select comparison, 0 side, d[1:n // 2] d, o from s union all select comparison, 1, d[n // 2 + 1:], o from s),
    t as (select comparison, side, o, list_sum(list_transform(range(0, len(d)), lambda i:
    case when (mask >> i) & 1 = 1 then d[i + 1] else -d[i + 1] end)) t from h, range(0, 16384) x(mask)
    where mask < (1 << len(d))),
    g as (select comparison, case side when 0 then t else o - t end v, count(*) filter (side = 0) a,
    count(*) filter (side = 1) b from t group by 1, 2),
    m as (select comparison, b * sum(a) over (partition by comparison order by v) hits from g)"""


@query("long_diffs", f"""select * from (with {_HALVES} select comparison, n, cast(sum(hits) as double) / pow(2.0e0, n) p,
    'exact' status from m join s using (comparison) group by 1, 2)""")
def sign_flip_long(spark, sf_dir):
    """Comparisons beyond what all single assignments could be listed for."""
    return stats.sign_flip(_frame(spark, sf_dir, "long_diffs"))


@query("long_diffs", f"""select * from (with {_HALVES}, f as (select comparison, n, sum(hits) / pow(2.0e0, n) p
    from m join s using (comparison) group by 1, 2),
    p as (select 'flags' family, comparison as "name", p from f union all select 'flags', 'none', null),
    r as (select *, row_number() over (partition by family order by p, "name") rank, count(p) over (partition by family) m
    from p where p is not null)
    select family, "name", p, rank, max(least(1.0e0, (m - rank + 1) * p)) over (partition by family order by rank)
    adjusted from r union all select family, "name", p, null, null from p where p is null)""")
def holm_with_refused(spark, sf_dir):
    """Adjusted p of the flips of all flags, with a comparison that was refused."""
    flips = stats.sign_flip(_frame(spark, sf_dir, "long_diffs").unionByName(
        _frame(spark, sf_dir, "long_diffs").select(F.lit("none").alias("comparison"), "campaign",
                                                    F.lit(None).cast("double").alias("diff"))))
    return stats.holm(flips.select(F.lit("flags").alias("family"), F.col("comparison").alias("name"), "p"))


@query("pvals", """select family, "name", p, rank, max(least(1.0e0, (m - rank + 1) * p)) over (partition by
    family order by rank) adjusted from (select *, row_number() over (partition by family order by p,
    "name") rank, count(*) over (partition by family) m from pvals)""")
def holm(spark, sf_dir):
    return stats.holm(_frame(spark, sf_dir, "pvals"))
