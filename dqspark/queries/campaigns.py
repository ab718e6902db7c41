"""From measured branches to chosen plans: families of one error shape each, at two tables of the star.

Every family is injected, each disposition that may answer its shape is run as a branch of its own, and
the damage relative to doing nothing is its response. The responses give the policy; plans deploy the
policy at some of the tables, are scored from the responses alone, and the best plan of each budget is
taken. The SQL states every branch, so nothing here is a constant.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.analytics import responses as ra
from dqspark.operators.injection import Injection
from dqspark.operators.signals import derive_bands
from dqspark.operators.targets import pick_targets, pin
from dqspark.plans.delta import responses
from dqspark.plans.star import STAR
from dqspark.queries import cases as c
from dqspark.queries.common import star_ctes, star_tables, top_keys, with_sql
from dqspark.session import materialize

QUERIES = {}
ORACLES = {}

#: family: node, shape, dispositions, weight in the roster
FAMILIES = {"shifts": ("stg_orders", "numeric_shape", ("quarantine", "null_out"), 3),
            "copies": ("stg_orders", "duplicate_shape", ("dedup", "quarantine"), 2),
            "blanks": ("stg_orders", "null_shape", ("quarantine",), 1),
            "orphans": ("stg_orders", "fk_shape", ("quarantine",), 1),
            "part_copies": ("stg_part", "duplicate_shape", ("dedup", "quarantine"), 2)}
NODES = ("stg_orders", "stg_part")
BUDGETS = (0.0, 0.25, 0.95, 1.0)
K, PART_K = 40, 5
_PART_SINKS = ("mart_part_report", "mart_daily_ship", "mart_part_master")


def _snapshot(spark, sf_dir):
    clean = star_tables(spark, sf_dir)
    return STAR.store(clean, [*STAR.sinks, *NODES, "stg_customer", "stg_lineitem", "dim_part", "fact_order"])


def _injections(clean):
    orders = c.order_targets(clean["stg_orders"], K, "campaign")
    parts = pin(pick_targets(clean["stg_part"], ("partkey",), PART_K, "campaign"))
    return {"shifts": [c.numeric(orders)], "copies": [c.duplicate(orders)], "blanks": [c.blank(orders)],
            "orphans": [c.orphan(orders)],
            "part_copies": [Injection("stg_part", "duplicate_rows", parts, ("partkey",))]}


def measured_responses(spark, sf_dir):
    """(family, node, shape, disposition, nrd) of every branch, and the clean snapshot."""
    clean = _snapshot(spark, sf_dir)
    specs = _injections(clean)
    bands = derive_bands({n: clean[n] for n in NODES}, {n: STAR.rules[n] for n in NODES})
    rows = responses(STAR, clean, {f: (specs[f], node, shape, acts) for f, (node, shape, acts, _) in FAMILIES.items()}, bands)
    return rows, clean


# --- SQL ---------------------------------------------------------------------------------------

_DOUBLE = "(select {k} from {t} group by 1 having count(*) > 1)"
_DIRTY = {"shifts": c.sql_numeric("stg_orders", "true"), "copies": c.sql_duplicate("stg_orders", "true"),
          "blanks": c.sql_blank("stg_orders", "true"), "orphans": c.sql_orphan("stg_orders", "true"),
          "part_copies": "select * from stg_part union all select * from stg_part where partkey in "
                         "(select partkey from part_targets)"}
_ACTED = {("shifts", "quarantine"): c.sql_quarantine_numeric("d_shifts"),
          ("shifts", "null_out"): f"select * replace (case when {c.SQL_OUT} then null else total_price end as total_price) from d_shifts",
          ("copies", "dedup"): c.sql_dedup("d_copies", "orderkey", c.ORDER_COLUMNS),
          ("copies", "quarantine"): f"select * from d_copies where orderkey not in {_DOUBLE.format(k='orderkey', t='d_copies')}",
          ("blanks", "quarantine"): "select * from d_blanks where total_price is not null",
          ("orphans", "quarantine"): "select * from d_orphans where custkey is null or custkey in (select custkey from stg_customer)",
          ("part_copies", "dedup"): "select distinct * from d_part_copies",
          ("part_copies", "quarantine"):
              f"select * from d_part_copies where partkey not in {_DOUBLE.format(k='partkey', t='d_part_copies')}"}


def _branch(table: str, node: str, suffix: str) -> list[str]:
    touched = _PART_SINKS if node == "stg_part" else tuple(c.TOUCHED)
    return [*star_ctes({node: f"select * from {table}"}, suffix), c.sql_sinks(suffix, "s" + suffix, touched)]


def _measured_ctes() -> list[str]:
    out = [*star_ctes(), c.sql_targets("targets", K, "campaign"),
           f"part_targets as materialized ({top_keys('stg_part', ['partkey'], PART_K, 'campaign')})"]
    rows = []
    for f, (node, shape, acts, _) in FAMILIES.items():
        out += [f"d_{f} as materialized ({_DIRTY[f]})", *_branch(f"d_{f}", node, f"_d_{f}")]
        for act in acts:
            name = f"{f}_{act}"
            out += [f"x_{name} as materialized ({_ACTED[f, act]})", *_branch(f"x_{name}", node, f"_{name}")]
            rows.append(f"select '{f}' family, '{node}' node, '{shape}' shape, '{act}' disposition, "
                        f"(select avg(damage) from s_{name}) / (select avg(damage) from s_d_{f}) nrd")
    return [*out, "measured as materialized (" + " union all ".join(rows) + ")"]


_POLICY = """policy as materialized (select node, shape, case when nrd < 1 - 1e-12 then disposition else 'no_op' end disposition
    from measured qualify row_number() over (partition by node, shape order by nrd,
    list_position(['dedup', 'quarantine', 'null_out'], disposition)) = 1)"""
_ROSTER = "roster(family, weight) as (values " + ", ".join(f"('{f}', {w})" for f, (*_, w) in FAMILIES.items()) + ")"
_PLANS = """plans("plan", node) as (values ('none', null), ('orders', 'stg_orders'), ('parts', 'stg_part'),
    ('both', 'stg_orders'), ('both', 'stg_part'))"""
_SCORED = """sizes as (select 'stg_orders' node, count(*) n from stg_orders union all select 'stg_part', count(*) from stg_part),
    answers as materialized (select p."plan", m.family, m.nrd from plans p join policy q using (node) join measured m
      using (node, shape, disposition)),
    scored as materialized (select s."plan", score, coalesce(n, 0) / cast(total as double) cost, size from
      (select p."plan", sum(coalesce(nrd, 1.0e0) * weight) / sum(weight) score from (select distinct "plan" from plans) p
      cross join roster r left join answers a on a.family = r.family and a."plan" = p."plan" group by 1) s join
      (select "plan", sum(n) n, count(node) size from plans left join sizes using (node) group by 1) k using ("plan"),
      (select sum(n) total from sizes))"""
_BEST = "best as materialized (select cast(b as double) budget, \"plan\", score, cost, size from scored, (values " + ", ".join(
    f"({b})" for b in BUDGETS) + """) v(b) where cost <= b qualify row_number() over (partition by b order by round(score, 12),
    cost, size, "plan") = 1)"""
_AREA = """curve as (select r.family campaign, b.budget, coalesce(a.nrd, 1.0e0) nrd from roster r cross join best b left join
    answers a on a.family = r.family and a."plan" = b."plan"),
    area as (select campaign, sum(s) aurd from (select *, (nrd + lag(nrd) over w) / 2 * (budget - lag(budget) over w) s from curve
    window w as (partition by campaign order by budget)) group by 1)"""


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn
    return add


def _chosen(spark, sf_dir):
    """Plans, what fires, signature responses, roster, and the best plan of every budget."""
    rows, clean = measured_responses(spark, sf_dir)
    pure = spark.createDataFrame([(f, s) for f, (_, s, *_) in FAMILIES.items()], "family string, shape string")
    grid = rows.select("node", "shape").distinct()
    policy = materialize(ra.derive_policy(rows.drop("shape"), pure, grid), "policy")
    plans = spark.createDataFrame([("none", None), ("orders", "stg_orders"), ("parts", "stg_part"), ("both", "stg_orders"),
                                   ("both", "stg_part")], "plan string, node string")
    entries = plans.join(policy.select("node", "shape", "disposition"), "node", "left").select(
        "plan", "node", "shape", F.coalesce("disposition", F.lit("no_op")).alias("disposition"))
    fire = rows.select("family", "node", "shape").distinct()
    known = rows.select("family", F.concat_ws("/", "node", "shape", "disposition").alias("signature"), "nrd")
    roster = spark.createDataFrame([(f, w) for f, (*_, w) in FAMILIES.items()], "family string, weight long")
    sizes = None
    for n in NODES:
        row = clean[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("node"), "n")
        sizes = row if sizes is None else sizes.unionByName(row)
    whole = sizes.agg(F.sum("n").alias("all")).withColumn("_one", F.lit(1))
    costs = plans.join(sizes, "node", "left").groupBy("plan").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("node").alias("size")).withColumn("_one", F.lit(1)).join(
        whole, "_one").select("plan", (F.col("n") / F.col("all").cast("double")).alias("cost"), "size")
    scored = ra.sparse_score(entries, fire, known, roster).join(costs, "plan")
    best = materialize(ra.best_per_budget(scored, BUDGETS), "best")
    return entries, fire, known, roster, best


@query(with_sql(_measured_ctes(), "select family, node, shape, disposition, round(nrd, 9) nrd from measured"))
def campaign_responses(spark, sf_dir):
    """The measured response of every family of errors to every disposition."""
    rows, _ = measured_responses(spark, sf_dir)
    return rows.select("family", "node", "shape", "disposition", F.round("nrd", 9).alias("nrd"))


@query(with_sql([*_measured_ctes(), _POLICY, _ROSTER, _PLANS, _SCORED, _BEST, _AREA],
                'select budget, "plan", round(score, 9) score, round(cost, 12) cost, size, round(mean_area, 9) mean_area '
                "from best, (select avg(aurd) mean_area from area)"))
def campaign_plans(spark, sf_dir):
    """The plan that measured responses choose for every budget, with its predicted score, and the mean over
    the families of the area under the residual damage of these plans over the budget."""
    entries, fire, known, roster, best = _chosen(spark, sf_dir)
    answers = ra.predict(ra.acting_signatures(entries, fire), known).select(
        F.col("family").alias("campaign"), "plan", "nrd", F.lit("complete").alias("status"))
    bound = ra.bind(best.select(F.lit("measured").alias("method"), "budget", "plan"), answers,
                    roster.select(F.col("family").alias("campaign")))
    bound = bound.withColumn("nrd", F.coalesce("nrd", F.lit(1.0)))       # a plan that does not act leaves all damage
    area = ra.aurd(bound, 1.0).agg(F.round(F.avg("aurd"), 9).alias("mean_area")).withColumn("_one", F.lit(1))
    return best.withColumn("_one", F.lit(1)).join(area, "_one").select(
        "budget", "plan", F.round("score", 9).alias("score"), F.round("cost", 12).alias("cost"), "size", "mean_area")
