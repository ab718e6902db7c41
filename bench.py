"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from dqspark.operators import dispositions as act
from dqspark.operators import signals as sig
from dqspark.operators.damage import exact_damage, sink_base, sink_damage
from dqspark.operators.injection import inject_all
from dqspark.plans.delta import delta_run
from dqspark.plans.star import STAR, sources
from dqspark.queries import cases, registry
from dqspark.session import materialize, tune

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
REGISTERED = ("fact_lineitem", "mart_part_report", "signal_duplicate", "band_margin_sweep",
              "table_digest", "cut_quantile", "protected_branch", "wire_fact_market_history",
              "bootstrap_ci")


def session() -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS)
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    # Costs are those of operators over a stored clean snapshot; storing it is not timed.
    tables = STAR.store(STAR.build(sources(spark, SF_DIR)), files=int(CPUS))
    lines, part, rule = tables["stg_lineitem"], tables["stg_part"], STAR.rules["stg_lineitem"]
    loose = cases.LOOSE_LINE
    band = sig.derive_bands({"l": lines}, {"l": rule})["l"]
    orders = tables["stg_orders"]
    dirty = materialize(inject_all(orders, cases.mixed(orders)), "dirty")
    jobs = {
        "detect_all_rules_lineitem": lambda: sig.signal_report(lines, rule, band, part),
        "detect_all_rules_orders": lambda: sig.signal_report(
            dirty, cases.ORDERS_RULE, band, tables["stg_customer"]),
        "flag_all_rows_lineitem": lambda: sig.flag(lines, rule, band, part),
        "dedup_lineitem": lambda: act.dedup(lines, loose.key),
        "quarantine_duplicates_lineitem": lambda: act.quarantine(
            sig.flag_shape(lines, loose, "duplicate_shape"), "duplicate_shape")[0],
        "route_snapshot_orders": lambda: act.route_snapshot(
            dirty, cases.ORDERS_RULE, cases.QUARANTINE_ALL, band, tables["stg_customer"]).df,
        "damage_exact_orders": lambda: exact_damage(orders, dirty, ("orderkey",)),
        "damage_exact_lineitem": lambda: exact_damage(lines, lines.filter("linenumber < 7"),
                                                      rule.key),
    }
    specs = cases.mixed(orders)
    base = materialize(sink_base(tables, STAR.sinks), "base")      # belongs to the stored snapshot

    def branch():
        done = delta_run(STAR, tables, specs, {"stg_orders": cases.CONDITIONAL},
                         sig.derive_bands({"stg_orders": orders}, STAR.rules))
        return sink_damage(tables, done.tables, STAR.sinks, changes=done.changes, base=base)

    jobs["branch_on_stored_snapshot"] = branch
    every = registry.queries()
    for name in REGISTERED:
        jobs[name] = lambda q=every[name]: q(spark, SF_DIR)
    seconds = {}
    for name, job in jobs.items():
        times = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            run(job())
            times.append(time.perf_counter() - start)
        seconds[name] = round(sorted(times)[len(times) // 2], 3)
    print(json.dumps({"metric": "headline queries, sum of medians",
                      "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(SF_DIR)[2:]}))
    spark.stop()


if __name__ == "__main__":
    main()
