"""Protected runs as changes: only what an error or an action reaches is built again.

A changed table is its clean version without the rows of some keys, and new rows in their place. A node
says by a ``Cut`` through which columns a changed parent reaches it: the node's rows of those values
are built anew from the parents' rows of those values, all others stay. So counts, sums, maxima, latest
rows and distinct counts of an affected group come from the whole group, and no other group is read
into a shuffle. A node without a cut for a changed parent, or with changes that reach it through
different columns, is rebuilt whole.

Every disposition works on the rows of one key, once it is known where its shape fires. So a planned
table is searched for the keys that any shape fires on, and the policy acts on the rows of these keys
alone; the counts of fires are counts over those few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from dqspark.functions.skew import any_null, within, without
from dqspark.operators.damage import nrd, sink_base, sink_damage
from dqspark.operators.dispositions import route_live, route_snapshot, route_verdict
from dqspark.operators.injection import (
    Injection, check_hits, inject, marked_targets, replay, require_hits, same_keys)
from dqspark.operators.signals import Rule, hit_keys, several_keys
from dqspark.plans.lineage import Cut, Lineage, Node, Plan, Run, Tables
from dqspark.session import materialize


#: Branches of one snapshot that run at the same time; most of a branch is short jobs one after another.
BRANCHES = 4
_SEARCH = Lock()


@dataclass(frozen=True)
class Change:
    """In place of the rows of ``keys`` (values of the columns ``own``, which may repeat) stand the rows
    ``added``; without keys all rows may differ. ``removed`` are the clean rows, where stored."""

    own: tuple[str, ...] = ()
    keys: DataFrame | None = None
    added: DataFrame | None = None
    removed: DataFrame | None = None

    @property
    def whole(self) -> bool:
        return self.keys is None

    def applied(self, clean: DataFrame) -> DataFrame:
        return without(clean, self.keys, self.own).unionByName(self.added)

    def values(self, columns: Sequence[str]) -> DataFrame:
        """Values of ``columns`` that rows which went or came hold."""
        return self.removed.select(*columns).union(self.added.select(*columns))


WHOLE = Change()


@dataclass
class DeltaRun(Run):
    """A run whose tables are patched clean tables; ``changes`` holds one entry for each changed table."""

    changes: dict[str, Change] = field(default_factory=dict)


class _Branch:
    def __init__(self, lineage: Lineage, clean: Tables, bands: Mapping, fires: dict, loci: set):
        self.lineage, self.clean, self.bands, self.fires, self.loci = lineage, clean, bands, fires, loci
        self.lean = getattr(clean, "lean", {})
        #: What the tables below see of a changed table, where that is less than its change.
        self.seen: dict[str, Change] = {}
        self.run = DeltaRun(dict(clean))
        self.feeds = {p for n in lineage.nodes for p in n.parents}

    def put_whole(self, name: str, table: DataFrame) -> None:
        self.run.changes[name] = WHOLE
        self.run.tables[name] = materialize(table, name) if name in self.feeds else table

    def put(self, name: str, own: tuple[str, ...], keys: DataFrame, added: DataFrame,
            gone: DataFrame | None = None) -> None:
        """The rows of the keys in a table, stored where others are built from it."""
        change = self._stored(name, own, keys, added, gone) if name in self.feeds else Change(own, keys, added)
        self.run.changes[name] = change
        self.run.tables[name] = change.applied(self.clean[name])

    def _stored(self, name: str, own: tuple[str, ...], keys: DataFrame, added: DataFrame,
                gone: DataFrame | None = None) -> Change:
        gone = within(self.clean[name], keys, own) if gone is None else gone
        both = materialize(gone.withColumn("_new", F.lit(False)).unionByName(added.withColumn("_new", F.lit(True))), name)
        return Change(own, keys, both.filter("_new").drop("_new"), both.filter("not _new").drop("_new"))

    def _read(self, node: Node) -> dict[str, DataFrame]:
        """The parents of a node of which it reads less than all."""
        out = {}
        for p in node.parents:
            change = self.seen.get(p, self.run.changes.get(p))
            table = self.lean.get((node.name, p))
            if table is None and p in self.seen:
                table = self.clean[p]
            if table is not None and not (change and change.whole):
                out[p] = change.applied(table) if change else table
        return out

    def _unread(self, node: Node, change: Change, cut: Cut) -> bool:
        """Whether nothing reads what the lookup fills in, so that only the number of rows matters."""
        below = [n for n in self.lineage.nodes if node.name in n.parents]
        return bool(cut.fills and cut.columns == change.own and below and node.name not in self.loci
                    and node.name not in self.lineage.sinks
                    and all(set(cut.fills) <= set(n.ignores.get(node.name, ())) for n in below))

    @staticmethod
    def _recounted(change: Change) -> DataFrame:
        """Keys under which a left lookup finds another number of rows; none counts as one."""
        rows = change.removed.select(*change.own, F.lit(1).alias("_o"), F.lit(0).alias("_n")).union(
            change.added.select(*change.own, F.lit(0), F.lit(1)))
        rows = rows.filter(~any_null(change.own)).groupBy(*change.own).agg(F.sum("_o").alias("_o"), F.sum("_n").alias("_n"))
        return rows.filter("greatest(_o, 1) <> greatest(_n, 1)").select(*change.own)

    def inject(self, name: str, specs: Sequence[Injection], strict: bool, planned: bool) -> None:
        """Errors change the rows of their target keys."""
        table, change, own = self.run.tables[name], self.run.changes.get(name), specs[0].key
        if not same_keys(specs) or change and change.own != own:
            for spec in specs:
                if strict:
                    require_hits(table, spec)
                table = inject(table, spec)
            self.put_whole(name, table)
            return
        keys = reduce(DataFrame.union, [s.targets.select(*own) for s in specs] + ([change.keys] if change else []))
        small = materialize(marked_targets(within(table, keys, own), specs), name)
        if strict:
            check_hits(small, specs)
        change = Change(own, keys, replay(small, specs).select(*table.columns), small.select(*table.columns))
        if planned:     # the policy changes it once more
            self.run.changes[name], self.run.tables[name] = change, change.applied(self.clean[name])
        else:
            self.put(name, own, keys, change.added)

    def _hit_keys(self, name: str, policy: Mapping[str, str], routing: str, targets: DataFrame | None) -> DataFrame:
        """Keys that a shape which the routing looks at fires on, or that hold several rows.

        Those of a changed key count anyway, and all other keys hold their clean rows. So the clean table
        is searched, once for all branches that share ``fires``.
        """
        rule = self.lineage.rules[name]
        if targets is not None:
            return targets.select(*rule.key)
        used = {s for s, a in policy.items() if a != "no_op"}
        if routing == "verdict":
            rule = Rule(rule.key, rule.numeric)
        elif routing == "live":
            rule = Rule(rule.key, rule.numeric if "numeric_shape" in used else None,
                        rule.null if "null_shape" in used else None,
                        *((rule.fk, rule.fk_payload) if "fk_shape" in used else (None, None)), rule.parent_null_guard)
        several = routing != "live" or "duplicate_shape" in used
        band, parent = self.bands.get(name), rule.fk[1] if rule.fk else None
        at = name, rule, str(band)
        if parent in self.run.changes:          # other rows may be orphans now
            found = materialize(hit_keys(self.run.tables[name], rule, band, self.run.tables[parent]), "fires")
        else:
            with _SEARCH:       # branches that run at the same time search once
                if at not in self.fires:
                    self.fires[at] = materialize(
                        hit_keys(self.clean[name], rule, band, self.clean[parent] if parent else None), "fires")
                found = self.fires[at]
        return found.union(self._twins(name)) if several else found

    def _twins(self, name: str) -> DataFrame:
        """Keys of several rows of the clean table."""
        with _SEARCH:
            if name not in self.fires:
                self.fires[name] = materialize(several_keys(self.clean[name], self.lineage.rules[name].key), "twins")
            return self.fires[name]

    def act(self, name: str, policy: Mapping[str, str], routing: str, targets: DataFrame | None = None) -> bool:
        """Route the policy over the rows of the keys that fire; returns whether it suppresses."""
        rule, change, table = self.lineage.rules[name], self.run.changes.get(name), self.run.tables[name]
        parent = self.run.tables[rule.fk[1]] if rule.fk else None
        partial = not change or not change.whole and set(change.own) <= set(rule.key)
        if partial:
            own = change.own if change else rule.key
            keys = self._hit_keys(name, policy, routing, targets).select(*own)
            found = keys.union(change.keys) if change else keys
            small = materialize(within(table, found, own), name)
            keys = small.select(*own).union(change.keys) if change else small.select(*own)
        else:
            small = table
        band = self.bands.get(name)
        if routing == "live":
            state = route_live(small, rule, policy, band, parent, targets, True)
        elif routing == "snapshot":
            state = route_snapshot(small, rule, policy, band, parent, True)
        elif routing == "verdict":
            state, self.run.verdicts[name] = route_verdict(small, rule, policy, band)
        else:
            raise ValueError(f"unknown routing {routing}")
        self.run.fired[name], self.run.acted[name] = state.fired, state.acted
        if partial and (change or state.acted):
            # without an earlier change the rows found are the clean rows of their keys
            self.put(name, own, keys, state.df, None if change else small)
        elif state.acted:
            self.put_whole(name, state.df)
        return state.suppressed

    def rebuild(self, node: Node) -> None:
        """Build what the changed parents reach."""
        changed = {p: self.run.changes[p] for p in node.parents if p in self.run.changes}
        cuts = [node.cuts.get(p) for p in changed]
        if any(c is None for c in cuts) or any(c.whole for c in changed.values()) or len({c.own for c in cuts}) > 1:
            self.put_whole(node.name, node.build({**self.run.tables, **self._read(node)}))
            return
        own, keys, same = cuts[0].own, [], None
        below = {p: self.seen.get(p, c) for p, c in changed.items()}
        for cut, (p, change) in zip(cuts, below.items()):
            if cut.columns == change.own:
                keys.append(change.keys)
                same = p if len(changed) == 1 else None
            else:
                keys.append(change.values(cut.columns))
        keys = reduce(DataFrame.union, keys)
        tables = {**self.run.tables, **self._read(node)}
        reached = {t: cols for cut in cuts for t, cols in cut.tables.items()}

        def gone(keys: DataFrame) -> DataFrame | None:
            """The clean rows of the keys, of a table that is not stored from those of its parents."""
            if not any(p == node.name for _, p in self.lean):
                return None
            return node.build({**self.clean, **{t: within(self.clean[t], keys, cols) for t, cols in reached.items()}})

        def build(keys: DataFrame, added: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
            return node.build({**tables, **{
                t: added(below[t].added) if t == same else within(tables[t], keys, cols) for t, cols in reached.items()}})

        if same and self._unread(node, below[same], cuts[0]):
            # the whole change is there for who reads it, and is not computed for the tables below
            few = materialize(self._recounted(below[same]), "recounted")
            self.seen[node.name] = self._stored(
                node.name, own, few, build(few, lambda df: within(df, few, reached[same])), gone(few))
            change = self.run.changes[node.name] = Change(own, keys, build(keys))
            self.run.tables[node.name] = change.applied(self.clean[node.name])
            return
        self.put(node.name, own, keys, build(keys), gone(keys))


def delta_run(lineage: Lineage, clean: Tables, injections: Sequence[Injection], plan: Plan,
              bands: Mapping | None = None, *, with_errors: bool = True, scope: str = "cone",
              routing: str | None = None, oracle: bool = False, strict: bool = True,
              fires: dict | None = None) -> DeltaRun:
    """The tables of a branch, as ``lineage.protected_run`` gives them with counting, and their changes.

    A shape that fires nowhere leaves its table, and what is built from it alone, as it is. Branches over one
    snapshot may share ``fires``, a dictionary that is filled with the keys that fire on its tables.
    """
    branch = _Branch(lineage, clean, bands or {}, {} if fires is None else fires, {*plan, *(s.node for s in injections)})
    run, order = branch.run, lineage.names()
    specs = {}
    for s in injections if with_errors else ():
        specs.setdefault(s.node, []).append(s)
    loci = sorted({s.node for s in injections}, key=lambda n: order.index(n) if n in order else -1)
    if scope == "cone":
        routing = routing or "live"
        for name in loci:
            if name in specs:
                branch.inject(name, specs[name], strict, name in plan)
        for i, name in enumerate(loci):
            if name in plan:
                branch.act(name, plan[name], routing,
                           injections[0].targets if oracle and with_errors and i == 0 else None)
        for name in lineage.descendants(loci):
            node = lineage.node(name)
            if any(p in run.changes for p in node.parents):
                branch.rebuild(node)
            if name in plan:
                branch.act(name, plan[name], routing)
        return run
    if scope != "chain":
        raise ValueError(f"unknown scope {scope}")
    for name in loci:
        if name not in order and name in specs:
            branch.inject(name, specs[name], strict, name in plan)
    for node in lineage.nodes:
        if any(p in run.changes for p in node.parents):
            branch.rebuild(node)
        if node.name in specs:
            branch.inject(node.name, specs[node.name], strict, node.name in plan)
        if node.name in plan and branch.act(node.name, plan[node.name], routing or "snapshot"):
            run.suppressed_at = node.name
            break
    return run


def responses(lineage: Lineage, clean: Tables, families: Mapping[str, tuple], bands: Mapping, **options) -> DataFrame:
    """(family, node, shape, disposition, nrd): damage of every family of errors under every disposition
    that may answer it, relative to doing nothing.

    families: name -> (injections, node, shape, dispositions). Each branch is the policy of one entry; all
    share the sizes of the clean sinks.
    """
    sizes = materialize(sink_base(clean, lineage.sinks), "base")
    options = {"fires": {}, **options}

    def respond(branch: tuple) -> DataFrame:
        name, injections, node, shape, act = branch
        run = delta_run(lineage, clean, injections, {node: {shape: act}} if act else {}, bands, **options)
        row = sink_damage(clean, run.tables, lineage.sinks, changes=run.changes, base=sizes).agg(
            F.avg("damage").alias("damage")).select(
            F.lit(name).alias("family"), F.lit(node).alias("node"), F.lit(shape).alias("shape"),
            F.lit(act).cast("string").alias("disposition"), "damage")
        return materialize(row, "response")        # short plans

    branches = [(f, injections, node, shape, act) for f, (injections, node, shape, acts) in families.items()
                for act in (None, *acts)]
    with ThreadPoolExecutor(BRANCHES) as pool:
        rows = reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(sizes.sparkSession)(respond), branches))
    base = rows.filter("disposition is null").select("family", F.col("damage").alias("_base"))
    return rows.filter("disposition is not null").join(base, "family").select(
        "family", "node", "shape", "disposition", nrd("damage", "_base").alias("nrd"))


def measure(lineage: Lineage, clean: Tables, campaign: str, injections: Sequence[Injection],
            plans: Mapping[str, Plan], bands: Mapping, sizes: DataFrame | None = None, **options) -> DataFrame:
    """Measurement rows of one campaign: per plan the damage with errors, relative to doing
    nothing (``nrd``), and the damage the same plan does to clean data. ``sizes`` is the stored ``sink_base``."""
    options = {"fires": {}, **options}
    base = delta_run(lineage, clean, injections, {}, bands, **options)
    sinks = lineage.sinks
    sizes = materialize(sink_base(clean, sinks), "base") if sizes is None else sizes

    def mean(run: DeltaRun, label: str, role: str) -> DataFrame:
        per_sink = sink_damage(clean, run.tables, sinks, changes=run.changes, base=sizes)
        return per_sink.agg(F.avg("damage").alias("damage")).select(
            F.lit(label).alias("plan"), F.lit(role).alias("role"), "damage",
            F.lit(run.availability_loss).alias("availability_loss"))

    rows = mean(base, "no_validation", "base")
    for label, plan in plans.items():
        rows = rows.unionByName(mean(delta_run(
            lineage, clean, injections, plan, bands, **options), label, "dirty"))
        rows = rows.unionByName(mean(delta_run(
            lineage, clean, injections, plan, bands, with_errors=False, **options), label, "clean"))
    rows = materialize(rows, "measurements")            # every branch runs once, here
    wide = rows.groupBy("plan").agg(*[
        F.max(F.when(F.col("role") == r, F.col(c))).alias(a) for r, c, a in (
            ("dirty", "damage", "absolute_damage"), ("clean", "damage", "clean_absolute_damage"),
            ("dirty", "availability_loss", "availability_loss"),
            ("clean", "availability_loss", "clean_availability_loss"),
            ("base", "damage", "_base"))])
    nothing = rows.filter(F.col("role") == "base").select(
        F.col("damage").alias("no_validation_damage"), F.lit(1).alias("_one"))
    return wide.filter(F.col("_base").isNull()).drop("_base").withColumn("_one", F.lit(1)).join(
        nothing, "_one").select(
        F.lit(campaign).alias("campaign"), "plan", "no_validation_damage", "absolute_damage",
        nrd("absolute_damage", "no_validation_damage").alias("nrd"), "clean_absolute_damage",
        "availability_loss", "clean_availability_loss")


def placement_grid(lineage: Lineage, clean: Tables, campaign: str,
                   injections: Sequence[Injection], policies: Mapping[str, Mapping[str, str]],
                   placements: Sequence[str], bands: Mapping, **options) -> DataFrame:
    """Each policy placed alone at each table: one measurement row per combination."""
    plans = {f"{p}@{t}": {t: m} for p, m in policies.items() for t in placements}
    options = {"scope": "chain", "routing": "verdict", **options}
    rows = measure(lineage, clean, campaign, injections, plans, bands, **options)
    return rows.select("campaign", F.substring_index("plan", "@", 1).alias("policy"),
                       F.substring_index("plan", "@", -1).alias("placement"),
                       *[c for c in rows.columns if c not in ("campaign", "plan")])
