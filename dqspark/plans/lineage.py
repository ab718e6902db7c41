"""A table lineage as a dictionary of DataFrame builders, and protected runs over it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from dqspark.functions.skew import within
from dqspark.operators.dispositions import route_live, route_snapshot, route_verdict
from dqspark.operators.injection import Injection, inject, require_hits
from dqspark.operators.signals import Rule, several_keys
from dqspark.session import materialize

Tables = Mapping[str, DataFrame]
Plan = Mapping[str, Mapping[str, str]]     # table -> {shape or verdict: disposition}


@dataclass(frozen=True)
class Cut:
    """How a changed parent reaches a node: values of the parent's ``columns`` are those of the node's
    columns ``own``, and the node's rows of some values follow from the rows of these values of
    ``tables`` (parent: columns by place), with all other parents whole. ``fills`` names the columns that
    a left lookup in the parent gives: nothing else in the node depends on it but the number of rows."""

    columns: tuple[str, ...]
    own: tuple[str, ...]
    tables: Mapping[str, tuple[str, ...]]
    fills: tuple[str, ...] = ()


def cut(columns: str, *tables: str, fills: tuple[str, ...] = (), **renamed: str) -> Cut:
    """A cut by ``columns`` (separated by spaces) that hold the same values in the node and in
    ``tables``; ``renamed`` gives the columns of parents that name them otherwise."""
    own = tuple(columns.split())
    given = {t: own for t in tables} | {t: tuple(c.split()) for t, c in renamed.items()}
    return Cut(next(iter(given.values())), own, given, fills)


@dataclass(frozen=True)
class Node:
    """A table, and which columns of its parents it does not read (``ignores``)."""

    name: str
    parents: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    cuts: Mapping[str, Cut] = field(default_factory=dict)
    ignores: Mapping[str, tuple[str, ...]] = field(default_factory=dict)


@dataclass(frozen=True)
class Sink:
    key: tuple[str, ...]
    kind: str                              # aggregate or row_preserving
    values: tuple[str, ...]


class Snapshot(dict):
    """Stored tables. ``lean`` holds, by (node, parent), a parent that is not stored as the node reads it:
    with the rows and columns of the parent, where ignored columns may hold anything."""

    def __init__(self, tables: Tables):
        super().__init__(tables)
        self.lean: dict[tuple[str, str], DataFrame] = {}


@dataclass(frozen=True)
class Lineage:
    """Nodes in topological order, the rules deployed at them, and the scored sinks."""

    nodes: tuple[Node, ...]
    rules: Mapping[str, Rule]
    sinks: Mapping[str, Sink]

    def node(self, name: str) -> Node:
        return next(n for n in self.nodes if n.name == name)

    def names(self) -> list[str]:
        return [n.name for n in self.nodes]

    def ancestors(self, names: Sequence[str]) -> set[str]:
        """``names`` and every table they are built from."""
        need = set(names)
        for n in reversed(self.nodes):
            if n.name in need:
                need.update(n.parents)
        return need

    def build(self, sources: Tables, wanted: Sequence[str] | None = None) -> dict[str, DataFrame]:
        """The wanted tables (all by default) as composed plans over the sources."""
        need = self.ancestors(wanted if wanted is not None else self.names())
        tables = dict(sources)
        for n in self.nodes:
            if n.name in need:
                tables[n.name] = n.build(tables)
        return tables

    def store(self, tables: Tables, names: Sequence[str] | None = None,
              files: int | None = None) -> Snapshot:
        """Write the named tables (default all) and return the tables reading them back; tables
        above are built from the written ones.

        A lookup of which a table above reads no column decides only how often its rows stand there, so
        for that table it meets the rows of keys that occur several times, not the whole lookup.
        """
        names = set(self.names() if names is None else names)
        out = Snapshot({t: df for t, df in tables.items() if t not in self.names()})
        twins: dict[tuple, DataFrame] = {}
        for n in self.nodes:
            if n.name in tables:
                for p in set(n.parents) - names:
                    few = self._few(n, p, out, twins)
                    if few:
                        out.lean[n.name, p] = self.node(p).build({**out, **few})
                out[n.name] = n.build({**out, **{p: df for (m, p), df in out.lean.items() if m == n.name}})
                if n.name in names:
                    out[n.name] = materialize(out[n.name], n.name, files)
        return out

    def _few(self, node: Node, parent: str, tables: Tables, twins: dict[tuple, DataFrame]) -> dict[str, DataFrame]:
        """What may stand for the lookups of a parent whose columns a node ignores."""
        cuts = self.node(parent).cuts if parent in self.names() else {}
        ignored = set(node.ignores.get(parent, ()))
        out = {q: c for q, c in cuts.items() if c.fills and ignored.issuperset(c.fills)}
        for q, c in out.items():
            if (q, c.columns) not in twins:
                keys = materialize(several_keys(tables[q], c.columns), "twins")
                twins[q, c.columns] = materialize(within(tables[q], keys, c.columns), "twins")
        return {q: twins[q, c.columns] for q, c in out.items()}

    def descendants(self, names: Sequence[str]) -> list[str]:
        """Tables below ``names`` in topological order."""
        reached = set(names)
        out = []
        for n in self.nodes:
            if n.name not in reached and reached.intersection(n.parents):
                reached.add(n.name)
                out.append(n.name)
        return out


@dataclass
class Run:
    """Tables of one branch, with what fired and what was done at each planned table."""

    tables: dict[str, DataFrame]
    fired: dict[str, dict[str, int]] = field(default_factory=dict)
    acted: dict[str, dict[str, str]] = field(default_factory=dict)
    verdicts: dict[str, str] = field(default_factory=dict)
    suppressed_at: str | None = None

    @property
    def availability_loss(self) -> float:
        return 0.0 if self.suppressed_at is None else 1.0


def _act(lineage: Lineage, run: Run, name: str, policy: Mapping[str, str], bands: Mapping,
         routing: str, targets: DataFrame | None, count: bool) -> bool:
    rule, df = lineage.rules[name], run.tables[name]
    parent = run.tables[rule.fk[1]] if rule.fk else None
    band = bands.get(name)
    if routing == "live":
        state = route_live(df, rule, policy, band, parent, targets, count)
    elif routing == "snapshot":
        state = route_snapshot(df, rule, policy, band, parent, count)
    elif routing == "verdict":
        state, run.verdicts[name] = route_verdict(df, rule, policy, band)
    else:
        raise ValueError(f"unknown routing {routing}")
    run.tables[name] = state.df
    run.fired[name], run.acted[name] = state.fired, state.acted
    return state.suppressed


def protected_run(lineage: Lineage, clean: Tables, injections: Sequence[Injection], plan: Plan,
                  bands: Mapping | None = None, *, with_errors: bool = True, scope: str = "cone",
                  routing: str | None = None, oracle: bool = False, strict: bool = True,
                  count: bool = True,
                  keep: Callable[[DataFrame, str], DataFrame] | None = None) -> Run:
    """Inject, act where planned, rebuild what lies below; return the tables of the branch.

    scope ``cone``: the policy acts at the injected tables and at rebuilt tables below them; a
    planned table outside that cone is never touched, with or without errors. scope ``chain``:
    every planned table acts in topological order, and ``fail_closed`` leaves all later tables at
    their clean (stale) state. With ``count`` a shape that fires nowhere leaves the table, and what
    is built from it alone, untouched. Unchanged tables reuse the clean plan. ``keep`` (for example
    ``session.materialize``) is applied to each changed table that others are built from.
    ``delta.delta_run`` gives the same tables and builds only what changes.
    """
    bands = bands or {}
    run = Run(dict(clean))
    order = lineage.names()
    feeds = {p for n in lineage.nodes for p in n.parents}

    def settle(name: str) -> None:
        if keep is not None and name in feeds:
            run.tables[name] = keep(run.tables[name], name)

    def put_errors(name: str) -> None:
        for spec in injections:
            if spec.node == name and with_errors:
                if strict:
                    require_hits(run.tables[name], spec)
                run.tables[name] = inject(run.tables[name], spec)

    loci = sorted({s.node for s in injections},
                  key=lambda n: order.index(n) if n in order else -1)
    if scope == "cone":
        routing = routing or "live"
        for name in loci:
            put_errors(name)
        for i, name in enumerate(loci):
            if name in plan:
                targets = injections[0].targets if oracle and with_errors and i == 0 else None
                _act(lineage, run, name, plan[name], bands, routing, targets, count)
            settle(name)
        for name in lineage.descendants(loci):
            node = lineage.node(name)
            if any(run.tables[p] is not clean[p] for p in node.parents):
                run.tables[name] = node.build(run.tables)
            if name in plan:
                _act(lineage, run, name, plan[name], bands, routing, None, count)
            if run.tables[name] is not clean[name]:
                settle(name)
        return run
    if scope != "chain":
        raise ValueError(f"unknown scope {scope}")
    routing = routing or "snapshot"
    changed = set()
    for name in loci:
        if name not in order:              # a source table
            put_errors(name)
            changed.add(name)
    for n in lineage.nodes:
        if changed.intersection(n.parents):
            run.tables[n.name] = n.build(run.tables)
            changed.add(n.name)
        if n.name in loci:
            put_errors(n.name)
            changed.add(n.name)
        if n.name in plan:
            changed.add(n.name)
            if _act(lineage, run, n.name, plan[n.name], bands, routing, None, count):
                run.suppressed_at = n.name
                break
        if run.tables[n.name] is clean[n.name]:
            changed.discard(n.name)        # nothing fired on a clean table
        elif n.name in changed:
            settle(n.name)
    return run
