"""All registered queries with their oracle SQL."""

from __future__ import annotations

from dqspark.queries import branches, campaigns, errors, models, raw, responses, snapshots, wire

MODULES = (models, errors, branches, campaigns, snapshots, responses, wire, raw)


def queries() -> dict:
    out = {}
    for m in MODULES:
        clash = out.keys() & m.QUERIES.keys()
        assert not clash, clash
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for m in MODULES:
        out.update(m.ORACLES)
    return out
