"""Findings of round 4: rounds and rows that a query makes on its way."""

import random

import pytest

from loomstead.operators import reports
from loomstead.plans import staging


def plain_colours(rows):
    deps, used, out = {}, {}, {}
    for item, dep in rows:
        deps.setdefault(item, set()).add(dep)
    for item in sorted(deps):
        out[item] = next(c for c in range(len(deps)) if not any(c in used.get(d, ()) for d in deps[item]))
        for d in deps[item]:
            used.setdefault(d, set()).add(out[item])
    return out


@pytest.mark.parametrize("run", [2, 48])
def test_colouring_needs_no_more_rounds_than_shuffle_partitions(spark, monkeypatch, run):
    """One dependency of a third of all items, others of few; each range of items follows the one before."""
    rounds, write = [], staging.staged
    monkeypatch.setattr(staging, "staged", lambda df, name: (rounds.append(name) if name == "tokens" else None, write(df, name))[1])
    rng = random.Random(run)
    rows = [(i, rng.randrange(40)) for i in range(300) for _ in range(3)] + [(i, 99) for i in range(0, 300, 3)]
    got = reports.frontier_colours(spark.createDataFrame(rows, "item long, dep long"), block=20, run=run).collect()
    assert len(got) == 300 and {r.item: r.colour for r in got} == plain_colours(rows)
    assert len(rounds) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
