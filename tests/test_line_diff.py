"""Edit scripts against the longest common subsequence, and hunks applied again."""

import random

import numpy as np
import pytest

from loomstead.functions import line_diff as ld


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = row
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(row[j], above[j + 1]))
    return row[-1]


@pytest.mark.parametrize("seed", range(4))
def test_scripts_are_shortest(seed):
    rng = random.Random(seed)
    for _ in range(250):
        a, b = (np.array([rng.randrange(1 + seed * 2) for _ in range(rng.randrange(0, 25))], np.int64) for _ in range(2))
        removed, added = ld.edits(a, b)
        assert a[~removed].tolist() == b[~added].tolist() and len(a) - removed.sum() == common(a.tolist(), b.tolist())


def test_long_texts():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 5000, 20_000)
    b = np.concatenate((a[:4000], rng.integers(6000, 7000, 300), a[4500:12_000], a[12_100:], a[:50]))
    removed, added = ld.edits(a, b)
    assert a[~removed].tolist() == b[~added].tolist() and removed.sum() + added.sum() <= 500 + 300 + 100 + 50


def test_hunks_give_the_new_text_back(spark):
    rng = random.Random(9)
    line = lambda: rng.choice(["a", "b", "", "c d", "\\|", "é"])
    rows = [("\n".join(line() for _ in range(rng.randrange(0, 12))), "\n".join(line() for _ in range(rng.randrange(0, 12)))) for _ in range(150)]
    rows += [(None, "a\nb"), ("a", None), (None, None), ("", "\n"), ("same\n", "same\n"), ("x\n" * 3000, "x\n" * 2900 + "y")]
    told = spark.createDataFrame(rows, "o string, n string").withColumn("h", ld.line_hunks("o", "n"))
    for r in told.select("o", "n", ld.patched(told.o, told.h).alias("p"), ld.unified(told.h).alias("u"), "h").collect():
        assert r.p == (r.n or "") and (len(r.h) == 0) == ((r.o or "") == (r.n or ""))
    one = told.where("o = 'a' and n is null").select(ld.unified(told.h)).first()[0]
    assert one == "@@ -1 +1 @@\n-a\n+"
    assert ld.hunks("a\nb\nc", "a\nx\nc\nd") == [{"old_start": 2, "removed": ["b"], "new_start": 2, "added": ["x"]}, {"old_start": 4, "removed": [], "new_start": 4, "added": ["d"]}]
