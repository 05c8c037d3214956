"""Line diffs as hunks: a shortest edit script over numbered lines, and its application in built-in functions."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no installed copy of it

HUNKS = "array<struct<old_start: int, removed: array<string>, new_start: int, added: array<string>>>"
_NONE = -(1 << 60)


def _reach(v: np.ndarray, at: int, d: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonals, furthest places in a) with d edits; v holds those with d - 1 by diagonal, from index `at` on, and is brought up to date."""
    n, m = len(a), len(b)
    low, high = max(-d, -m + (d + m) % 2), min(d, n - (d + n) % 2)
    k = np.arange(low, high + 1, 2)
    x = np.zeros(1, np.int64) if d == 0 else np.maximum(v[at + k + 1], v[at + k - 1] + 1)
    x = np.where((x < 0) | (x > n) | (x - k > m), _NONE, x)
    live = np.flatnonzero((x >= 0) & (x < n) & (x - k < m))
    while len(live):
        live = live[a[x[live]] == b[x[live] - k[live]]]
        x[live] += 1
        live = live[(x[live] < n) & (x[live] - k[live] < m)]
    v[at + k] = x
    return k, x


def _middle(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """A place (in a, in b) on a shortest way that has half of its edits before it."""
    n, m = len(a), len(b)
    delta, at = n - m, n + m + 2
    ahead, back = (np.full(2 * at + 1, _NONE, np.int64) for _ in range(2))
    backwards = a[::-1], b[::-1]
    for d in range((n + m + 1) // 2 + 1):
        k, x = _reach(ahead, at, d, a, b)
        if delta % 2:
            met = np.flatnonzero((abs(delta - k) < d) & (x >= 0) & (x + back[at + delta - k] >= n))
            if len(met):
                return int(x[met[0]]), int(x[met[0]] - k[met[0]])
        k, x = _reach(back, at, d, *backwards)
        if not delta % 2:
            met = np.flatnonzero((abs(delta - k) <= d) & (x >= 0) & (x + ahead[at + delta - k] >= n))
            if len(met):
                return int(n - x[met[0]]), int(m - (x[met[0]] - k[met[0]]))
    raise AssertionError("two ways of half the edits each must meet")


def edits(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(removed, added): which places of a and b a shortest edit script removes and adds.

    Divide and conquer: room grows with the lines, time with the lines and
    with the square of the edits, whose steps are vectors.
    """
    removed, added = np.zeros(len(a), bool), np.zeros(len(b), bool)
    parts = [(0, len(a), 0, len(b))]
    while parts:
        a0, a1, b0, b1 = parts.pop()
        n = min(a1 - a0, b1 - b0)
        same = a[a0 : a0 + n] == b[b0 : b0 + n]
        head = n if same.all() else int(same.argmin())
        a0, b0, n = a0 + head, b0 + head, n - head
        same = a[a1 - n : a1][::-1] == b[b1 - n : b1][::-1]
        tail = n if same.all() else int(same.argmin())
        a1, b1 = a1 - tail, b1 - tail
        if a0 == a1 or b0 == b1:
            removed[a0:a1], added[b0:b1] = True, True
        else:
            x, y = _middle(a[a0:a1], b[b0:b1])
            parts += [(a0, a0 + x, b0, b0 + y), (a0 + x, a1, b0 + y, b1)]
    return removed, added


def hunks(old: str, new: str) -> list[dict]:
    """Hunks in order: lines from 1 on that are removed from old, and what is added in their place in new."""
    x, y = old.split("\n"), new.split("\n")
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(line, len(number)) for line in lines], np.int64) for lines in (x, y))
    removed, added = edits(a, b)
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        i1, j1 = i, j
        while i1 < len(x) and removed[i1]:
            i1 += 1
        while j1 < len(y) and added[j1]:
            j1 += 1
        if i1 > i or j1 > j:
            out.append({"old_start": i + 1, "removed": x[i:i1], "new_start": j + 1, "added": y[j:j1]})
        i, j = i1 + 1, j1 + 1
    return out


def line_hunks(old: Column, new: Column) -> Column:
    """The hunks of a shortest edit script from old to new, empty for equal texts; null texts are empty (one empty line)."""

    @F.pandas_udf(HUNKS)
    def run(o: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([hunks(a or "", b or "") for a, b in zip(o, n, strict=True)], dtype=object)

    return run(old, new)


def patched(old: Column, told: Column) -> Column:
    """old with hunks applied, in built-in functions; null texts are empty."""
    lines = F.split(F.coalesce(old, F.lit("")), "\n", -1)
    state = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda s, h: F.struct(
        (h["old_start"] + F.size(h["removed"])).alias("at"),
        F.concat(s["out"], F.slice(lines, s["at"], h["old_start"] - s["at"]), h["added"]).alias("out"),
    )
    done = F.aggregate(told, state, step)
    return F.array_join(F.concat(done["out"], F.slice(lines, done["at"], F.size(lines))), "\n")


def unified(told: Column) -> Column:
    """Hunks as the lines of a unified diff without context."""
    span = lambda start, n: F.concat(F.when(n == 0, start - 1).otherwise(start).cast("string"), F.when(n == 1, "").otherwise(F.concat(F.lit(","), n.cast("string"))))
    head = lambda h: F.concat(F.lit("@@ -"), span(h["old_start"], F.size(h["removed"])), F.lit(" +"), span(h["new_start"], F.size(h["added"])), F.lit(" @@"))
    shown = F.transform(told, lambda h: F.concat(F.array(head(h)), F.transform(h["removed"], lambda x: F.concat(F.lit("-"), x)), F.transform(h["added"], lambda x: F.concat(F.lit("+"), x))))
    return F.array_join(F.flatten(shown), "\n")
