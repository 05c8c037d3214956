"""Sketches against sets written out, exact merging, and ids that many rows share."""

import random
import re

import numpy as np
import pytest

from loomstead.llm import sketches
from loomstead.llm.common import word_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def shingles(text, k=sketches.WORDS):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return ({tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} or {tuple(ws)}) if ws else set()


def test_sketches_hold_the_same_share_of_equal_shingles():
    """Texts with the same shingles have the same sketch; estimates are those of the shingles themselves."""
    rng = random.Random(12)
    for _ in range(40):
        a = words(rng, 6000, 10**6)
        b = " ".join(a.split()[: rng.randrange(500, 6000)]) + " " + words(rng, rng.randrange(0, 6000), 10**6)
        x, y = shingles(a), shingles(b)
        s, t = sketches.sketch(a), sketches.sketch(b.upper().replace(" ", "\t\n"))
        assert abs(len(s) / len(x) - 1 / sketches.SCALE) < 0.03 and abs(len(t) / len(y) - 1 / sketches.SCALE) < 0.03
        assert abs(sketches.likeness(s, t) - len(x & y) / len(x | y)) < 0.06
        assert abs(sketches.containment(s, t) - len(x & y) / len(x)) < 0.06
    assert len(set(word_hashes("\u00c4 \u00e4 a\u00a0b A\u00a0B").tolist())) == 3  # only A-Z are lower-cased, only ASCII white space parts


@pytest.mark.parametrize("n", [1, 2, 3, 8, 60])
def test_merging_is_exact(n):
    rng = random.Random(n)
    for _ in range(50):
        parts = [np.unique(np.array([rng.getrandbits(64) for _ in range(rng.randrange(0, n))], np.uint64)) for _ in range(3)]
        each = [sketches._kept(p, sketches.SCALE) for p in parts]
        whole = sketches._kept(np.unique(np.concatenate(parts)), sketches.SCALE)
        assert np.array_equal(sketches.merge_sketches(*each), whole)
        assert np.array_equal(sketches.merge_sketches(sketches.merge_sketches(*each[:2]), each[2]), whole)


def test_rows_of_one_id_lie_in_several_ranges(spark):
    """Half of the rows have no id: they are dealt out by text, and each is still followed by its neighbour."""
    rng = random.Random(2)
    rows = [(i if i % 2 else None, words(rng, 12)) for i in range(200)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, part int, head string").repartition(5)
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1]))
    want = []
    for i, (doc_id, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        cut = len(text) // 3
        want.append((str(doc_id), sketches.encode_sketch(sketches.sketch(text)), sketches.encode_sketch(sketches.sketch(text[: len(text) - cut] + following[:cut]))))
    got = sketches.neighbour_fingerprints(df)
    assert sorted((str(r.doc_id), r.fingerprint, r.edited_fingerprint) for r in got.collect()) == sorted(want)
    keys = df.selectExpr("coalesce(doc_id, -9223372036854775808) k", "substring(text, 1, 64) head")
    bounds = sketches._bounds(keys, 8)
    assert len(bounds) == 7 and sum(b[0] == (1 << 63) - 1 for b in bounds) >= 3
