"""Manifests against a tree written out; proofs; odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from loomstead.llm import merkle

KIND = "doc_id long, source string, lang string, n_chars long, text string, g string, n int, hash string, place int"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, text):
    shown = ["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*row[:4], text)]
    return sha("".join(shown))


def up(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
    return levels


def path_of(levels, i, fan):
    out = []
    for nodes in levels[:-1]:
        a = i - i % fan
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + fan])))
        i //= fan
    return out


def plain(rows, fan):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, held = [], []
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is None, r[0] or 0, leaf(r, r[4])))
        held.append(mine)
        trees.append(up([leaf(r, r[4]) for r in mine], fan))
    top = up([t[-1][0] for t in trees], fan)
    out = []
    for k, (mine, tree) in enumerate(zip(held, trees, strict=True)):
        for i, r in enumerate(mine):
            path = path_of(tree, i, fan) + path_of(top, k, fan)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            h = leaf(r, r[4].translate(lower) if bad and r[4] is not None else r[4])
            for a, b in path:
                h = sha(a + h + b)
            out.append((str(r[0]), tree[0][i], tree[-1][0], top[-1][0], sha("".join(a + b for a, b in path)), h, h == top[-1][0]))
    return sorted(out)


def told(df, fan):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.audited(df, merkle.lowered_in_a_fifth(), fan).collect())


ROWS = [(i, "hot" if i % 3 else f"s{i % 11}", "en", i, f"Text {i} Ää " * (i % 3)) for i in range(90)]
ODD = [
    (None, None, None, None, None), (None, "hot", "en", 1, "A"), (3, None, "en", 1, ""), (3, None, "en", 1, ""), (3, None, "en", 1, None), (-4, "", "x", 0, "-"),
    (-4, "", "x", 0, "A" * 50000), (7, "é", None, -1, "z"), (7, "é", None, -1, "z"), (8, "Z", None, 1, "1:a"),
]


@pytest.mark.parametrize(("rows", "fan"), [(ROWS + ODD, 3), (ROWS + ODD, 16), (ROWS[:1], 2), (ODD[:1] * 5, 2)])
def test_tree_and_proofs(spark, rows, fan):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], KIND).repartition(5)
    assert told(df, fan) == plain(rows, fan)


def test_a_change_shows(spark):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in ROWS], KIND)
    shown = {r.doc_id: r.verified for r in merkle.audited(df, F.when(F.col("doc_id") == 8, "other").otherwise(F.col("text")), 4).collect()}
    assert [i for i, ok in shown.items() if not ok] == [8]
    assert told(df.limit(0), 16) == []
    tree = merkle.build(df, 4)
    assert [x.count() for x in tree.top] == [12, 3, 1] and tree.root.first()[0] == plain(ROWS, 4)[0][3]
