"""The n-gram Jaccard join against sets written out with regular expressions."""

import random
import re

import numpy as np
import pytest

from loomstead.llm import jaccard_join
from loomstead.llm.common import shingle_set
from loomstead.llm.jaccard_join import front, jaccard_groups, prefix_size

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def plain_set(text, k):
    """The contract's set, word for word."""
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not ws:
        return set()
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} or {tuple(ws)}


def components(sets, percent):
    label = {i: i for i in sets}
    ids = [i for i in sets if sets[i]]
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return label


def near_copies(rng, n):
    out = []
    while len(out) < n:
        base = words(rng, rng.choice([1, 2, 4, 9, 12, 40, 150]), rng.choice([3, 50, 400])).split()
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 15)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(400)}"
            out.append(" ".join(copy))
    return out[:n]


def odd_words():
    """Case beyond A-Z, white space beyond ASCII, control characters and repeated texts."""
    base = ["Aa b\x0bc\u00a0d \x1ce\n\nA\u0130 aa \u00c4 f g", "aA B\tc\u00a0d \x1cE a\u0130 AA \u00c4 f G", "Aa b c\u00a0d \x1ce a\u0130 aa \u00e4 f g", "\u2003", "\x00 \x00 \x00", "\x00 \x00", "", None]
    return base + base[:3]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 60), (2, 100)])
def test_linked_sets_share_a_shingle_of_their_prefixes(k, percent):
    rng = random.Random(k)
    sets = [shingle_set(t, k) for t in near_copies(rng, 150)]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            both = len(np.intersect1d(a, b))
            if len(a) and 100 * both >= percent * (len(a) + len(b) - both):
                first, second = (front(s, percent)[0][: prefix_size(len(s), percent)] for s in (a, b))
                assert len(first) == prefix_size(len(a), percent) and np.isin(first, second).any()


@pytest.mark.parametrize(("k", "percent", "sets_in_block"), [(3, 90, 512), (5, 80, 512), (5, 80, 4), (1, 60, 3)])
def test_jaccard_groups_equal_brute_force(spark, monkeypatch, k, percent, sets_in_block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", sets_in_block)
    texts = near_copies(random.Random(40 + k), 160) + odd_words()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(df, k, percent).collect()}
    sets = {i: plain_set(t, k) for i, t in enumerate(texts)}
    label = components(sets, percent)
    assert got == {i: (len(sets[i]), label[i]) for i in sets}


def test_a_chain_of_copies_longer_than_a_block(spark, monkeypatch):
    """Each text links with its neighbours only; a few lie between two chains."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 5)
    rng = random.Random(3)
    text = [f"v{i}" for i in range(60)]
    texts = []
    for i in range(60):
        text[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(text))
    texts += [" ".join(f"u{(i * 7 + j) % 90}" for j in range(60)) for i in range(30)]
    sets = {i: plain_set(t, 1) for i, t in enumerate(texts)}
    got = {r.doc_id: r.component_id for r in jaccard_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1, 90).collect()}
    assert got == components(sets, 90) and len(set(got.values())) > 1
