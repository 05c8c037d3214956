"""Cut repeats against windows written out, on texts made of shared passages, and odd rows."""

import random

import numpy as np
import pytest

from loomstead.llm import substring_dedup as sd
from loomstead.llm.common import word_spans


def plain(rows, least):
    """(id, words, removed, kept) by comparing every window with every other."""
    texts = [(i if i is not None else 1 << 63, (t or "").encode().split()) for i, t in rows]
    first = {}
    for o, ws in texts:
        for k in range(len(ws) - least + 1):
            w = tuple(ws[k : k + least])
            first[w] = min(first.get(w, o), o)
    out = []
    for (doc_id, _), (o, ws) in zip(rows, texts, strict=True):
        gone = set()
        for k in range(len(ws) - least + 1):
            if first[tuple(ws[k : k + least])] < o:
                gone.update(range(k, k + least))
        out.append((str(doc_id), len(ws), len(gone), b" ".join(w for j, w in enumerate(ws) if j not in gone).decode()))
    return sorted(out)


def got(spark, rows, least, gram):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, d long, raw string, start int").repartition(3)
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in sd.cut_repeats(df, least, gram).collect())


def corpus(seed, n, vocabulary):
    """Documents of own words and passages of a shared pool, some cut short, some changed in one word, some repeated within."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    pool = [[word() for _ in range(rng.randrange(5, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        ws = []
        for _ in range(rng.randrange(0, 6)):
            ws += [word() for _ in range(rng.randrange(0, 9))]
            p = list(rng.choice(pool))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = word()
            a = rng.randrange(0, 4)
            ws += p[a : len(p) - rng.randrange(0, 3)]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(ws)))
    return rows


@pytest.mark.parametrize(("least", "gram"), [(10, 4), (10, 10), (12, 1)])
def test_cuts_are_those_of_all_windows(spark, least, gram):
    rows = corpus(least, 60, 30) + [(100, "a b " * 40), (101, "b a " * 30), (102, "a b " * 40), (5, "x " + corpus(least, 60, 30)[7][1]), (None, corpus(least, 60, 30)[3][1]), (None, None), (103, ""), (103, "   ")]
    want = plain(rows, least)
    assert sum(r[2] for r in want) > 200
    assert got(spark, rows, least, gram) == want


def test_one_passage_with_many_neighbours(spark):
    """A passage that all rows share, each in words of its own and of another length, some of them copies."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([f"l{i % 40}x{j}" for j in range(12)] + passage[i % 5 : 30 - i % 7] + [f"r{rng.randrange(60)}" for _ in range(12)])) for i in range(150)]
    assert got(spark, rows, 20, 8) == plain(rows, 20)


def test_rows_of_one_id_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    assert got(spark, [(1, text), (1, text), (1, "a " + text), (0, None)], 10, 4) == plain([(1, text), (1, text), (1, "a " + text), (0, None)], 10)
    rows = [(2, text), (1, text), (2, text), (2, text + " z")]
    assert got(spark, rows, 10, 4) == plain(rows, 10)


def test_every_window_has_one_anchor():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 3, 400).astype(np.uint64)
    anchor, context, place, start, runs = sd.anchors(words, 12, 4)
    assert start[0] == 0 and np.array_equal(start[1:], (start + runs)[:-1]) and start[-1] + runs[-1] == 400 - 12 + 1
    assert ((place >= start) & (place + 4 <= start + 12)).all() and (runs <= 9).all()
    assert len(sd.anchors(words[:11], 12, 4)[0]) == 0


def test_repeats_are_maximal_and_words_keep_their_case(spark):
    text = " ".join(f"W{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (2, "x " + text + " y " + text), (3, text.lower()), (4, " ".join(text.split()))], "doc_id long, text string")
    told = {r.doc_id: r for r in sd.cut_repeats(df, 10, 4).collect()}
    assert [(x.first, x.last) for x in told[2].repeats] == [(1, 30), (32, 61)] and told[2].text == "x y"
    assert told[1].repeats == told[3].repeats == told[4].repeats == [] and told[4].n_words == 1
    assert len(word_spans(b"a\x0bb\xc2\xa0c")[0]) == 2


def test_empty_table_and_bad_lengths(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sd.cut_repeats(df).count() == 0
    with pytest.raises(ValueError):
        sd.cut_repeats(df, 100, 20)
