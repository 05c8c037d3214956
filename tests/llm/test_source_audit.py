"""Audits against a dense table of all terms of all groups, in Python's integers."""

import random
import re
from collections import Counter

from loomstead.llm import source_audit as audit


def plain(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower)) for _, _, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [(r[1], ws) for r, ws in zip(rows, terms, strict=True) if r[0] == lang]
        held = Counter(w for _, ws in mine for w in set(ws))
        kept = {w for w, n in held.items() if n >= least}
        counts = {s: Counter(w for g, ws in mine if g == s for w in ws if w in kept) for s, _ in mine}
        whole = sum(counts.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        f = lambda p, q: (p - q) * (p - q) // q
        for s, c in counts.items():
            pairs = [(o, sum(f(p(c, w), p(other, w)) for w in kept)) for o, other in counts.items() if o != s]
            own = [(w, f(p(c, w), p(whole, w))) for w in kept if c[w] and p(c, w) > p(whole, w)]
            for part, values, most in (("pair", pairs, None), ("term", own, top)):
                order = sorted(values, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(order, 1)]
    return sorted(out)


def told(spark, rows, least=3, top=200):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, source string, text string, n int, term string, c long").repartition(3)
    return sorted(tuple(r) for r in audit.audit_sources(df, least, top).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(n=150):
    rng = random.Random(4)
    words = ["the", "The", "of", "café", "naïve", "你好", "x", "rock", "jazz", "data", "lake", "zed"]
    rows = []
    for i in range(n):
        lang, source = rng.choice("ab"), "hot" if i % 3 == 0 else f"s{rng.randrange(5)}"
        bag = words[: 4 + rng.randrange(8)] + [f"only{source}"] * 2
        rows.append((lang, source, " ".join(rng.choice(bag) for _ in range(rng.randrange(0, 30)))))
    return rows


def test_values_are_those_of_the_dense_table(spark):
    rows = corpus()
    want = plain(rows, 3, 200)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[4] > 10**6 for r in want)
    assert told(spark, rows) == want


def test_odd_rows(spark):
    rows = corpus(40) + [(None, None, None), (None, "s1", "a-b_c 1d2 K K"), ("", "", "a b c"), ("a", None, "a a a"), ("c", "one", "few"), ("c", "two", None), ("d", "x", "same same"), ("d", "x", "same"), ("d", "x", "same")]
    rows += [("d", "y", "1 2 3"), ("d", "x", "same " * 50000)]
    assert told(spark, rows, 3, 2) == plain(rows, 3, 2)


def test_counts_do_not_depend_on_what_a_task_holds(spark, monkeypatch):
    rows = corpus(60)
    monkeypatch.setattr(audit, "HELD", 3)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2].encode() for r in rows])], names=["lang", "source", "raw"])
    parts = list(audit._counted([batch]))
    assert len(parts) > 5
    total = Counter()
    for x in parts:
        for lang, source, term, c, docs in zip(*(col.to_pylist() for col in x.columns), strict=True):
            total[lang, source, term] += c * 1000 + docs
    monkeypatch.undo()
    whole = next(iter(audit._counted([batch])))
    assert total == {(a, b, t): c * 1000 + d for a, b, t, c, d in zip(*(col.to_pylist() for col in whole.columns), strict=True)}


def test_empty_table(spark):
    assert told(spark, []) == []
