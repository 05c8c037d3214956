"""The license scan against plain loops over every block, and its filters one by one."""

import random
import re

from pyspark.sql import functions as F

from loomstead.llm import license_scan
from loomstead.llm.license_scan import PHRASES, TEMPLATES, candidates, needed, scan, template_prefixes, width

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def sequence(text):
    return re.findall(WORD, (text or "").translate(LOWER))


def paragraphs(text):
    out = [[]]
    for line in (text or "").split("\n"):
        if sequence(line):
            out[-1] += sequence(line)
        else:
            out.append([])
    return out


def plain(text, percent=80):
    ws = sequence(text)
    hits = sorted((i, k) for k, p in PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())
    found = {}
    for label, t in TEMPLATES.items():
        members, wide = set(sequence(t)), width(t, percent)
        most = max(len(members & set(part[i : i + wide])) for part in paragraphs(text) for i in range(max(1, len(part))))
        if 100 * most >= percent * len(members):
            found[label] = most / len(members)
    base = {k for _, k in hits}
    score = 1.0 if base else max(found.values(), default=0.0)
    return len(ws), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted(base)), ",".join(sorted(base | set(found))), round(score, 9)


def corpus():
    rng = random.Random(21)
    common = [w for t in TEMPLATES.values() for w in sequence(t)]
    texts = [None, "", " \n\n ", "K KK İÄé worK", "CC-BY; cc\nby general PUBLIC license, all-rights__reserved", "released license under mit", "released\n \nunder the mit license"]
    for _ in range(120):
        out = []
        for _ in range(rng.randrange(1, 5)):
            ws = sequence(rng.choice(list(TEMPLATES.values())))
            for _ in range(rng.randrange(0, 1 + len(ws) // 3)):
                ws[rng.randrange(len(ws))] = rng.choice([*common, "x", "y", ""])
            if rng.random() < 0.3:
                ws = [w for pair in zip(ws, ["x"] * len(ws), strict=True) for w in pair]
            out.append(rng.choice(["", "// "]) + rng.choice([" ", ", ", "\n", " \t"]).join(ws).title())
            out.append(" ".join(rng.choices(common, k=rng.randrange(0, 90))))
        texts.append(rng.choice(["\n", "\n\n", "\n /* \n"]).join(out))
    return texts


def test_scan_equals_plain_loops(spark):
    texts = corpus()
    rows = [(i, t, "x", 1, "k") for i, t in enumerate(texts)] + [(None, texts[8], None, None, None)] * 2 + [(5, texts[9], "x", 2, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, n_words int, key string").repartition(3)
    got = sorted((str(r.doc_id), *tuple(r)[1:-1], round(r.score, 9)) for r in scan(df).collect())
    assert list(map(str, got)) == sorted(map(str, sorted((str(r[0]), *plain(r[1])) for r in rows))) or got == sorted((str(r[0]), *plain(r[1])) for r in rows)
    assert sum("," in x[6] for x in got) > 20 and any(0 < x[7] < 1 for x in got)
    assert scan(df.limit(0)).count() == 0
    assert [tuple(r)[1:] for r in scan(df.where("doc_id = 2"), templates={}).collect()] == [(0, 0, None, None, "", "", 0.0)]


def test_a_very_long_text_is_scanned_whole(spark):
    text = "the of work " * 40_000 + "\n" + TEMPLATES["isc"] + "\n" + "license the " * 40_000
    row = scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert row.n_words == 200_000 + len(sequence(TEMPLATES["isc"])) and row.labels == "isc" and row.score == 1.0


def test_each_filter_rejects_some_and_no_match(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(corpus()) if t], "key long, text string")
    words = license_scan.vocabulary_of(TEMPLATES)
    told = rows.select("key", license_scan._held(license_scan._spaced(F.col("text")), words).alias("held"))
    prefixes = template_prefixes(told, TEMPLATES, 80)
    first = sorted({r.word for r in prefixes.collect()})
    for r in prefixes.collect():
        assert r.least == needed(r.size, 80) and r.members.index(r.word) == r.place <= r.size - r.least
    assert len(first) < len(words)  # other words start no candidate
    found = [r for r in candidates(rows, prefixes, max(width(t, 80) for t in TEMPLATES.values()), first).collect()]
    assert any(not r.long_enough for r in found) and any(r.long_enough and not r.enough_follow for r in found)
    for r in found:
        best = max(len(set(r.around[i : i + r.wide]) & set(r.members)) for i in range(len(r.around)))
        met = best >= r.least
        assert r.long_enough or not met
        if met and not r.enough_follow:  # then a rarer word of the block starts it
            again = [x for x in found if x.key == r.key and x.label == r.label and x.enough_follow and x.long_enough]
            assert any(max(len(set(x.around[i : i + x.wide]) & set(x.members)) for i in range(len(x.around))) >= best for x in again)
