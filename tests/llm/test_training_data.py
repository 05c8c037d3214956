"""Small tests of the training-data operators: brute force, round trips, and odd tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstead.llm import byte_cnn, divergence, license_scan, mixing, packing, pu_quality, sketches, url_reputation
from loomstead.llm.common import shingle_set, word_hashes
from loomstead.llm.html_text import extract_main_text, main_text
from loomstead.llm.jaccard_join import jaccard_groups, links_in_tile
from loomstead.llm.queries import URL_RULES, tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, set_id string, component_id int, part int, key string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_docs(spark, rows=None):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns whose names clash."""
    rng = random.Random(5)
    long = words(rng, 5000)
    base = [
        (1, "One two three four five six seven eight nine ten.", "en", "a"), (1, "One two three four five six seven eight nine ten.", "en", "a"), (2, None, None, None),
        (None, "one two three four", "en", None), (3, "", "", ""), (4, " \n\t ", "en", "b"), (5, long, "en", "b"), (6, long + " x", "en", "b"), (7, "é" * 50 + " ñ ß", "fr", "é"), (None, None, None, "a"),
    ]
    return spark.createDataFrame([(*r, None, "x", 1, 7, "k") for r in (base if rows is None else rows)], DOCS)


def test_word_hashes_part_as_the_contract_says():
    text = "Aa b\x0bc\u00a0d  \x1ce\n\nA\u0130 aa"
    found, hashes = text.replace("A", "a").encode().split(), word_hashes(text)
    assert len(found) == len(hashes) == len(set(found)) + 1
    assert len({*zip(found, hashes.tolist(), strict=True)}) == len(set(found))


# --- op1 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("just  text", "just text"), ("<p>a <b>b</b>c<p>d", "a bc d"), ("<article><h1>T</h1><p>x &amp; y&lt;z</article><footer>f</footer>", "T x & y<z"),
        ("<body><nav>menu one</nav><article><p>Hi<script>var t='</p>'</script> you</p><aside>s</aside><div class='comments'><p>no</p></div><p>End.</p></article>", "Hi you End."),
        ("<article><header><h1>Title</h1></header><p>Body<br>line</p><form>f</form><div class='cookie-notice'>c</div></article>", "Title Body line"), ("<article><p>cut &am", "cut &am"), ("<p>a<!-- <p>no --> b", "a b"),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


def test_line_blocks_without_an_article():
    body = "Lorem ipsum dolor sit amet. " * 8
    page = f"<html><body><div id='top'>Home | About</div><div><h2>Head</h2><p>{body}</p><p>Short.</p></div><div><div><div><a href='x'>more</a></div></div></div></body></html>"
    assert main_text(page) == "Head " + " ".join(body.split()) + " Short."


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extract_main_text(df).collect()) == [(0, "", 0), (1, "a", 1)]
    assert extract_main_text(df.limit(0)).count() == 0


# --- op2 ---------------------------------------------------------------------------------------------------------------


def test_tiles_link_across_sides_only():
    sets = [np.arange(100, dtype=np.uint64) * np.uint64(7919), np.arange(99, dtype=np.uint64) * np.uint64(7919), np.arange(1, 100, dtype=np.uint64) * np.uint64(7919)]
    assert len(links_in_tile(sets, np.array([0, 0, 0]), 90)) == 2
    assert len(links_in_tile(sets, np.array([0, 1, 1]), 90)) == 2
    assert links_in_tile(sets[:2], np.array([1, 1]), 90) == []


def test_jaccard_groups_of_odd_tables(spark):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_groups(odd_docs(spark), 3, 90).collect())
    assert len(got) == 10 and [g for g in got if g[0] == "1"] == [("1", 8, "1")] * 2
    assert [g[2] for g in got if g[0] in "56"] == ["5", "5"] and ("2", 0, "2") in got and ("None", 0, "None") in got
    assert jaccard_groups(odd_docs(spark, []), 3, 90).count() == 0


# --- op3 ---------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = ["https://A.COM/en/x?q#f", "http://www.example.com/en/70", "x://b.net/de/1", "http://s.example.net/de/8#x", "http://o.org/es/", "http://com", None, "no url", "http://notcom/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge_urls(df, none, URL_RULES).collect()}
    assert got == {
        0: ("a.com", "/en/x", "com/en/", "block"), 1: ("www.example.com", "/en/70", "example.com/en/7", "allow"), 2: ("b.net", "/de/1", "net/de/", "allow"), 3: ("s.example.net", "/de/8", "example.net/de/8", "block"),
        4: ("o.org", "/es/", "org/es/", "block"), 5: ("com", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("notcom", "/en/", None, "allow"),
    }
    assert url_reputation.judge_urls(df.limit(0), none, URL_RULES).count() == 0


def test_reputation_blocks_bad_hosts_and_shrinks_small_ones(spark):
    rows = [(i, f"http://{h}/x") for i, h in enumerate(["bad.example.com"] * 30 + ["good.example.com"] * 300 + ["new.example.com"] + ["ok.example.org"] * 200)]
    bad = [(i, int("bad" in u or "new" in u or i % 10 == 0)) for i, u in rows]
    got = url_reputation.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int"), [])
    told = {r.host: r.verdict for r in got.select("host", "verdict").distinct().collect()}
    assert told == {"bad.example.com": "block", "good.example.com": "allow", "new.example.com": "allow", "ok.example.org": "allow"}


# --- op4 ---------------------------------------------------------------------------------------------------------------


def test_license_scan(spark):
    texts = ["cc by cc-BY x", "Some words. All rights reserved", "Released under the MIT License.", None, "", "cc\nby general PUBLIC license", "released license under mit", "This work is licensed under the GNU General Public License, version 3."]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: tuple(r)[1:] for r in license_scan.scan(df.union(df.where("doc_id = 2"))).collect()}
    assert got[0] == (5, 2, 0, 2, "cc-by", "cc-by", 1.0)
    assert got[1] == (5, 1, 2, 2, "reserved", "reserved", 1.0)
    assert got[2] == (5, 0, None, None, "", "mit", 1.0) and got[6][5:] == ("mit", 0.8)
    assert got[3] == got[4] == (0, 0, None, None, "", "", 0.0)
    assert got[5][:5] == (5, 2, 0, 2, "cc-by,gpl")
    assert got[7][4:6] == ("gpl", "gpl,gpl-3.0")
    assert license_scan.scan(df.limit(0)).count() == 0


# --- op5 ---------------------------------------------------------------------------------------------------------------


def test_positive_unlabelled_learning():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (3000, pu_quality.FEATURES)), rng.normal(2.5, 1, (600, pu_quality.FEATURES))
    model = pu_quality.fit(good[:800], np.concatenate((good[800:], bad)))
    assert abs(model.prior - 2200 / 2800) < 0.08
    fresh_good, fresh_bad = rng.normal(0, 1, (500, pu_quality.FEATURES)), rng.normal(2.5, 1, (500, pu_quality.FEATURES))
    assert (model.scores(fresh_good) >= 0.3).mean() > 0.97 and (model.scores(fresh_bad) < 0.3).mean() > 0.95
    assert pu_quality.fit(good[:0], bad) is None


def test_quality_scores_of_odd_tables(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, words(rng, 60) if i % 4 else "spam " * 60) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300) if i % 4], "doc_id long, quality int")
    model = pu_quality.learn(docs, labels)
    got = {r.doc_id: r.score for r in pu_quality.score_quality(docs, model).collect()}
    assert max(s for i, s in got.items() if i % 4 == 0) < 0.3 < min(s for i, s in got.items() if i % 4)
    assert all(0 <= r.score <= 1 for r in pu_quality.score_quality(odd_docs(spark), model).collect())
    assert pu_quality.learn(docs.limit(0), labels) is None and pu_quality.score_quality(odd_docs(spark, []), None).count() == 0


# --- op6 ---------------------------------------------------------------------------------------------------------------


def test_language_network(spark):
    rng = random.Random(3)
    parts = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["schu", "ber", "ung", "\u00df"]}
    texts = [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(60)), lang, None) for i, lang in enumerate(["aa", "bb"] * 60)]
    docs = odd_docs(spark, texts)
    network = byte_cnn.learn(docs)
    got = byte_cnn.identify(docs, network).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) == 1.0
    odd = {r.text: (r.lang_pred, r.lang_score) for r in byte_cnn.identify(odd_docs(spark), network).collect()}
    assert odd[None] == odd[""] == odd[" \n\t "] == ("und", 0.0)
    assert byte_cnn.learn(odd_docs(spark, [])) is None and byte_cnn.identify(odd_docs(spark, []), None).count() == 0


def test_windows_cover_whole_texts():
    for n in (0, 1, 159, 160, 161, 1000):
        rows = byte_cnn.windows("a" * n)
        assert rows.shape[1] == byte_cnn.WINDOW and (rows == 97).sum() >= n


# --- op7 ---------------------------------------------------------------------------------------------------------------


def filled(sizes, weights, budget, most):
    """Targets by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    done = {}
    while len(done) < len(names):
        rest = budget - sum(done.values())
        level = rest / sum(weight[s] for s in names if s not in done)
        over = [s for s in names if s not in done and level * weight[s] > most * sizes[s]]
        if not over:
            return done | {s: level * weight[s] for s in names if s not in done}
        done |= {s: most * sizes[s] for s in over}
    return done


def test_mix_targets_and_budgets(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randrange(0, 60)), "en", rng.choice(["a", "a", "a", "b", "c", None, ""])) for i in range(600)]
    got = mixing.mix(odd_docs(spark, rows)).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r.source] += r.size
        assert r.size == len((rows[r.doc_id][1] or "").split()) and r.taken in (0, r.size, 2 * r.size)
    targets = filled(sizes, (3, 1, 2), 1.5 * sum(sizes.values()), 2)
    for source, target in targets.items():
        own = [r for r in got if r.source == source]
        assert all(math.isclose(r.target, target, rel_tol=1e-9, abs_tol=1e-6) and r.source_size == sizes[source] for r in own)
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(odd_docs(spark, rows).repartition(5)).collect()))


def test_mix_of_odd_tables(spark):
    got = mixing.mix(odd_docs(spark)).collect()
    assert len(got) == 10 and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(odd_docs(spark, [])).count() == 0


# --- op8 ---------------------------------------------------------------------------------------------------------------


def neighbours(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    return [(a, order[(i + 1) % len(order)]) for i, a in enumerate(order)]


@pytest.mark.parametrize("odd", [False, True])
def test_fingerprints_equal_brute_force(spark, odd):
    rng = random.Random(4)
    df = odd_docs(spark) if odd else odd_docs(spark, [(rng.randrange(1000), words(rng, rng.randrange(0, 90)), "en", "s") for _ in range(80)])
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = []
    for (i, text), (_, following) in neighbours(rows):
        text, following = text or "", following or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        a, b, c = (sketches.sketch(x) for x in (text, edited, following))
        want.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), sketches.encode_sketch(a), sketches.encode_sketch(b), sketches.likeness(a, b), sketches.likeness(a, c)))
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in sketches.neighbour_fingerprints(df.repartition(4)).collect()) == sorted(want)


def test_sketches_estimate_and_merge():
    rng = random.Random(6)
    small = words(rng, 3000, 10**6)
    large = small + " " + words(rng, 60000, 10**6)
    a, b = sketches.sketch(small), sketches.sketch(large)
    assert sketches.containment(a, b) > 0.97 and abs(sketches.containment(b, a) - 3000 / 63000) < 0.02
    assert np.array_equal(sketches.merge_sketches(a, b), np.union1d(a, b)) and np.array_equal(sketches.decode_sketch(sketches.encode_sketch(a)), a)
    assert sketches.likeness(a, a) == 1.0 and len(sketches.sketch("one")) == 1 and not len(sketches.sketch(" "))


def test_fingerprints_of_an_empty_table_and_one_row(spark):
    assert sketches.neighbour_fingerprints(odd_docs(spark, [])).count() == 0
    one = sketches.neighbour_fingerprints(odd_docs(spark, [(1, "abc def", "en", "s")])).collect()
    assert one[0].near_next == 1.0 and one[0].n_chars == 7


# --- op9 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("odd", [False, True])
def test_packing_is_a_round_trip(spark, odd):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    df = odd_docs(spark) if odd else odd_docs(spark, [(i, words(rng, rng.randrange(0, 400)) + "\u00c9t\u00e9! 'll 12", "en", "s") for i in range(40)])
    tokenizer = Tokenizer.from_file(tokenizer_file())
    ids = collections.defaultdict(list)
    for r in df.collect():
        ids[r.doc_id].append(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1])
    pieces = packing.pack(df.repartition(3), tokenizer_file(), window=256).collect()
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
        assert any(len(x) == p.doc_tokens and zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in ids[p.doc_id])
    assert sum(p.length for p in pieces) == sum(len(x) for xs in ids.values() for x in xs)
    for spans in by.values():
        assert [o for o, _ in sorted(spans)] == list(np.cumsum([0, *[n for _, n in sorted(spans)]]))[:-1]
        total = sum(n for _, n in spans)
        assert total == 256 or total & (total - 1) == 0 and total < 256
    assert packing.pack(odd_docs(spark, []), tokenizer_file()).count() == 0


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    known, tokenizer = packing.ChunkIds(tokenizer_file(), "<u2"), Tokenizer.from_file(tokenizer_file())
    for text in ["A\tb\x0bc  d e \u01c4 \ufb01 \u0130stanbul I'LL don't ' s 12 3\uff14", "\u0391\u03a3 e\u0301 \u00e9 \x1c\x1d a", "x.y,z!! ### \u4f60\u597d \U0001f600", "\u00b2\u2167 a_b"]:
        assert np.frombuffer(known.of(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


# --- op10 --------------------------------------------------------------------------------------------------------------


def counted(text):
    import re

    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    covered = {j for i in range(len(found) - 7) if windows[tuple(found[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, seen, doubled = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubled += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(covered)


def test_base_counts_equal_brute_force(spark):
    rng = random.Random(10)
    texts = [words(rng, rng.randrange(0, 80), rng.choice([2, 5, 300])).replace(" w1", "\nw1#") + "\n\u00e9\u00a0x | <" for _ in range(60)]
    texts += ["", " \n ", "a b c d e f g h " * 5, "line\nline\n\n\nline"]
    df = odd_docs(spark, [(i, t, "en", None) for i, t in enumerate(texts)])
    for r in divergence.quality_rules(df).collect():
        n, chars, symbols, doubled, repeated = counted(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, doubled, repeated)
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n) and not (r.base_failed and r.kept)


def test_divergent_texts_are_rejected(spark):
    rng = random.Random(11)
    clean = lambda: " ".join(rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.4 else f"{rng.choice('abc')}{rng.choice('xyz')}{rng.randrange(99)}".translate({48: "a", 49: "b", 50: "c"}) for _ in range(200)) + "."
    rows = [(i, clean(), "en", None) for i in range(60)] + [(100, clean().upper().replace(" ", "!! "), "en", None), (101, clean().replace(" ", " | "), "en", None), (102, clean(), None, None)]
    kept = {r.doc_id: r.kept for r in divergence.quality_rules(odd_docs(spark, rows)).collect()}
    assert all(kept[i] for i in range(60)) and kept[102] and not kept[100] and not kept[101]
    assert len(divergence.quality_rules(odd_docs(spark)).collect()) == 10 and divergence.quality_rules(odd_docs(spark, [])).count() == 0
    assert divergence.divergence(np.array([1.0, 0]), np.array([0, 1.0])) == 1.0 and divergence.divergence(np.ones(3), np.ones(3)) == 0.0
