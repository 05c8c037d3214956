"""Edits, stems, overlaps, sort orders and metadata on small and odd tables."""

import math
import re

import pytest
from pyspark.sql import functions as F

from loomstead.functions import chunkers, editing
from loomstead.operators import inspection, knowledge, lexical, scoring
from loomstead.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_stems():
    words = "caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll licensing"
    stems = "caress poni ti cat feed agre plaster bled motor sing conflat troubl size hop tan fall hiss fizz fail file happi sky relat condit ration valenc digit conform radic differ vile analog vietnam predic oper feudal decis hope callous formal sensit sensibl triplic form formal electr electr hope good reviv allow infer airlin gyroscop adjust defens irrit replac adjust depend adopt homolog commun activ angular homolog effect bowdler probat rate ceas control roll licens"
    assert [lexical.stem(w) for w in words.split()] == stems.split()
    assert [lexical.stem(w) for w in ("is", "\u00fcber", "x1s", "")] == ["is", "\u00fcber", "x1s", ""]


def test_stemmed_scores_over_two_columns_equal_the_formula(spark):
    docs = [(1, "Licenses", "licensed work"), (2, "work", "the works of many"), (3, "other", None), (4, "licensing", "worked"), (5, "a", "b"), (6, "c", "d e f"), (7, None, None), (8, "g", "h")]
    df = spark.createDataFrame(docs, "id long, name string, content string")
    postings, stats = lexical.build_postings(df, text=["name", "content"], stemmed=True)
    got = {r.id: r.score for r in lexical.bm25_from_postings(postings, stats, "license AND working", stemmed=True).collect()}
    bags = {i: [lexical.stem(w) for w in re.findall(r"[^\W_]+", f"{a or ''} {b or ''}".lower())] for i, a, b in docs}
    mean, terms = sum(map(len, bags.values())) / len(bags), ["licens", "and", "work"]
    want = {}
    for i, bag in bags.items():
        if all(t in bag for t in terms):
            want[i] = 0.0
    assert got == want == {}
    got = {r.id: r.score for r in lexical.bm25_from_postings(postings, stats, "license working", stemmed=True).collect()}
    for i, bag in bags.items():
        if all(t in bag for t in ("licens", "work")):
            want[i] = 0.0
            for t in ("licens", "work"):
                df_, tf = sum(t in b for b in bags.values()), bag.count(t)
                want[i] += max(1e-6, math.log((len(bags) - df_ + 0.5) / (df_ + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / mean))
    assert got.keys() == want.keys() == {1, 4} and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
    left = lexical.deleted_postings(postings, stats, spark.createDataFrame([(1,), (99,)], "id long"))
    assert {r.id for r in left[0].select("id").distinct().collect()} == {2, 3, 4, 5, 6, 8} and left[1].count() == 7


def test_edits_one_after_the_other(spark):
    edits = [{"old": "a", "new": "aa"}, {"mode": "insert_after", "line": 2, "new": "z"}, {"mode": "insert_before", "line": 4, "new": "y"}, {"mode": "delete_line", "line": 1}, {"mode": "delete_line", "line": 9}]
    got = one(spark, editing.edit_blocks(F.lit("xay\na"), edits))
    assert (got.text, got.statuses, got.changes) == ("a\nz\ny", ["success"] * 4 + ["line_out_of_range"], 4)
    assert one(spark, editing.edit_blocks(F.lit(None).cast("string"), edits[:1])).text is None
    assert one(spark, editing.edit_blocks(F.lit("a"), [])).text == "a"
    with pytest.raises(ValueError):
        editing.edit_blocks(F.lit("a"), [{"mode": "move"}])


def test_yaml_paths_and_edits(spark):
    assert editing.path_parts("a.b[0].c") == ["a", "b", 0, "c"] and editing.path_parts("a\\.b[-1]") == ["a.b", -1]
    got = one(spark, editing.edit_yaml(F.lit("a: [1, 2]\nb: {c: d}\n"), [("set", "a[-1]", "7"), ("set", "new.key", "x"), ("delete", "b.c", None), ("push", "fresh", "1.5"), ("pop", "none", None), ("set", "b.c.d", "e")]))
    assert got.text == "a: [1, 7]\nb: {c: {d: e}}\nnew:\n  key: x\nfresh:\n- 1.5\n" and got.popped == []
    assert one(spark, editing.edit_yaml(F.lit("a: ["), [("set", "a", "1")])).text is None
    assert one(spark, editing.edit_yaml(F.lit(None).cast("string"), [("set", "a", "1")])).text == "a: 1\n"
    assert one(spark, editing.yaml_values(F.lit("a: {b: [x, 2]}"), ["a.b[1]", "a.b[-2]", "a.z", "a"], "-")) == ["2", "x", "-", '{"b": ["x", 2]}']


def test_sizes_and_ranges(spark):
    import json

    for text in ("", 'a"b\\c', "\n\t\r\x01\x1f", "\u00e4\u4f60"):
        assert one(spark, editing.json_size(F.lit(text))) == len(json.dumps(text, ensure_ascii=False).encode()) - 2
    assert bytes(one(spark, editing.byte_range(F.lit(b"abcdef"), 2, 3))) == b"cde" and bytes(one(spark, editing.byte_range(F.lit(b"abc"), 2, 9))) == b"c"


def test_overlaps_are_cut_at_whole_characters(spark):
    files_ = spark.createDataFrame([("a.md", "# A\n" + "\u00e4" * 30 + "\n# B\nend"), ("b.md", None)], "path string, text string")
    got = chunkers.overlapped(chunkers.chunk_files(files_), files_, 1, 20)
    texts = {r.name: r.embed_text for r in got.collect()}
    assert texts == {"A": "# A\n" + "\u00e4" * 8, "B": "\u00e4" * 10}


def test_orders_and_reports(spark):
    df = spark.createDataFrame([("10", "error", "1"), ("9", "warn", "3"), ("x", "ERROR", "2"), ("b", None, "4")], "g string, severity string, date string")
    assert [r.g for r in df.orderBy(*inspection.group_order(F.col("g"))).collect()] == ["9", "10", "b", "x"]
    assert [r.g for r in inspection.violations_in_order(df).collect()] == ["x", "10", "b", "9"]
    lines = [r.line for r in inspection.report("T", df.select("g", "date").coalesce(1)).orderBy("place").collect()]
    assert lines[:4] == ["# T", "", "| g | date |", "|---|---|"] and lines[4] == "| 10 | 1 |" and len(lines) == 8
    tree = spark.createDataFrame([("b", False, 1), ("z", True, 0), ("a", False, 2)], "path string, is_dir boolean, size int")
    assert [r.path for r in files.listing(tree, dirs_first=True).collect()] == ["z", "a", "b"]


def test_metadata_of_another_model_is_none(spark):
    c = scoring.calibrate(spark.createDataFrame([(0.8,)], "score double"), spark.createDataFrame([(0.2,)], "score double"))
    row = scoring.calibration_row(c, "m", F.lit("2024-01-01"))
    assert scoring.stored_calibration(row, "m").first().perfect == 0.8 and scoring.stored_calibration(row, "n").count() == 0


def test_totals_come_before_filters(spark):
    e = spark.createDataFrame([(1, "pending", ["A"]), (2, "promoted", ["B"]), (3, None, None)], "memory_id long, status string, tags array<string>")
    log = spark.createDataFrame([(1, 0.5, None), (1, 0.7, None), (2, 0.1, None)], "memory_id long, score double, timestamp timestamp")
    rows, totals = knowledge.stats_table(e, log, 1, tag="a")
    assert [(r.memory_id, r.n) for r in rows.collect()] == [(1, 2)] and tuple(totals.first()) == (3, 1, 1)
