"""Stores, orders over whole tables, and the odd rows of both."""

import random

import pytest
from pyspark.sql import functions as F

from loomstead.functions import chunkers, text
from loomstead.operators import findings, inspection, ordering, reports, scoring, store
from loomstead.sources import files, texts


def test_running_totals_equal_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(20)]), rng.choice([None, 1, 2, 5]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, v int, id int").repartition(5)
    got = {r.id: r.before for r in ordering.running_before(df, [F.col("k"), F.col("id")], F.col("v"), "before").collect()}
    total, want = 0, {}
    for _, v, i in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2])):
        want[i] = total
        total += v or 0
    assert got == want and ordering.running_before(df.limit(0), [F.col("k")], F.col("v"), "x").count() == 0


def test_budget_with_nulls(spark):
    df = spark.createDataFrame([("b", "x" * 8), ("a", "y" * 4), (None, "z"), ("c", None), ("d", "w")], "path string, text string")
    assert {r.path for r in files.within_budget(df, 2).collect()} == {"a", "b"}
    assert {r.path for r in files.within_budget(df, 4).collect()} == {"a", "b", "c", "d", None}


def test_flags_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 5.0), (3, 2.0, 7.0), (4, None, None), (5, 9.0, 6.0)], "id long, a double, b double")
    got = {r.id: (r.a_norm, r.b_norm, round(r.suspicion, 6), r.flagged) for r in scoring.coherence_flags(df, {"a": 1.0, "b": 1.0}, 40).collect()}
    assert got == {1: (0.0, None, 0.0, False), 2: (0.5, 0.0, 0.25, False), 3: (0.5, 1.0, 0.75, True), 4: (None, None, 0.0, False), 5: (1.0, 0.5, 0.75, True)}


def test_overlaps_with_nulls(spark):
    rows = [("f", 1, 1, 10, None), ("f", 2, 1, 10, 5.0), ("f", None, 1, 10, 5.0), ("f", 3, None, 4, 1.0), (None, 4, 1, 10, 2.0)]
    df = spark.createDataFrame(rows, "file_path string, id int, start_line int, end_line int, score double")
    assert sorted(r.id for r in reports.suppress_overlaps(df).collect()) == [2, 3, 4]


def test_clusters_with_nulls(spark):
    rows = [("f", 5, 1), ("f", 7, 2), ("f", None, 3), ("f", 20, 4), ("f", 5, 5), (None, 1, 6)]
    df = spark.createDataFrame(rows, "file string, line int, ord int")
    assert {r.ord: r.cluster for r in findings.clustered(df).collect()} == {1: 0, 2: 0, 3: -1, 4: 1, 5: 0, 6: 0}
    with pytest.raises(ValueError):
        findings.clustered(df, -1)


def test_dedupe_accounts_and_votes(spark):
    rows = [(1, "HIGH", "a:1", "p", "f", "perf", 5.0, "r1"), (2, "LOW", "a:2", "longer", None, "docs", 9.0, "r2"), (3, "LOW", "a:3", "p", "fix", "doc", None, "r1"), (4, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "ord int, severity string, file_line string, problem string, fix string, category string, est_minutes double, reviewer string")
    merged = findings.dedupe(df)
    got = {r.file: r for r in merged.collect()}
    a = got["a"]
    assert (a.merged, a.severity, a.needs_review, a.category, a.problem, a.fix, a.est_minutes, a.reviewers, a.confidence) == (3, "HIGH", True, "docs", "longer", "fix", 9.0, ["r1", "r2"], "HIGH")
    assert (got[None].merged, got[None].category, got[None].reviewers) == (1, None, [])
    assert tuple(findings.dedupe_accounts(df, merged).first()) == (4, 2, 4, True)


def test_store_lookups_and_deletions(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (None, None, "x")], "id long, file_path string, domain string")
    assert store.lookup(df, 2).first().file_path == "a"
    with pytest.raises(LookupError):
        store.lookup(df, 9)
    with pytest.raises(ValueError):
        store.deleted(df)
    ids = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    assert [r.id for r in store.deleted(df, ids).collect()] == [None]
    assert sorted(str(r.id) for r in store.deleted(df, ids, domain="x").collect()) == ["2", "None"]
    assert {r.id: r.domain for r in store.updated(df, {"domain": F.lit("y")}, file_path="a").collect()} == {1: "y", 2: "y", None: "x"}
    assert [r.file_path for r in store.indexed_files(df).collect()] == ["a"] and store.cleared(df).count() == 0


def test_index_is_built_and_refreshed(spark):
    one = spark.createDataFrame([("a.md", "# A\nx"), ("b.md", "# B\ny"), ("c.md", None)], "path string, text string")
    embed = lambda c: F.array(F.length(c).cast("float"))
    chunks = store.built(one, embed)
    assert {(r.file_path, r.name, len(r.embedding)) for r in chunks.collect()} == {("a.md", "A", 1), ("b.md", "B", 1)}
    states = one.select(F.col("path").alias("file_path"), F.sha2("text", 256).alias("content_hash"))
    two = spark.createDataFrame([("a.md", "# A\nx"), ("b.md", "# C\ny"), ("d.md", "# D")], "path string, text string")
    again, now = store.refreshed(chunks, states, two, embed)
    assert {(r.file_path, r.name) for r in again.collect()} == {("a.md", "A"), ("b.md", "C"), ("d.md", "D")} and now.count() == 3


def test_groups_are_renumbered_once(spark):
    rows = [(1, 3, "7", "[ ]"), (2, 3, "5", "[x]"), (3, 3, "2", "[ ]"), (4, 3, "7", "[x]"), (5, 9, "7", "[ ]"), (6, 9, "solo", "[ ]"), (7, 9, None, "[ ]")]
    df = spark.createDataFrame([("d", *r) for r in rows], "doc string, line_no int, section int, group string, checkbox string")
    out = findings.renumber_groups(df)
    assert {r.line_no: r.new_group for r in out.collect()} == {1: "1", 2: "5", 3: "2", 4: "1", 5: "3", 6: "solo", 7: None}
    again = findings.renumber_groups(out.drop("group").withColumnRenamed("new_group", "group"))
    assert {r.line_no: r.new_group for r in again.collect()} == {r.line_no: r.new_group for r in out.collect()}
    assert findings.active_groups(df).first().highest == 7


def test_code_blocks_end_where_their_braces_do():
    go = 'func a() {\n\tx := "}" // }\n}\n\nfunc b(i interface{}) {\n}\n\nfunc c()\n\nfunc d() {\n'
    assert [(n, a, b) for _, n, _, a, b in chunkers.code_chunks(go, "go")] == [("a", 1, 3), ("b", 5, 6), ("c", 8, 11), ("d", 10, 11)]
    py = 'def a():\n    """\ntext\n"""\n    return 1\n\nx = 2\nclass B:\n    def m(\n        self,\n    ):\n        pass\n# end\n'
    assert [(k, n, a, b) for k, n, _, a, b in chunkers.code_chunks(py, "python")] == [("function", "a", 1, 5), ("struct", "B", 8, 12), ("method", "m", 9, 12)]
    assert len(chunkers.code_chunks("fn f() {\n" * 20_000, "rust")) == 20_000


def test_git_log_and_sizes(spark):
    log = "abcdef1|me|2024-02-02|second\na.go\n\nb.go\nabcdef0|me|2024-02-01|first | with a pipe\n"
    got = reports.git_log(texts.lines(spark.createDataFrame([("l", log)], "doc string, text string"))).collect()
    assert sorted((r.ord, r.hash, r.message, r.files) for r in got) == [(1, "abcdef0", "first | with a pipe", []), (2, "abcdef1", "second", ["a.go", "b.go"])]
    df = spark.createDataFrame([("10",), ("1.5 KB",), ("2m",), ("3 GiB",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(text.parse_size(F.col("s"))).collect()] == [10, 1536, 2097152, 3221225472, None, None]


def test_named_files_and_escaped_cells(spark):
    df = spark.createDataFrame([("Create 'my new file.go', edit `b c.py` and see d.xyz or e.md",), (None,)], "text string")
    got = inspection.document_dependencies(df).collect()
    assert (got[0].files_create, got[0].files_modify, got[0].files_read) == (["my new file.go"], ["b c.py"], []) and got[1].total == 0
    row = spark.createDataFrame([("a|b\nc", None)], "x string, y string")
    assert findings.markdown_rows(row, ["x", "y"]).first().line == "| a\\|b c |  |"
