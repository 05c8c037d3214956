"""Expected values of the inspection operators on small tables."""

from pyspark.sql import functions as F

from loomstead.operators import inspection as i


def test_projects_and_plans(spark):
    files = spark.createDataFrame([(p,) for p in ("a/package.json", "a/tsconfig.json", "a/yarn.lock", "b/go.mod", "b/x.txt", "b/go.sum", "c/y")], "path string")
    got = {r.dir: (r.stack, r.language, r.package_manager, r.framework) for r in i.detect_projects(files).collect()}
    assert got == {"a": ("node", "typescript", "yarn", None), "b": ("go", "go", "go", None)}
    plans = spark.createDataFrame([("p/plan.md", "**Plan Type:** bugfix"), ("p/metadata.md", "x"), ("q/plan.md", "none")], "path string, text string")
    assert {r.dir: r.plan_type for r in i.plan_types(plans).collect()} == {"p": "bugfix", "q": "feature"}


def test_sprint_status(spark):
    df = spark.createDataFrame([(96.0, True, 80.0, 0), (70.0, True, 0.0, 0), (96.0, False, 10.0, 2), (10.0, True, 0.0, 0)], "completion double, tests_passed boolean, coverage double, critical int")
    got = [(r.status, len(r.reasons)) for r in i.sprint_status(df, coverage_min=50.0).collect()]
    assert got == [("COMPLETED", 0), ("PARTIAL", 1), ("FAILED", 3), ("FAILED", 1)]


def test_notations(spark):
    raws = ["a/b.go:12", "a/b.go:12-20 (see)", "a.go:Run / _x", "a.go / b.go", "a.go", ""]
    got = [r.x and (r.x.path, r.x.symbol, r.x.line_from, r.x.line_to) for r in spark.createDataFrame([(x,) for x in raws], "v string").select(i.parse_file_line(F.col("v")).alias("x")).collect()]
    assert got == [("a/b.go", None, 12, 12), ("a/b.go", None, 12, 20), ("a.go", "Run", None, None), ("a.go", None, None, None), ("a.go", None, None, None), None]


def test_identifiers_and_documents(spark):
    df = spark.createDataFrame([("Fix `aliasTable` in run_func and os.ReadFile (Deferred to X)", "blocked on API")], "a string, b string")
    row = df.select(i.code_identifiers(F.col("a")).alias("ids"), i.is_punt(F.col("b")).alias("punt"), i.strip_boilerplate(F.col("a")).alias("plain")).first()
    assert row.ids == ["aliastable", "os.readfile", "readfile", "run_func"] and row.punt and row.plain.endswith("ReadFile")
    doc = i.document_dependencies(spark.createDataFrame([("Create a/new.go, update `a/old.go`, see b/ref.md in docs/ and `c/x.py`",)], "text string")).first()
    assert (doc.files_create, doc.files_modify, doc.files_read, doc.directories, doc.confidence) == (["a/new.go"], ["a/old.go", "c/x.py"], ["b/ref.md"], ["docs/"], "high")


def test_status_lines_audits_and_diffs(spark):
    lines = spark.createDataFrame([(" M a.go",), ("R  x -> y",), ("?? n.txt",), ("M",)], "line string")
    assert [tuple(r) for r in i.git_status(lines).collect()] == [("M", "a.go", False, False), ("R", "y", True, False), ("??", "n.txt", False, True)]
    entry = spark.createDataFrame([("1", {"id": "1", "date": "x", "odd": "y", "tags": "[]"}, "see [from context]")], "id string, keys map<string,string>, body string")
    row = i.audit_entries(entry).first()
    assert row.unknown == ["odd"] and "created" not in row.missing and "status" in row.missing and row.needs_input == ["question", "tags"] and row.placeholders == 1
    diff = spark.createDataFrame([("a\nb\nc", "a\nx\nc\nd")], "o string, n string").select(i.line_diff("o", "n").alias("d")).first().d
    assert (diff.added, diff.removed, diff.same) == (2, 1, False)
    assert i.minimal(entry.withColumnRenamed("body", "message")).columns == ["id", "keys", "msg"]
    codes = spark.createDataFrame([(200, "ok", None), (403, "Just a moment", None), (503, "", None), (404, "", None), (0, "", "reset")], "s int, b string, e string")
    assert [r.x for r in codes.select(i.fetch_outcome(F.col("s"), F.col("b"), F.col("e")).alias("x")).collect()] == ["ok", "challenge", "blocked", "terminal", "blocked"]
