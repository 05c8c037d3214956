"""Expected values of operators on small tables."""

import pytest
from pyspark.sql import functions as F

from loomstead.functions import chunkers, text
from loomstead.operators import findings, fusion, knowledge, lexical, reports, scoring, search, vectors
from loomstead.sources import files, texts


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


# --- retrieval ---------------------------------------------------------------------------------------------------------


def test_cosine_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), ([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    assert [round(r.x, 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 0.0, 0.0, 0.96]


@pytest.mark.parametrize("k", [0, 1, 2])
def test_top_k_ties_by_id(spark, k):
    df = spark.createDataFrame([(3, 0.5), (1, 0.5), (2, 0.9)], "id long, score double")
    assert [r.id for r in vectors.top_k(df, k).collect()] == [2, 1, 3][: k or 3]


def test_rrf_of_two_lists(spark):
    dense = spark.createDataFrame([("A", 0.9), ("B", 0.8), ("C", 0.7)], "id string, score double")
    words = spark.createDataFrame([("B", 5.0), ("D", 4.0), ("A", 3.0)], "id string, score double")
    got = fusion.fuse_rrf([dense, words]).collect()
    assert [r.id for r in got] == ["B", "A", "D", "C"] and got[0].score == pytest.approx(1 / 62 + 1 / 61)
    assert fusion.fuse_weighted(dense, words, 0.0).first().id == "B"
    for bad in (lambda: fusion.fuse_rrf([dense], 0), lambda: fusion.fuse_weighted(dense, words, 1.5)):
        with pytest.raises(ValueError):
            bad()


def test_multisearch_checks_its_queries(spark):
    hits = spark.createDataFrame([("a", 1, 0.98), ("b", 1, 0.97), ("b", 2, 0.5)], "query string, id long, score double")
    got = {r.id: (r.score, r.matched) for r in fusion.multisearch(hits, ["b", "a", "c"]).collect()}
    assert got == {1: (1.0, ["b", "a"]), 2: (0.5, ["b"])}
    assert [r.query for r in fusion.by_query(fusion.multisearch(hits, ["b", "a", "c"]), ["b", "a", "c"]).collect()] == ["b", "b", "a", "c"]
    for queries in ([], [""], ["a", "a"], [str(i) for i in range(11)]):
        with pytest.raises(ValueError):
            fusion.multisearch(hits, queries)


@pytest.mark.parametrize(("n", "labels"), [(1, "h"), (2, "hm"), (3, "hmm"), (10, "hhmmmmmlll")])
def test_percentile_labels(spark, n, labels):
    df = spark.createDataFrame([(i, 1.0 - i / 100) for i in range(n)], "id long, score double")
    assert "".join(r.relevance[0] for r in scoring.percentile_labels(df).orderBy("id").collect()) == labels


def test_calibration_and_its_defaults(spark):
    told = lambda p, b: tuple(round(x, 6) for x in spark.createDataFrame([(p, b)], "p double, b double").select(*scoring.calibration_thresholds(F.col("p"), F.col("b"))).first())
    assert told(0.9, 0.1) == (0.66, 0.42, 0.22) and told(0.1, 0.9) == (0.7, 0.4, 0.15)


def test_decay_and_recency(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), (None,), ("2025-01-01 00:00:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    as_of = F.to_timestamp(F.lit("2024-03-31 00:00:00"))
    got = df.select(scoring.temporal_decay(F.lit(1.0), F.col("t"), as_of).alias("d"), scoring.recency_boost(F.lit(1.0), F.col("t"), as_of).alias("r")).collect()
    assert [round(x.d, 6) for x in got] == [0.5, 1.0, 1.0] and [round(x.r, 3) for x in got] == [1.0, 1.0, 1.5]


def test_rank_normalisation_of_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 9.0), (4, 1.0)], "id long, v double")
    got = {r.id: round(r.n, 6) for r in scoring.rank_normalised(df, "v", "n").collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 1.0, 4: 0.0}
    flagged = scoring.coherence_flags(df, {"v": 1.0}, 25).where("flagged").collect()
    assert [r.id for r in flagged] == [3]


def test_bm25_needs_all_terms_and_ignores_operators(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha gamma"), (3, "delta"), (4, "x y z")], "id long, text string")
    assert [r.id for r in lexical.bm25(df, 'ALPHA AND "').where("score > 0").collect()] == []
    assert {r.id for r in lexical.bm25(df, '"alpha" (').collect()} == {1, 2}
    assert lexical.bm25(df, "!!").count() == 0
    postings, stats = lexical.build_postings(df)
    gaps = lexical.index_gaps(df.where("id < 4"), postings.where("id > 1"), stats.where("id > 1"))
    assert {(r.id, r.side) for r in gaps.collect()} == {(1, "unindexed"), (4, "orphan")}


def test_quantise_round_trip(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.5],), ([2.0, 2.0],)], "v array<float>").select(vectors.dequantise(vectors.quantise(F.col("v"))).alias("x"), "v")
    for r in df.collect():
        assert max(abs(a - b) for a, b in zip(r.x, r.v, strict=True)) <= 1 / 254 + 1e-6 or r.v == [2.0, 2.0]


def test_memory_search_decays_before_the_cut(spark):
    rows = [("old", "alpha beta", "x", [1.0, 0.0], "2020-01-01"), ("new", "alpha beta", "y", [0.9, 0.1], "2024-01-01")]
    df = spark.createDataFrame(rows, "id string, question string, answer string, embedding array<double>, d string").withColumn("created_at", F.to_timestamp("d"))
    got = search.memory_search(df, [1.0, 0.0], "alpha", F.to_timestamp(F.lit("2024-01-02")), 1).collect()
    assert [r.id for r in got] == ["new"]


# --- findings ----------------------------------------------------------------------------------------------------------


def stream(spark):
    rows = [
        ("HIGH|a/b/x.go:45|long problem text|fix it|perf|20|e|", "r1"), ("CRITICAL|a/b/x.go:47|short|fix|performance|60|e|", "r2"), ("LOW|a/b/x.go:90|other|f|docs|5|e|", "r1"), ("MEDIUM|y.py:3|p|f|ux|x|e|", "r2"), ("bad|row", "r1"),
    ]
    return texts.parse_findings(spark.createDataFrame(rows, "value string, tag string"))


def test_streams_are_parsed_and_merged(spark):
    rows = stream(spark)
    assert rows.where("rejected").count() == 1
    kept = rows.where("not rejected").withColumn("ord", F.monotonically_increasing_id())
    got = findings.dedupe(kept).orderBy("file", "line").collect()
    assert [(r.file, r.line, r.merged, r.severity, r.needs_review, r.category, r.confidence) for r in got] == [("a/b/x.go", 45, 2, "CRITICAL", True, "performance", "HIGH"), ("a/b/x.go", 90, 1, "LOW", False, "docs", "MEDIUM"), ("y.py", 3, 1, "MEDIUM", False, "ux", "MEDIUM")]
    assert got[0].problem == "long problem text" and got[0].est_minutes == 60 and sorted(got[0].reviewers) == ["r1", "r2"]


def test_route_keeps_every_row(spark):
    df = spark.createDataFrame([("5",), ("30",), ("2880",), ("soon",), (None,)], "est_minutes string")
    assert [(r.route, r.route_error is None) for r in findings.route(df).collect()] == [("quick_wins", True), ("backlog", True), ("td_files", True), ("backlog", False), ("backlog", False)]


def test_groups_need_three_and_keep_critical_apart(spark):
    rows = [("LOW", "src/auth/a.go:1", 1), ("LOW", "src/auth/b.go:1", 2), ("HIGH", "src/auth/c.tsx:1", 3), ("CRITICAL", "src/api/x.go", 4), ("HIGH", "lib/z.go", 5), ("LOW", "main.go", 6)]
    df = spark.createDataFrame([(s, f, float(m), "x") for s, f, m in rows], "severity string, file_line string, est_minutes double, category string")
    got = [(r.number, r.group_name, r.n, r.minutes, r.frontend) for r in findings.group_summary(findings.group_findings(df)).collect()]
    assert sorted(got) == [(0, "solo", 1, 5.0, False), (1, "critical", 1, 4.0, False), (2, "theme:src-auth", 3, 6.0, True)]


def test_filter_counts_add_up(spark):
    rows = [("HIGH", "[ ]", 10.0, "1", "HIGH", "s", 1), ("LOW", "[x]", 10.0, "1", "HIGH", "s", 2), ("LOW", "[ ]", 99.0, "2", "LOW", "s", 3)]
    df = spark.createDataFrame(rows, "severity string, checkbox string, est_minutes double, group string, confidence string, section string, ord int")
    kept, counts = findings.filter_findings(df, "quick", ["HIGH"], None, "1")
    c = counts.first().asDict()
    assert [r.ord for r in kept.collect()] == [1] and c["total"] == c["eligible"] + sum(v for k, v in c.items() if k.startswith("out_"))


def test_readme_rows_and_cleaning(spark):
    doc = "# T\n## [2024] A\n| Group | Sev |\n|---|---|\n| [x] | done |\n| [ ] | open |\n## [2024] B\n| H | S |\n|---|---|\n| [x] | done |\n"
    numbered = texts.lines(spark.createDataFrame([("d", doc)], "doc string, text string"))
    rows = texts.parse_readme(numbered).orderBy("line_no").collect()
    assert [(r.section, r.cells) for r in rows] == [("[2024] A", ["[x]", "done"]), ("[2024] A", ["[ ]", "open"]), ("[2024] B", ["[x]", "done"])]
    assert [r.line for r in findings.clean_readme(numbered).orderBy("line_no").collect()] == ["# T", "## [2024] A", "| Group | Sev |", "|---|---|", "| [ ] | open |"]


# --- knowledge ---------------------------------------------------------------------------------------------------------


def test_upsert_keeps_created(spark):
    old = spark.createDataFrame([(1, "a", "2020"), (2, "b", "2020")], "id long, answer string, created_at string")
    new = spark.createDataFrame([(2, "B", "2024"), (3, "C", "2024")], "id long, answer string, created_at string")
    got = sorted(tuple(r) for r in knowledge.import_entries(old, new, "merge").collect())
    assert got == [(1, "a", "2020"), (2, "B", "2020"), (3, "C", "2024")]
    assert knowledge.import_entries(old, new, "append").count() == 3 and knowledge.import_entries(old, new, "overwrite").count() == 2


def test_durations_and_diffs(spark):
    df = spark.createDataFrame([("30d",), ("2w",), ("6m",), ("1y",), ("x",)], "t string")
    assert [r.d for r in df.select(knowledge.duration_days(F.col("t")).alias("d")).collect()] == [30, 14, 180, 365, None]
    old = spark.createDataFrame([("o1", "h"), ("o2", "h"), ("o3", "k")], "id string, hash string")
    new = spark.createDataFrame([("n1", "h"), ("n2", "z")], "id string, hash string")
    assert sorted((r.old_id or "", r.new_id or "", r.action) for r in knowledge.diff_chunks(old, new).collect()) == [("", "n2", "embed"), ("o1", "n1", "reuse"), ("o2", "", "delete"), ("o3", "", "delete")]


# --- reports -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("path", "category"), [("a_test.go", "test"), ("x/dist/a.js", "generated"), ("README", "docs"), ("requirements.txt", "config"), ("a/b.py", "source"), ("bin/x", "other"), ("test_x.py", "test")])
def test_categories(spark, path, category):
    assert one(spark, reports.category_of_path(F.lit(path))) == category


def test_commits_in_time_order(spark):
    rows = [(1, ["a_test.go"]), (2, ["a.go"]), (3, ["b.go"]), (4, ["b_test.go", "b.go"]), (5, ["README.md"]), (6, ["c.go"])]
    got = {r.ord: r["class"] for r in reports.commit_classes(spark.createDataFrame(rows, "ord int, files array<string>")).collect()}
    assert got == {1: "test_only", 2: "test_first", 3: "test_after", 4: "test_with", 5: "non_code", 6: "no_test"}
    score = reports.tdd_score(reports.commit_classes(spark.createDataFrame(rows, "ord int, files array<string>"))).first()
    assert score.score == 50.0 and score.grade == "D"


def test_diff_smells(spark):
    diff = "--- a/x_test.go\n+++ b/x_test.go\n@@ -1 +1 @@\n-  assert.Equal(t, 1)\n+  // nolint\n--- a/y.py\n+++ b/y.py\n@@ -1 +1 @@\n+except E: pass\n+raise NotImplementedError"
    got = {(r.path, r.smell) for r in reports.diff_smells(reports.diff_lines(spark.createDataFrame([("d", diff)], "doc string, text string"))).collect()}
    assert got == {("x_test.go", "weakened_assertion"), ("x_test.go", "suppression"), ("y.py", "empty_catch"), ("y.py", "stub_body")}


def test_colours_overlaps_versions(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "a string, b string")
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "item string")
    assert {r.item: r.colour for r in reports.greedy_colours(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 0}
    hits = spark.createDataFrame([("f", 1, 1, 10, 0.9), ("f", 2, 5, 12, 0.8), ("f", 3, 11, 20, 0.7)], "file_path string, id long, start_line int, end_line int, score double")
    assert sorted(r.id for r in reports.suppress_overlaps(hits, 0.5).collect()) == [1, 3]
    names = spark.createDataFrame([("115.10_x",), ("115.9_y",), ("n",)], "name string")
    assert reports.highest_version(names).first()["next"] == "115.11"


def test_globs_tiers_ids(spark):
    df = spark.createDataFrame([("a/b/c.go",), ("c.go",), ("k.txt",)], "name string")
    got = {r.name: r.tier for r in reports.classify_tiers(df, {"c.go": "x"}, [("a/**/*.go", "g")], [("K", "w")]).collect()}
    assert got == {"a/b/c.go": "g", "c.go": "x", "k.txt": "w"}
    assert one(spark, reports.requirement_ids(F.lit("req-1, R-2 and REQ-1"))) == ["REQ-1", "R-2"]
    assert one(spark, reports.risk_ids(F.lit("R1 Risk 2 R-1"))) == ["R-1", "R-2"]


# --- texts -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("to", "want"), [("camelCase", "helloWorldFoo"), ("PascalCase", "HelloWorldFoo"), ("snake_case", "hello_world__foo"), ("kebab-case", "hello-world-foo"), ("UPPERCASE", "HELLO_WORLD FOO"), ("Title Case", "Hello_world Foo")])
def test_cases(spark, to, want):
    assert one(spark, text.change_case(F.lit("hello_world foo"), to)) == want


def test_codes_and_json(spark):
    for kind in ("base64", "base32", "hex", "url"):
        assert one(spark, text.decode(text.encode(F.lit("a b/\u00e9"), kind), kind)) == "a b/\u00e9"
    assert one(spark, text.encode(F.lit("a b"), "url")) == "a%20b"
    assert one(spark, text.json_query(F.lit('{"a": {"b": [1, {"c": "x"}]}}'), "a.b[1].c")) == "x"
    assert one(spark, text.json_merge(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":"3"}'))) == '{"a":"1","b":"3"}'
    assert one(spark, text.json_valid(F.lit("{bad"))) is False


def test_extraction(spark):
    assert one(spark, text.extract(F.lit("see https://a.b/c and x@y.org, 10.0.0.1 {{ n|d }}"), "urls")) == ["https://a.b/c"]
    assert one(spark, text.extract(F.lit("{{ n | d }} {{m}}"), "variables")) == ["n", "m"]
    assert one(spark, text.extract(F.lit("- [X] done\n- [ ] open"), "todos")) == ["[x] done", "[ ] open"]
    assert one(spark, text.substitute(F.lit("{{a}} [[a]] {{b|z}}"), {"a": "1"})) == "1 1 z"


@pytest.mark.parametrize(("style", "want"), [("secs", "-3725s"), ("hms", "-01:02:05"), ("compact", "-1h2m5s"), ("human", "-1h 2m 5s"), ("mins-secs", "-62m 5s")])
def test_durations(spark, style, want):
    assert one(spark, text.format_duration(F.lit(-3725), style)) == want


def test_arithmetic_is_closed(spark):
    assert one(spark, text.shown_number(text.arithmetic("(2 + 3) * 4 + 2 ** 3"))) == "28"
    for bad in ("__import__('os')", "a.b", "f'x'", "eval(1)"):
        with pytest.raises(ValueError):
            text.arithmetic(bad)


def test_markdown_lines(spark):
    doc = "# A\ntext\n```\n# not\n```\n## B\nb\n# C\nc"
    numbered = texts.lines(spark.createDataFrame([("d", doc)], "doc string, text string"))
    heads = texts.header_paths(texts.headers(numbered)).orderBy("line_no").collect()
    assert [(r.level, r.path) for r in heads] == [(1, ["A"]), (2, ["A", "B"]), (1, ["C"])]
    assert [r.line for r in texts.section(numbered, "b").orderBy("line_no").collect()] == ["## B", "b"]
    boxes = text.checkbox_counts(F.lit("- [x] a\n- [ ] b\n## [x] h\n| [ ] |"))
    assert spark.range(1).select(*[c.alias(k) for k, c in boxes.items()]).first().asDict() == {"checked": 2, "unchecked": 2, "partial": 0}


def test_delimited_rows_and_logs(spark):
    got = texts.parse_delimited(spark.createDataFrame([("a|b|c|d",), ("x",)], "value string"), ["p", "q", "r"]).collect()
    assert got[0].cells == {"p": "a", "q": "b", "r": "c", "_extra_1": "d"} and got[1].cells == {"p": "x", "q": "", "r": ""} and got[1].error
    log = texts.lines(spark.createDataFrame([("d", "A='1'\nB='2'\nA='3'")], "doc string, text string"))
    assert {r.key: r.value for r in texts.last_values(log).collect()} == {"A": "3", "B": "2"}


def test_documents_of_other_formats(spark):
    assert one(spark, texts.toml_as_json(F.col("t")), t="a = 1\n[b]\nc = 'x'") == '{"a": 1, "b": {"c": "x"}}'
    assert one(spark, texts.flat_keys(F.col("t")), t='{"a": {"b": [1, "x"]}}') == {"a.b[0]": "1", "a.b[1]": "x"}
    rows = [("p/package.json", '{"dependencies": {"x": "^1"}, "devDependencies": {"y": "2"}}'), ("go.mod", "require (\n\tgithub.com/a/b v1.2.3 // indirect\n)"), ("requirements.txt", "flask>=2.0\n# c"), ("pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version><scope>test</scope></dependency>"), ("Cargo.toml", "[dependencies]\nserde = '1'")]
    got = {(r.name, r.version, r.type) for r in texts.dependencies(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {("x", "^1", "production"), ("y", "2", "dev"), ("github.com/a/b", "v1.2.3", "indirect"), ("flask", ">=2.0", "production"), ("g:a", "1", "dev"), ("serde", "1", "production")}


# --- chunkers and files ------------------------------------------------------------------------------------------------


def test_chunkers():
    md = chunkers.markdown_chunks("---\na: b\n---\n# A\nx\n```\n# no\n```\n## B\ny")
    assert [(c[1], c[3], c[4]) for c in md] == [("frontmatter", 1, 3), ("A", 4, 8), ("A > B", 9, 10)]
    py = chunkers.code_chunks("class A:\n    def f(self):\n        return 1\n\nasync def g():\n    pass\n", "python")
    assert [(c[0], c[1], c[3], c[4]) for c in py] == [("struct", "A", 1, 3), ("method", "f", 2, 3), ("function", "g", 5, 6)]
    go = chunkers.code_chunks("type T struct {\n}\nfunc (t T) M() {\n if x {\n }\n}\nfunc F() {}\n", "go")
    assert [(c[0], c[1], c[3], c[4]) for c in go] == [("struct", "T", 1, 2), ("method", "M", 3, 6), ("function", "F", 7, 7)]
    assert [c[3:5] for c in chunkers.generic_chunks("a" * 10 + "\n" + "b" * 10 + "\nc", 15)] == [(1, 1), (2, 3)]
    html = chunkers.html_chunks("<body><nav>n</nav><article id='x'><p>one</p><section><p>two</p></section></article></body>")
    assert [(c[1], c[2]) for c in html] == [("x", "one\n\ntwo"), ("section", "two")]
    links = chunkers.page_links("<h1><a href='/a' title='t'><b>A</b></a></h1><footer><a href='#x'>x</a><a href='b' class='btn'>B</a><a href='/a'>again</a></footer>", "http://h/d/")
    assert [(x[0], x[3]) for x in links] == [("http://h/a", 120), ("http://h/d/b", 20)]


def test_files(spark, tmp_path):
    for name, content in (("a.py", b"def run():\n    run()\n"), ("sub/b.txt", b"hello run\n"), ("sub/c.bin", b"\x00\x01"), ("node_modules/d.js", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = files.scan(spark, str(tmp_path), content=True)
    short = found.withColumn("path", F.regexp_replace("path", f"^file:(//)?{tmp_path}/", ""))
    kept = files.globbed(short, exclude=["*.bin"])
    assert sorted(r.path for r in kept.collect()) == ["a.py", "sub/b.txt"]
    numbered = texts.lines(files.text_files(kept).withColumnRenamed("path", "doc"))
    got = sorted((r.doc, r.line_no, r.is_def, r.total) for r in files.multigrep(numbered, ["run"]).collect())
    assert got == [("a.py", 1, True, 3), ("a.py", 2, True, 3), ("sub/b.txt", 1, False, 3)]
    assert [r.path for r in files.tree(kept, 2).collect()] == ["a.py", "sub", "sub/b.txt"]
    assert one(spark, files.ignored(F.lit("x/node_modules/y"), ["node_modules/", "!keep"])) is True


def test_stream_of_a_log(spark, tmp_path):
    from loomstead.streaming import retrieval

    log = spark.createDataFrame([(1, "m", "q", 0.5, "2024-01-01"), (2, "m", "q", 1.0, "2024-01-02")], "id long, memory_id string, query string, score double, t string").withColumn("timestamp", F.to_timestamp("t")).drop("t")
    log.write.parquet(f"{tmp_path}/log")
    seen = []
    query = retrieval.in_batches(retrieval.read_log(spark, f"{tmp_path}/log"), lambda df, n: seen.append(df.count()), f"{tmp_path}/cp")
    query.awaitTermination()
    assert sum(seen) == 2
    running = retrieval.running_stats(retrieval.read_log(spark, f"{tmp_path}/log")).writeStream.outputMode("complete").format("memory").queryName("stats").trigger(availableNow=True).start()
    running.awaitTermination()
    assert [(r.n, r.avg_score) for r in spark.table("stats").collect()] == [(2, 0.75)]
