"""Coverage, alignment, risks, test discipline, categories, tiers, smells, versions and graphs."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Patterns of paths, ids and lines.
TEST_PATHS = (r"_test\.go$", r"\.test\.(ts|tsx|js|jsx)$", r"\.spec\.(ts|tsx|js|jsx)$", r"^test_.*\.py$", r"_test\.py$", r"Test\.java$", r"_test\.rs$")
MORE_TEST_PATHS = (r"_test\.rb$", r"\.test\.rb$", r"_spec\.rb$")
GENERATED_DIRS = ("dist/", "build/", "node_modules/", "vendor/", "__pycache__/", ".cache/", "coverage/", "out/", "target/")
GENERATED = (r"\.gen\.go$", r"\.generated\.(ts|js)$", r"\.min\.(js|css)$")
SOURCE_EXTENSIONS = ("go", "ts", "tsx", "js", "jsx", "py", "rs", "java", "c", "cpp", "h", "hpp", "cs", "swift", "kt", "rb", "php", "scala", "ex", "exs")
CONFIG_EXTENSIONS = ("json", "yaml", "yml", "toml", "ini", "cfg", "conf", "xml")
CONFIG_NAMES = (
    "Makefile", "Dockerfile", "Vagrantfile", ".gitignore", ".gitattributes", ".editorconfig", ".prettierrc", ".eslintrc", ".babelrc", "Gemfile", "Rakefile",
    "Procfile", "tsconfig.json", "package.json", "go.mod", "go.sum", "Cargo.toml", "Cargo.lock", "requirements.txt", "pyproject.toml", "setup.py", "setup.cfg",
)
DOC_EXTENSIONS = ("md", "rst", "txt", "adoc")
DOC_NAMES = r"(?i)^(README|CHANGELOG|LICENSE|CONTRIBUTING|AUTHORS|HISTORY)"
SENSITIVE = (
    r"(?i)\.env($|\.)", r"(?i)^credentials\..+$", r"(?i)^secrets?\..+$", r"(?i)^\.secrets?$", r"(?i)\.(key|pem|crt|p12)$", r"(?i)_rsa$", r"(?i)password",
    r"(?i)auth.*token", r"(?i)^\.htpasswd$", r"(?i)^\.netrc$", r"(?i)aws_access_key", r"(?i)gcp.*credentials", r"(?i)service.*account.*json",
)
NON_CODE = (r"\.md$", r"\.txt$", r"\.rst$", r"\.adoc$", r"LICENSE", r"CHANGELOG", r"\.gitignore$", r"\.editorconfig$")
CODE = r"\.(go|ts|tsx|js|jsx|py|java|rs|rb|c|cpp|h|hpp|cs|swift|kt)$"
REQUIREMENT = r"(?i)\b(REQ-\d+|R-\d+|REQUIREMENT-\d+)\b"
RISK = r"(?i)\b(?:R-?\d+|Risk\s*\d+)\b"
COMPLETE = r"(?i)\bStatus:\s*(Complete|Done|Finished)\b"
PARTIAL = r"(?i)\bStatus:\s*(Partial|In Progress|WIP)\b"
SUPPRESSION = r"(@ts-ignore|@ts-expect-error|eslint-disable|#\s*type:\s*ignore|#\s*noqa|#\s*pylint:\s*disable|#\s*pragma:\s*no\s*cover|#\s*nosec|//\s*nolint|@SuppressWarnings|#\s*rubocop:disable|@phpstan-ignore)"
EMPTY_CATCH = r"(except\b[^:]*:\s*pass\b|catch\s*(\([^)]*\))?\s*\{\s*\}|rescue\b[^;]*;\s*end\b)"
STUB = r"(?i)(panic\s*\(|raise\s+NotImplementedError|throw\s+new\s+Error\s*\(\s*[\"']not[ _]?implemented|\bTODO\b|\bFIXME\b)"
ASSERTION = r"(?i)(\bassert\b|expect\s*\(|\.should\b|\.to(Be|Equal|Throw|Contain|Match|HaveBeen)|t\.(Error|Fatal|Errorf|Fatalf)|require\.\w|XCTAssert|EXPECT_|ASSERT_)"
GRADES = ((90, "A"), (75, "B"), (60, "C"), (40, "D"))
CLASS_WEIGHTS = {"test_first": 100, "test_with": 75, "test_after": 25}


def any_match(column: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | column.rlike(p)
    return out


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased extension of the base name without the dot; empty without one."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def category_of_path(path: Column) -> Column:
    """test, generated, docs, config, source or other: the first rule that fits."""
    name, ext = base_name(path), extension(path)
    generated = any_match(path, GENERATED)
    for d in GENERATED_DIRS:
        generated = generated | path.startswith(d) | F.contains(path, F.lit("/" + d))
    return (
        F.when(any_match(name, TEST_PATHS), "test").when(generated, "generated").when(ext.isin(*DOC_EXTENSIONS) & ~name.isin(*CONFIG_NAMES) | name.rlike(DOC_NAMES), "docs")
        .when(name.isin(*CONFIG_NAMES) | ext.isin(*CONFIG_EXTENSIONS), "config").when(ext.isin(*SOURCE_EXTENSIONS), "source").otherwise("other")
    )


def sensitive_path(path: Column) -> Column:
    return any_match(base_name(path), SENSITIVE)


def categorise(paths: DataFrame, path: str = "path") -> DataFrame:
    """(category, n, sensitive) of a path table."""
    told = paths.select(category_of_path(F.col(path)).alias("category"), sensitive_path(F.col(path)).alias("s"))
    return told.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("s").alias("sensitive"))


def glob_regex(glob: str) -> str:
    """A glob as a regular expression: ** crosses directories, * and ? do not."""
    import re

    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"^{out}$"


def classify_tiers(items: DataFrame, exact: dict[str, str], globs: list[tuple[str, str]], keywords: list[tuple[str, str]], name: str = "name") -> DataFrame:
    """items with tier: an exact name, else the first glob, else the first keyword, else unassigned. Rules are a stated list."""
    c, out = F.col(name), None
    tests = [(c == k, v) for k, v in exact.items()] + [(c.rlike(glob_regex(g)), v) for g, v in globs] + [(F.contains(F.lower(c), F.lit(k.lower())), v) for k, v in keywords]
    for test, tier in tests:
        out = F.when(test, tier) if out is None else out.when(test, tier)
    return items.withColumn("tier", F.lit("unassigned") if out is None else out.otherwise("unassigned"))


def coverage(requirements: DataFrame, traces: DataFrame) -> DataFrame:
    """One row: total, covered, percent, from (id) and the ids that stories name."""
    ids = requirements.select("id").distinct()
    told = ids.join(traces.select(F.col("id").alias("t")).distinct(), F.col("id") == F.col("t"), "left")
    return told.agg(F.count(F.lit(1)).alias("total"), F.count("t").alias("covered"), F.when(F.count(F.lit(1)) > 0, F.count("t") * 100.0 / F.count(F.lit(1))).otherwise(0.0).alias("percent"))


def uncovered(requirements: DataFrame, traces: DataFrame) -> DataFrame:
    return requirements.select("id").distinct().join(traces.select("id").distinct(), "id", "left_anti")


def requirement_ids(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(REQUIREMENT), F.lit(0)), F.upper))


def risk_ids(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(RISK), F.lit(0)), lambda x: F.concat(F.lit("R-"), F.regexp_extract(x, r"\d+", 0))))


def alignment(requirements: DataFrame, stories: DataFrame) -> DataFrame:
    """One row: met, partial, unmet, creep, score. stories (file, id, status): the first story by file that sets a status decides."""
    first = stories.where("status is not null").groupBy(F.col("id").alias("s")).agg(F.min_by("status", "file").alias("status"))
    told = requirements.select("id").distinct().join(first, F.col("id") == F.col("s"), "left")
    sums = told.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "complete").alias("met"), F.count_if(F.col("status") == "partial").alias("partial"))
    creep = stories.select("id").distinct().join(requirements.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("creep"))
    score = F.when(F.col("total") > 0, (F.col("met") + 0.5 * F.col("partial")) * 100.0 / F.col("total")).otherwise(0.0)
    return sums.crossJoin(creep).select("total", "met", "partial", (F.col("total") - F.col("met") - F.col("partial")).alias("unmet"), "creep", score.alias("score"))


def risk_coverage(risks: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, covered_by): sources of (id, source) that name each risk."""
    seen = mentions.groupBy(F.col("id").alias("m")).agg(F.array_sort(F.collect_set("source")).alias("covered_by"))
    return risks.select("id").distinct().join(seen, F.col("id") == F.col("m"), "left").select("id", F.coalesce("covered_by", F.array().cast("array<string>")).alias("covered_by"))


def implementation_of(path: Column) -> Column:
    """The path that a test path tests, by its name."""
    p = F.regexp_replace(path, r"_test\.(go|py|rs|rb)$", ".$1")
    p = F.regexp_replace(p, r"\.(test|spec)\.(ts|tsx|js|jsx|rb)$", ".$2")
    p = F.regexp_replace(p, r"(^|/)test_([^/]*\.py)$", "$1$2")
    return F.regexp_replace(F.regexp_replace(p, r"_spec\.rb$", ".rb"), r"Test\.java$", ".java")


def commit_classes(commits: DataFrame) -> DataFrame:
    """(ord, class) of commits (ord, files): test_only, test_with, test_first, test_after, no_test or non_code; ord rises with time."""
    files = commits.select("ord", F.explode_outer("files").alias("path"))
    name = base_name(F.col("path"))
    files = files.withColumns({"test": F.coalesce(any_match(name, TEST_PATHS + MORE_TEST_PATHS), F.lit(False)), "skip": F.coalesce(any_match(name, NON_CODE), F.lit(True))})
    files = files.withColumn("code", F.coalesce(F.col("path").rlike(CODE), F.lit(False)) & ~F.col("test") & ~F.col("skip"))
    kinds = files.groupBy("ord").agg(F.bool_or("test").alias("test"), F.bool_or("code").alias("code"))
    tested = files.where("test").groupBy(implementation_of(base_name(F.col("path"))).alias("impl")).agg(F.min("ord").alias("first_test"))
    paired = files.where("code").join(tested, base_name(F.col("path")) == F.col("impl"), "left")
    order = paired.groupBy(F.col("ord").alias("o")).agg(F.min("first_test").alias("first_test"))
    label = (
        F.when(F.col("test") & ~F.col("code"), "test_only").when(F.col("test") & F.col("code"), "test_with").when(~F.col("code"), "non_code")
        .when(F.col("first_test") < F.col("ord"), "test_first").when(F.col("first_test") > F.col("ord"), "test_after").otherwise("no_test")
    )
    return kinds.join(order, F.col("ord") == F.col("o"), "left").select("ord", label.alias("class"))


def git_log(lines: DataFrame, line: str = "line", order: str = "line_no", doc: str = "doc") -> DataFrame:
    """(doc, ord, hash, author, date, message, files) of `hash|author|date|message` lines, each followed by the paths that it touches.

    The log has the newest commit first; ord rises with time, from 1 for the
    oldest. Blank lines are passed over; commits without paths have none.
    """
    head = r"^([0-9a-f]{7,40})\|([^|]*)\|([^|]*)\|(.*)$"
    w = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    told = lines.where(F.trim(line) != "").withColumn("_n", F.sum(F.col(line).rlike(head).cast("int")).over(w)).where("_n > 0")
    part = [F.max(F.when(F.col(line).rlike(head), F.regexp_extract(line, head, i))).alias(name) for i, name in enumerate(("hash", "author", "date", "message"), 1)]
    paths = F.array_sort(F.collect_list(F.when(~F.col(line).rlike(head), F.struct(F.col(order).alias("o"), F.trim(line).alias("p")))))
    each = told.groupBy(doc, "_n").agg(*part, paths.alias("_p"))
    oldest = F.max("_n").over(W.partitionBy(doc)) - F.col("_n") + 1
    return each.select(doc, oldest.alias("ord"), "hash", "author", "date", "message", F.transform("_p", lambda x: x["p"]).alias("files"))


def fan_out_summary(runs: DataFrame) -> DataFrame:
    """One row: agents, succeeded, failed, fell_back, longest_ms, total_ms of runs (agent, status, duration_ms, fallback_from)."""
    good = F.col("status") == "success"
    return runs.agg(
        F.count(F.lit(1)).alias("agents"), F.count_if(F.coalesce(good, F.lit(False))).alias("succeeded"), F.count_if(~F.coalesce(good, F.lit(False))).alias("failed"),
        F.count_if(F.coalesce("fallback_from", F.lit("")) != "").alias("fell_back"), F.max("duration_ms").alias("longest_ms"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_ms"),
    )


def reviewers_left(reviewers: Column, removed: Column) -> Column:
    """All but the removed, in the given order."""
    return F.filter(reviewers, lambda r: ~F.coalesce(F.array_contains(removed, r), F.lit(False)))


def tdd_score(classes: DataFrame) -> DataFrame:
    """One row: counts of classes, code commits, score and grade."""
    names = ("test_first", "test_with", "test_after", "test_only", "no_test", "non_code")
    sums = classes.agg(*[F.count_if(F.col("class") == n).alias(n) for n in names])
    code = sum((F.col(n) for n in ("test_first", "test_with", "test_after", "no_test")), F.lit(0))
    points = sum((F.col(n) * w for n, w in CLASS_WEIGHTS.items()), F.lit(0))
    out = sums.withColumn("code", code).withColumn("score", F.when(F.col("code") > 0, points / F.col("code")).otherwise(0.0))
    grade = F.lit("F")
    for least, name in reversed(GRADES):
        grade = F.when(F.col("score") >= least, name).otherwise(grade)
    return out.withColumn("grade", grade)


def diff_lines(diffs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, line_no, path, hunk, sign, line) of unified diffs: files and hunks are carried forward."""
    lines = diffs.select(doc, F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))
    w = W.partitionBy(doc).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    path = F.last(F.when(F.col("raw").rlike(r"^\+\+\+ "), F.regexp_extract("raw", r"^\+\+\+ (?:b/)?(\S+)", 1)), ignorenulls=True).over(w)
    hunk = F.sum(F.col("raw").startswith("@@").cast("int")).over(w)
    told = lines.withColumns({"path": path, "hunk": hunk})
    body = told.where(F.col("raw").rlike(r"^[+-]") & ~F.col("raw").rlike(r"^(\+\+\+|---) "))
    return body.select(doc, "line_no", "path", "hunk", F.substring("raw", 1, 1).alias("sign"), F.expr("substring(raw, 2)").alias("line"))


def diff_smells(lines: DataFrame) -> DataFrame:
    """(path, line_no, smell): suppressions, empty catches and stubs that are added, assertions that are removed from tests."""
    test = any_match(base_name(F.col("path")), TEST_PATHS + MORE_TEST_PATHS) | F.col("path").rlike(r"(^|/)(test|tests|spec|__tests__)/")
    added = F.col("sign") == "+"
    smells = F.array_compact(F.array(
        F.when(added & F.col("line").rlike(SUPPRESSION), "suppression"), F.when(added & F.col("line").rlike(EMPTY_CATCH), "empty_catch"),
        F.when(added & ~test & F.col("line").rlike(STUB), "stub_body"), F.when((F.col("sign") == "-") & test & F.col("line").rlike(ASSERTION), "weakened_assertion"),
    ))
    return lines.select("path", "line_no", F.explode(smells).alias("smell"))


def highest_version(names: DataFrame, pattern: str = r"^(\d+)\.(\d+)[-_]", name: str = "name") -> DataFrame:
    """One row: the name with the highest (major, minor), and the next version; a pattern with one group has no minor."""
    groups = pattern.count("(") - pattern.count("(?")
    major = F.regexp_extract(name, pattern, 1).try_cast("long")
    minor = F.regexp_extract(name, pattern, 2).try_cast("long") if groups > 1 else F.lit(0).cast("long")
    best = names.select(F.col(name), major.alias("major"), minor.alias("minor")).where("major is not null").agg(F.max(F.struct("major", "minor", name)).alias("x"))
    following = F.when(F.lit(groups > 1), F.concat_ws(".", F.col("x.major").cast("string"), (F.col("x.minor") + 1).cast("string"))).otherwise((F.col("x.major") + 1).cast("string"))
    return best.where("x is not null").select(F.col(f"x.{name}").alias("name"), F.col("x.major").alias("major"), F.col("x.minor").alias("minor"), following.alias("next"))


def conflict_edges(deps: DataFrame) -> DataFrame:
    """(a, b): items that share a dependency, from (item, dep), a < b, each pair once.

    All pairs are the result, so it grows with the square of the items of a
    dependency; frontier_colours needs none of them. Null items and null
    dependencies conflict with nothing; repeated rows count once.
    """
    x = deps.select(F.col("item").alias("a"), "dep").distinct()
    y = deps.select(F.col("item").alias("b"), "dep").distinct()
    return x.join(y, "dep").where("a < b").select("a", "b").distinct()


def conflict_groups(deps: DataFrame) -> DataFrame:
    """(dep, items, pairs, first): each dependency's items, the pairs of them that it sets against each other, and the least item.

    With deps as the membership this is the conflict graph, without a pair: an
    item conflicts with the others of its groups. Null items and null
    dependencies conflict with nothing; repeated rows count once.
    """
    members = deps.select("item", "dep").where("item is not null and dep is not null").distinct()
    return members.groupBy("dep").agg(F.count(F.lit(1)).alias("items"), F.min("item").alias("first")).select("dep", "items", F.expr("items * (items - 1) div 2").alias("pairs"), "first")


#: A visit of a token is a number: that of the item times VISIT, and the number of the item's dependencies.
VISIT = 1 << 31


def _coloured(schema, span: int):
    """Moves tokens as far as they get within their ranges of `span` items; rows come sorted by the number of the item that they wait for."""

    def told(colours, tokens):
        """A batch of rows: items with their colours, then tokens."""
        import numpy as np
        import pyarrow as pa

        slices = [t["visits"][t["at"] :] for t in tokens]
        ends = np.cumsum([0] * (len(colours) + 1) + [len(x) for x in slices], dtype="int32")
        rows = {
            "number": [n for n, _ in colours] + [int(x[0]) // VISIT if len(x) else None for x in slices],
            "colour": [c for _, c in colours] + [None] * len(tokens),
            "taken": [None] * len(colours) + [t["taken"].to_bytes((t["taken"].bit_length() + 7) // 8, "little") for t in tokens],
        } | {k: [None] * len(colours) + [t[k] for t in tokens] for k in ("dep", "base", "next")}
        ahead = schema.field("ahead").type
        values = pa.array(np.concatenate([np.empty(0, "int64"), *slices]), pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(ends), values, type=ahead)
        return pa.record_batch([lists if f.name == "ahead" else pa.array(rows[f.name], f.type) for f in schema], schema=schema)

    def run(batches):
        hand, now, colours, tokens = {}, 0, [], []

        def visited(number, held):
            """Colours an item if all its tokens are there, and sends them on."""
            if len(held) < int(held[0]["visits"][held[0]["at"]]) % VISIT:
                tokens.extend(held)
                return
            colour, above = max(t["base"] for t in held), 0
            for t in held:
                above |= t["taken"] >> (colour - t["base"])
            colour += (~above & (above + 1)).bit_length() - 1
            colours.append((number, colour))
            for t in held:
                taken = t["taken"] | 1 << (colour - t["base"])
                full = (~taken & (taken + 1)).bit_length() - 1
                t["base"], t["taken"], t["at"] = t["base"] + full, taken >> full, t["at"] + 1
                if t["at"] == len(t["visits"]):
                    if t["next"] is not None:
                        tokens.append(t)
                elif (following := int(t["visits"][t["at"]]) // VISIT) // span == number // span:
                    hand.setdefault(following, []).append(t)
                else:
                    tokens.append(t)

        for batch in batches:
            ahead, plain = batch.column("ahead"), batch.drop_columns(["ahead"])
            visits, ends = ahead.values.to_numpy(), ahead.offsets.to_pylist()
            for i, t in enumerate(plain.to_pylist()):
                while hand and now < t["number"]:
                    if now in hand:
                        visited(now, hand.pop(now))
                    now += 1
                now = t["number"]
                hand.setdefault(now, []).append(t | {"taken": int.from_bytes(t["taken"], "little"), "visits": visits[ends[i] : ends[i + 1]], "at": 0})
            if colours or tokens:
                yield told(colours, tokens)
                colours.clear()
                tokens.clear()
        while hand:
            if now in hand:
                visited(now, hand.pop(now))
            now += 1
        if colours or tokens:
            yield told(colours, tokens)

    return run


def frontier_colours(deps: DataFrame, block: int = 10_000, run: int = 48) -> DataFrame:
    """(item, colour): items of deps (item, dep) in order take the smallest colour that no earlier item with a dependency in common has.

    No pair of items is made. Each dependency is a token that visits its items
    in order and carries the colours that they took: all below `base`, and
    bits of those above in `taken`. An item that holds the tokens of all its
    dependencies takes its colour and sends them on. The items are dealt out
    in ranges of their order, one for each shuffle partition but none of less
    than `block` items. A range is one task, which goes through it once in
    order; a round ends when tokens must leave their ranges, or wait for those
    of others: they are dealt out again and written. So rounds are at most as
    many as ranges, and as the longest chain of items of differing ranges that
    wait for each other. A token brings the visits of a range along, and those
    of more until they are `run`; it fetches more between rounds.

    Null items are one item without dependencies; such items are of colour 0,
    as are those whose dependencies are all null. Repeated rows count once; an
    empty table gives none; other columns are ignored. An item's own
    dependencies are met in one task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    from loomstead.operators.ordering import running_before
    from loomstead.plans.staging import staged, unstage

    tasks = int(deps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as stated: ranges are few bytes for much work, and would be put together
    given = staged(deps.select("item", F.when(F.col("item").isNotNull(), F.col("dep")).alias("dep")).distinct(), "members")
    items = given.groupBy("item").agg(F.count("dep").cast("int").alias("need"))
    items = staged(running_before(items, [F.col("item")], F.lit(1), "number").select(F.col("item").alias("i"), "need", F.col("number").cast("long").alias("number")), "items")
    n = items.count()
    span = max(block, -(-n // tasks))
    ranges = max(1, -(-n // span))

    reached = given.where("dep is not null").join(items, F.col("item") == F.col("i")).select("dep", F.expr(f"number div {span}").alias("range"), (F.col("number") * VISIT + F.col("need")).alias("visit"))
    visits = staged(reached.groupBy("dep", "range").agg(F.count(F.lit(1)).alias("n"), F.collect_list("visit").alias("visits")), "visits")
    of = W.partitionBy("_d")  # a row for each range that the dependency lies in
    parts = visits.select(F.col("dep").alias("_d"), F.col("range").alias("_r"), "n").withColumn("place", F.coalesce(F.sum("n").over(of.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.select("_d", "_r", F.expr(f"place div {run}").alias("part")).withColumn("next", F.min("part").over(of.orderBy("part").rangeBetween(1, W.unboundedFollowing)))
    runs = visits.join(parts, (F.col("dep") == F.col("_d")) & (F.col("range") == F.col("_r")))
    runs = staged(runs.groupBy("dep", "part").agg(F.min("next").alias("next"), F.array_sort(F.flatten(F.collect_list("visits"))).alias("ahead")), "runs")
    unstage(given, visits)

    number = F.expr(f"get(ahead, 0) div {VISIT}").alias("number")
    rows = runs.where("part = 0").select(number, F.lit(None).cast("int").alias("colour"), "dep", F.lit(0).alias("base"), F.lit(b"").alias("taken"), "next", "ahead")
    columns, kinds = rows.columns, to_arrow_schema(rows.schema)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    colours = lambda tables: functools.reduce(DataFrame.unionByName, [x.where("colour is not null").select("number", "colour") for x in tables])
    done, rounds = [], []
    while True:
        dealt = rows.select(*columns).repartitionById(ranges, F.expr(f"int(number div {span})")).sortWithinPartitions("number")
        rounds.append(staged(dealt.mapInArrow(_coloured(kinds, span), schema), "tokens"))
        left = rounds[-1].where("colour is null")
        waiting, more = left.agg(F.count("number"), F.count_if(F.col("number").isNull())).first()
        if not waiting + more:
            unstage(runs)
            break
        if len(rounds) > 4:  # earlier ones serve for their colours alone
            found = staged(colours([*done, *rounds[:-1]]), "colours")
            unstage(*done, *rounds[:-1])
            done, rounds = [found], rounds[-1:]
        rows = left.where("number is not null")
        if more:
            fetched = left.where("number is null").select("colour", "dep", "base", "taken", F.col("next").alias("part")).join(runs, ["dep", "part"])
            rows = rows.unionByName(fetched.select(number, *columns[1:]))
    return items.join(colours([*done, *rounds]), "number", "left").select(F.col("i").alias("item"), F.when(F.col("need") == 0, 0).otherwise(F.col("colour")).alias("colour"))


def greedy_colours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(item, colour): items in order of name take the smallest colour that no earlier neighbour has.

    Rounds over the table: an item takes its colour when all its earlier
    neighbours have theirs, so the order is that of the sequential rule. Edges
    with a null end are no edges; null items are left out.
    """
    from loomstead.plans.staging import staged

    done = None
    waiting = nodes.select(F.col("item")).where("item is not null").distinct()
    before = edges.select(F.col("b").alias("item"), F.col("a").alias("early")).where("early is not null")
    while True:
        links = waiting.join(before, "item", "left")
        if done is not None:
            links = links.join(done.select(F.col("item").alias("early"), "colour"), "early", "left")
        else:
            links = links.withColumn("colour", F.lit(None).cast("int"))
        state = links.groupBy("item").agg(F.count_if(F.col("early").isNotNull() & F.col("colour").isNull()).alias("open"), F.collect_set("colour").alias("used"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used"))
        now = staged(state.where("open = 0").select("item", free.cast("int").alias("colour")), "colours")
        if now.isEmpty():
            return done if done is not None else now
        done = now if done is None else staged(done.unionByName(now), "colours")
        waiting = staged(waiting.join(now, "item", "left_anti"), "waiting")


def resolve_refs(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """refs (chunk_id, ref_type, ref_name) with ref_target_id: the least id of that name."""
    target = chunks.groupBy(F.col("name").alias("_n")).agg(F.min("id").alias("ref_target_id"))
    return refs.join(target, refs.ref_name == F.col("_n"), "left").drop("_n")


def callers(refs: DataFrame, target) -> DataFrame:
    return refs.where((F.col("ref_target_id") == target) & (F.col("ref_type") == "calls"))


def overlap_share(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Share of the first line range that the second covers."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1) / (e1 - s1 + 1)


def _greedy(threshold: float, columns: list[str]):
    """Greedy choice in one run of ranges, by score, then id and lines."""

    def run(rows):
        import numpy as np

        rows = rows.assign(_o=-rows["score"]).sort_values(["_o", "id", "start_line", "end_line"], na_position="last", kind="stable")
        start, end = (rows[c].to_numpy(dtype="float64", na_value=np.nan) for c in ("start_line", "end_line"))
        kept, n, chosen = np.empty((2, len(rows))), 0, []
        with np.errstate(all="ignore"):
            for i in range(len(rows)):
                over = np.maximum(0, np.minimum(end[i], kept[1, :n]) - np.maximum(start[i], kept[0, :n]) + 1)
                length = end[i] - start[i] + 1
                if length == 0 or not (over / length >= threshold).any():
                    kept[:, n] = start[i], end[i]
                    n += 1
                    chosen.append(i)
        return rows.iloc[chosen][columns]

    return run


def suppress_overlaps(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(file_path, id, start_line, end_line, score): greedy by score within a file; a row that a kept one covers to the threshold goes.

    Of equal ranges only the first by score can stay: it is kept and covers
    the others, or what covers it covers them. So a file's rows are first
    reduced to its distinct ranges, and these parted into runs between which no
    line is shared; only the ranges of a run are met in one task. A null score
    is the lowest, a null id the last; ranges without both lines stay.
    """
    columns = ["file_path", "id", "start_line", "end_line", "score"]
    rows = results.select(*columns)
    if not 0 < threshold <= 1:  # at 0 or less all but the first go, beyond 1 none
        return rows if threshold > 1 else rows.groupBy("file_path").applyInPandas(_greedy(threshold, columns), rows.schema)
    item = F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("o"), F.col("id").isNull().alias("unnamed"), "id", "start_line", "end_line", "score")
    plain = F.coalesce(F.col("end_line") >= F.col("start_line"), F.lit(False))
    tops = rows.where(plain).groupBy("file_path", "start_line", "end_line").agg(F.min(item).alias("k")).select("file_path", "k.id", "k.start_line", "k.end_line", "k.score")
    before = W.partitionBy("file_path").orderBy("start_line").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("start_line") > F.max("end_line").over(before), F.lit(True))
    runs = tops.withColumn("fresh", fresh.cast("long")).withColumn("run", F.sum("fresh").over(W.partitionBy("file_path").orderBy("start_line").rowsBetween(W.unboundedPreceding, W.currentRow)))
    found = runs.groupBy("file_path", "run").applyInPandas(_greedy(threshold, columns), rows.schema)
    return found.unionByName(rows.where(~plain))  # ranges without a line are covered by nothing
