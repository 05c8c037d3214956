"""Review findings: filter, route, dedupe, group, cross-tabulate, count, validate, render.

Finding rows have severity, file_line, problem, fix, category, est_minutes,
evidence, reviewer, source; README rows also group, checkbox, confidence, section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Severities by rank, states by marker, aliases of categories, frontend rules.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
STATES = {"[ ]": "open", "[/]": "deferred", "[x]": "resolved", "[X]": "resolved", "[-]": "unreproducible"}
CATEGORY_ALIASES = {"maintainancy": "maintainability", "maintainence": "maintainability", "perf": "performance", "documentation": "docs", "doc": "docs", "test": "testing", "tests": "testing"}
FRONTEND_EXTENSIONS = (".tsx", ".jsx", ".svelte", ".vue", ".html", ".css", ".scss")
FRONTEND_KEYWORDS = ("accessibility", "ux", "layout", "ui", "responsive", "visual", "css", "touch", "frontend")
FRONTEND_PY_KEYWORDS = ("ux", "accessibility", "layout", "ui")
#: Minutes under which a finding is a quick win, and from which it gets a file of its own.
QUICK, BACKLOG = 30, 2880
TOLERANCE, MIN_GROUP, PATH_DEPTH, ROOT_THEME = 3, 3, 2, "misc"


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for rank, name in enumerate(reversed(SEVERITIES), 1):
        out = F.when(F.upper(F.trim(severity)) == name, rank).otherwise(out)
    return out


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in reversed(SEVERITIES)]), rank.cast("int"))


def category_name(category: Column) -> Column:
    low = F.lower(F.trim(category))
    pairs = F.create_map(*[F.lit(x) for kv in CATEGORY_ALIASES.items() for x in kv])
    return F.coalesce(pairs[low], low)


def file_of(file_line: Column) -> Column:
    """The file part of `path:line` notations."""
    return F.substring_index(F.trim(file_line), ":", 1)


def line_of(file_line: Column) -> Column:
    """The first line number after the path; null without one."""
    return F.regexp_extract(file_line, r":(\d+)", 1).try_cast("int")


def state_of(checkbox: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return pairs[F.trim(checkbox)]


def filter_findings(rows: DataFrame, mode: str = "all", severity: list[str] | None = None, confidence: list[str] | None = None, group: str | None = None, focus: str | None = None, most: int = 10, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(kept, counts): open rows that pass every stage, the first `most` by order; and one row of exclusions by stage.

    Stages: section focus, open box, duration (`quick`: under QUICK, `backlog`:
    from there to BACKLOG), group, severity, confidence. The exclusions and
    kept rows add up to all rows.
    """
    est = F.col("est_minutes")
    stages: dict[str, Column] = {
        "focus": F.lit(True) if not focus else F.contains(F.lower("section"), F.lit(focus.lower())),
        "unchecked": state_of(F.col("checkbox")) == "open",
        "duration": {"quick": est < QUICK, "backlog": (est >= QUICK) & (est < BACKLOG)}.get(mode, F.lit(True)),
        "group": F.lit(True) if group is None else F.col("group") == group,
        "severity": F.lit(True) if not severity else F.upper("severity").isin(*[s.upper() for s in severity]),
        "confidence": F.lit(True) if not confidence else F.upper("confidence").isin(*[c.upper() for c in confidence]),
    }
    passed, counts = F.lit(True), []
    for name, test in stages.items():
        here = F.coalesce(test, F.lit(False))
        counts.append(F.count_if(passed & ~here).alias(f"out_{name}"))
        passed = passed & here
    kept = rows.where(passed)
    ordered = kept.orderBy(order)
    return (ordered.limit(most) if most > 0 else ordered), rows.agg(F.count(F.lit(1)).alias("total"), *counts, F.count_if(passed).alias("eligible"))


def write_scope(rows: DataFrame) -> DataFrame:
    """(group, files): the files that a group's findings name."""
    return rows.groupBy("group").agg(F.array_sort(F.collect_set(file_of(F.col("file_line")))).alias("files"))


def route(rows: DataFrame, quick: float = QUICK, backlog: float = BACKLOG, est: str = "est_minutes") -> DataFrame:
    """rows with route and route_error: quick_wins, backlog or td_files; what is no number goes to the backlog with an error."""
    minutes = F.col(est).cast("string").try_cast("double")
    return rows.withColumns({
        "route": F.when(minutes.isNull(), "backlog").when(minutes < quick, "quick_wins").when(minutes < backlog, "backlog").otherwise("td_files"),
        "route_error": F.when(minutes.isNull(), F.concat(F.lit("unparseable minutes: "), F.coalesce(F.col(est).cast("string"), F.lit("null")))),
    })


def clustered(rows: DataFrame, tolerance: int = TOLERANCE, file: str = "file", line: str = "line") -> DataFrame:
    """rows with cluster: within a file a new one starts where the gap to the line before exceeds the tolerance; rows without a line are cluster -1.

    Gaps are looked for among a file's distinct lines, so that a file that
    most rows name puts no more in one task than it has lines.
    """
    if tolerance < 0:
        raise ValueError("the tolerance must not be negative")
    lines = rows.where(F.col(line).isNotNull()).select(F.col(file).alias("_f"), F.col(line).alias("_l")).distinct()
    w = W.partitionBy("_f").orderBy("_l")
    gap = F.when(F.col("_l") - F.lag("_l").over(w) <= tolerance, 0).otherwise(1)
    numbered = lines.withColumn("_gap", gap).withColumn("_c", F.sum("_gap").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - 1).drop("_gap")
    joined = rows.join(numbered, F.col(file).eqNullSafe(F.col("_f")) & (F.col(line) == F.col("_l")), "left")
    return joined.withColumn("cluster", F.coalesce("_c", F.lit(-1)).cast("long")).drop("_f", "_l", "_c")


def _longest(text: str) -> Column:
    """The longest text as a struct that orders itself: by length, then by first place."""
    return F.max(F.when(F.col(text).isNotNull(), F.struct(F.length(text).alias("n"), (-F.col("ord")).alias("o"), F.col(text).alias("x"))))


def dedupe(rows: DataFrame, tolerance: int = TOLERANCE, untrusted: list[str] | None = None) -> DataFrame:
    """One row for each cluster of rows (ord, severity, file_line, problem, fix, category, est_minutes, reviewer).

    Severity is the highest, and disputed if the lowest differs; the category
    the commonest (first seen among equals); texts the longest; minutes the
    most; reviewers as first seen. Confidence is HIGH with two trusted
    reviewers, MEDIUM with one, LOW without. Rows are merged by reviewer and
    category first, so what is gathered of a cluster are its reviewers.
    """
    untrusted = untrusted or []
    named = rows.withColumns({"file": file_of(F.col("file_line")), "line": line_of(F.col("file_line")), "rank": severity_rank(F.col("severity")), "cat": category_name(F.col("category"))})
    whole = [F.min("line").alias("line"), F.max("top").alias("top"), F.min("low").alias("low"), F.max("problem").alias("problem"), F.max("fix").alias("fix"), F.max("est_minutes").alias("est_minutes")]
    voices = clustered(named, tolerance).groupBy("file", "cluster", "cat", "reviewer").agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.min("line").alias("line"), F.max("rank").alias("top"), F.min("rank").alias("low"),
        _longest("problem").alias("problem"), _longest("fix").alias("fix"), F.max("est_minutes").alias("est_minutes"),
    )
    votes = voices.groupBy("file", "cluster", "cat").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.collect_list(F.struct("first", "reviewer")).alias("seen"), *whole)
    merged = votes.groupBy("file", "cluster").agg(
        F.sum("n").alias("merged"), F.max_by("cat", F.when(F.col("cat").isNotNull(), F.struct("n", -F.col("first")))).alias("category"), F.flatten(F.collect_list("seen")).alias("seen"), *whole
    )
    reviewers = F.array_distinct(F.transform(F.array_sort("seen"), lambda x: x["reviewer"]))
    trusted = F.size(F.array_except("reviewers", F.array(*[F.lit(u) for u in untrusted]).cast("array<string>")))
    return merged.withColumn("reviewers", F.array_compact(reviewers)).select(
        "file", "line", "merged", F.when(F.col("top") > 0, severity_name(F.greatest(F.lit(1), "top"))).alias("severity"), (F.col("top") != F.col("low")).alias("needs_review"), "category",
        F.col("problem.x").alias("problem"), F.col("fix.x").alias("fix"), "est_minutes", "reviewers", F.when(trusted >= 2, "HIGH").when(trusted == 1, "MEDIUM").otherwise("LOW").alias("confidence"),
    )


def dedupe_accounts(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: rows read, clusters, rows that clusters were merged from, and whether these account for all rows."""
    n = rows.agg(F.count(F.lit(1)).alias("rows"))
    m = merged.agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("merged"), F.lit(0)).alias("merged"))
    return n.crossJoin(F.broadcast(m)).withColumn("balanced", F.col("rows") == F.col("merged"))


def theme_of(file_line: Column, depth: int = PATH_DEPTH) -> Column:
    """The first `depth` directories of a path, joined by a dash; ROOT_THEME for files at the root."""
    dirs = F.filter(F.split(file_of(file_line), "/"), lambda x: (x != "") & (x != "."))
    return F.when(F.size(dirs) <= 1, ROOT_THEME).otherwise(F.array_join(F.slice(dirs, 1, F.least(F.lit(depth), F.size(dirs) - 1)), "-"))


def frontend_item(file_line: Column, category: Column) -> Column:
    path, cat = F.lower(file_of(file_line)), F.lower(F.coalesce(category, F.lit("")))
    ext = path.rlike("(" + "|".join(e.replace(".", r"\.") for e in FRONTEND_EXTENSIONS) + ")$")
    words = cat.rlike("(" + "|".join(FRONTEND_KEYWORDS) + ")")
    return ext | path.endswith(".py") & cat.rlike("(" + "|".join(FRONTEND_PY_KEYWORDS) + ")") | words


def group_findings(rows: DataFrame, theme: Column | None = None, min_size: int = MIN_GROUP, critical_override: bool = True) -> DataFrame:
    """rows with theme, grouped and group_name.

    CRITICAL rows form a group of their own; themes of min_size rows are
    groups; of the rest HIGH (and CRITICAL) rows are `solo`, others ungrouped.
    """
    rank = severity_rank(F.col("severity"))
    themed = rows.withColumn("theme", theme if theme is not None else theme_of(F.col("file_line")))
    critical = (rank == 4) & F.lit(critical_override)
    sizes = themed.where(~critical).groupBy(F.col("theme").alias("_t")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_size)  # large themes only
    name = F.when(critical, "critical").when(F.col("_n").isNotNull(), F.concat(F.lit("theme:"), F.col("theme"))).when(rank >= 3, "solo")
    joined = themed.join(sizes, themed["theme"] == F.col("_t"), "left")
    return joined.withColumn("group_name", name).withColumn("grouped", F.col("group_name").isNotNull()).drop("_t", "_n")


def group_summary(grouped: DataFrame) -> DataFrame:
    """(number, group_name, n, minutes, frontend) of each group: solo is 0, then critical, then themes by name."""
    each = grouped.where("grouped").groupBy("group_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("est_minutes"), F.lit(0))).alias("minutes"), F.bool_or(frontend_item(F.col("file_line"), F.col("category"))).alias("frontend")
    )
    order = F.when(F.col("group_name") == "solo", 0).when(F.col("group_name") == "critical", 1).otherwise(2)
    place = F.row_number().over(W.orderBy(order, "group_name"))
    solo = F.max(F.when(F.col("group_name") == "solo", 1).otherwise(0)).over(W.partitionBy())
    return each.withColumn("number", (place - solo).cast("long")).select("number", "group_name", "n", "minutes", "frontend")


def active_groups(rows: DataFrame) -> DataFrame:
    """One row: the highest number among groups that have an open row; 0 without any. Groups that are no numbers count nothing."""
    number = F.col("group").try_cast("int")
    return rows.where((state_of(F.col("checkbox")) == "open") & (number > 0)).agg(F.coalesce(F.max(number), F.lit(0)).alias("highest"))


def renumber_groups(rows: DataFrame, order: str = "line_no", section: str = "section", doc: str = "doc") -> DataFrame:
    """rows with new_group: groups with an open row are numbered from 1 by section and first open row of their document; others keep theirs.

    A section is told by the place of its heading. What is put in order are a
    document's groups, not its rows. Doing it again changes nothing.
    """
    number = F.col("group").try_cast("int")
    opened = rows.where((state_of(F.col("checkbox")) == "open") & (number > 0))
    firsts = opened.groupBy(F.col(doc).alias("_d"), F.col(section).alias("_s"), F.col("group").alias("_g")).agg(F.min(order).alias("_first"))
    place = F.row_number().over(W.partitionBy("_d").orderBy("_s", "_first", "_g")).cast("string")
    told = firsts.select("_d", "_s", "_g", place.alias("_new"))
    joined = rows.join(told, F.col(doc).eqNullSafe(F.col("_d")) & F.col(section).eqNullSafe(F.col("_s")) & (F.col("group") == F.col("_g")), "left")
    return joined.withColumn("new_group", F.coalesce("_new", "group")).drop("_d", "_s", "_g", "_new")


def severity_by_state(rows: DataFrame) -> DataFrame:
    """(severity, open, deferred, resolved, unreproducible): counts; the four severities are always there."""
    names = list(dict.fromkeys(STATES.values()))
    sums = rows.groupBy(F.upper("severity").alias("severity")).agg(*[F.count_if(state_of(F.col("checkbox")) == s).alias(s) for s in names])
    frame = rows.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return sums.join(F.broadcast(frame).withColumn("_std", F.lit(1)), "severity", "full").select("severity", *[F.coalesce(s, F.lit(0)).alias(s) for s in names])


def group_by_severity(rows: DataFrame) -> DataFrame:
    """(grp, severity, n) of open rows with margins: null-free, `TOTAL` marks a margin."""
    named = rows.where(state_of(F.col("checkbox")) == "open").select(F.coalesce("group", F.lit("")).alias("g"), F.coalesce(F.upper("severity"), F.lit("")).alias("s"))
    out = named.cube("g", "s").agg(F.count(F.lit(1)).alias("n"), F.grouping("g").alias("g1"), F.grouping("s").alias("s1"))
    return out.select(F.when(F.col("g1") == 1, "TOTAL").otherwise(F.col("g")).alias("grp"), F.when(F.col("s1") == 1, "TOTAL").otherwise(F.col("s")).alias("severity"), "n")


def validate_findings(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows with status: valid, missing (no such file) or unparseable (no path); files has path."""
    path = file_of(F.col("file_line"))
    known = files.select(F.col("path").alias("_p")).distinct()
    out = rows.join(known, path == known["_p"], "left")
    return out.withColumn("status", F.when(F.coalesce(path, F.lit("")) == "", "unparseable").when(F.col("_p").isNull(), "missing").otherwise("valid")).drop("_p")


def markdown_rows(rows: DataFrame, columns: list[str], checkbox: bool = False) -> DataFrame:
    """(line) of a markdown table's body; pipes and line ends in cells are escaped."""
    cells = [F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|"), "[\r\n]+", " ") for c in columns]
    if checkbox:
        cells = [F.lit("[ ]"), *cells]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def clean_readme(lines: DataFrame, doc: str = "doc", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """lines without resolved table rows and without sections that this empties.

    A section is a `##` heading and what follows; one that had rows and keeps
    none is dropped.
    """
    w = W.partitionBy(doc).orderBy(line_no).rowsBetween(W.unboundedPreceding, W.currentRow)
    row = F.col(line).rlike(r"^\s*\|") & ~F.col(line).rlike(r"^\s*\|[\s:|-]+\|\s*$")
    item = row & F.col(line).rlike(r"\[[ xX/-]\]")
    done = row & F.col(line).rlike(r"\|\s*\[[xX]\]\s*\|")
    told = lines.withColumns({"_section": F.sum(F.col(line).rlike(r"^##\s").cast("int")).over(w), "_item": item, "_done": done})
    s = W.partitionBy(doc, "_section")
    emptied = (F.max(F.col("_item").cast("int")).over(s) == 1) & (F.max((F.col("_item") & ~F.col("_done")).cast("int")).over(s) == 0) & (F.col("_section") > 0)
    return told.withColumn("_gone", F.col("_done") | emptied).where(~F.col("_gone")).drop("_section", "_item", "_done", "_gone")
