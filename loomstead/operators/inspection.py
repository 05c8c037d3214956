"""Inspection: project markers, sprint status, plans, git status, references in findings and documents, knowledge audits, text diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstead.functions.line_diff import line_hunks

# Marker files in the order that decides, abbreviations of keys, schema of knowledge entries, patterns.
STACKS = (
    ("tsconfig.json", "node", "typescript"), ("package.json", "node", "javascript"), ("pyproject.toml", "python", "python"), ("setup.py", "python", "python"), ("requirements.txt", "python", "python"), ("Pipfile", "python", "python"),
    ("go.mod", "go", "go"), ("go.sum", "go", "go"), ("Cargo.toml", "rust", "rust"), ("pom.xml", "java", "java"), ("build.gradle", "java", "java"), ("Gemfile", "ruby", "ruby"), ("composer.json", "php", "php"),
)
PACKAGE_MANAGERS = (
    ("yarn.lock", "yarn"), ("pnpm-lock.yaml", "pnpm"), ("package-lock.json", "npm"), ("poetry.lock", "poetry"), ("Pipfile.lock", "pipenv"), ("requirements.txt", "pip"), ("go.sum", "go"), ("Cargo.lock", "cargo"), ("Gemfile.lock", "bundler"), ("composer.lock", "composer"),
)
FRAMEWORKS = (
    ("next.config.js", "nextjs"), ("next.config.mjs", "nextjs"), ("next.config.ts", "nextjs"), ("remix.config.js", "remix"), ("nuxt.config.js", "nuxt"), ("nuxt.config.ts", "nuxt"), ("angular.json", "angular"), ("svelte.config.js", "sveltekit"),
)
KEYS = {
    "file": "f", "line": "l", "name": "n", "type": "t", "question": "q", "answer": "a", "occurrences": "o", "directories": "dirs", "path": "p", "message": "msg", "status": "s", "value": "v", "key": "k", "result": "r", "error": "err", "success": "ok", "files": "fs", "matches": "m",
}
CANONICAL_KEYS = ("id", "question", "created", "last_retrieved", "sprints", "files", "tags", "retrievals", "status", "type")
SOFT_KEYS, KEY_ALIASES = ("question", "tags"), {"date": "created"}
PLACEHOLDER = r"\[(from context|conditions|Example code|conditions\.\.\.)\]"
IDENTIFIERS = (r"\b[a-z]+(?:[A-Z][a-zA-Z0-9]+)+\b", r"\b[A-Z][a-z0-9]+(?:[A-Z][a-zA-Z0-9]+)+\b", r"\b[a-z0-9]+(?:_[a-z0-9]+)+\b", r"\b[a-zA-Z0-9_]+(?:[./][a-zA-Z0-9_]+)+\b")
STOP_WORDS = """the and or but for with via into onto not none add adds added verify verifies test tests testing cover covers covered file files line lines row rows note fix fixes problem this that value values field fields path paths code case cases change
before after future later phase plan planned deferred resolve resolved against instead within across check checks skip skips use uses used one two set sets map maps make call calls return returns present absent lowercase word column columns confirm helper resolver""".split()
PUNTS = ("owned by", "backend decision", "architecture decision", "blocked on", "no production change", "no code change", "won't fix", "wont fix", "won’t fix", "deferred", "defer to", "future sprint", "leave permissive")
BOILERPLATE = (r"\((?i:Deferred|Planned|intent_note|Clarified|Won't fix|Won’t fix|Wont fix|Accepted|Resolved|NOTE)[^)]*\)", r"\[(?i:Clarified|Resolved|Deferred)[^\]]*\]")
FILE_EXTENSIONS = "ts tsx js jsx mjs py go rs java kt md json toml yaml yml css scss html vue svelte sql sh bash zsh c cpp h hpp rb php swift".split()
ACTIONS = {"create": r"(?:[Cc]reate|[Nn]ew\s+file[:\s]|[Aa]dd)", "modify": r"(?:[Mm]odify|[Uu]pdate|[Ee]dit|[Cc]hange)", "read": r"(?:[Rr]ead|[Rr]eference|[Ss]ee)"}
NAMED_FILE = r"\s+(?:[`\"'](?=[^`\"'\n]+[`\"']))?((?<=[`\"'])[^`\"'\n]+\.[a-zA-Z]{1,10}(?=[`\"'])|[\w./-]+\.[a-zA-Z]{1,10})"


def _first(names: Column, rules: tuple[tuple[str, ...], ...], at: int) -> Column:
    return F.coalesce(*[F.when(F.array_contains(names, r[0]), F.lit(r[at])) for r in rules])


def detect_projects(files: DataFrame) -> DataFrame:
    """(dir, stack, language, package_manager, framework) of every directory with a marker file; the first marker of the list decides."""
    markers = sorted({r[0] for rules in (STACKS, PACKAGE_MANAGERS, FRAMEWORKS) for r in rules})
    name = F.substring_index("path", "/", -1)
    each = files.where(name.isin(*markers)).groupBy(F.regexp_replace("path", r"/?[^/]*$", "").alias("dir")).agg(F.collect_set(name).alias("names"))
    n = F.col("names")
    return each.select("dir", _first(n, STACKS, 1).alias("stack"), _first(n, STACKS, 2).alias("language"), _first(n, PACKAGE_MANAGERS, 1).alias("package_manager"), _first(n, FRAMEWORKS, 1).alias("framework"))


def sprint_status(rows: DataFrame, completed: float = 0.95, partial: float = 0.5, coverage_min: float = 0.0) -> DataFrame:
    """rows (completion, tests_passed, coverage, critical) with status and reasons: blocking conditions fail, then completion decides."""
    ratio, cover = F.col("completion") / 100.0, F.col("coverage")
    failed_tests, critical, thin, short = ~F.col("tests_passed"), F.col("critical") > 0, (cover > 0) & (cover < coverage_min), ratio < partial
    reasons = F.array_compact(F.array(
        F.when(failed_tests, "Tests failed"), F.when(critical, F.concat(F.lit("Critical issues: "), F.col("critical").cast("string"))),
        F.when(thin, F.format_string(f"Coverage %.1f%% below minimum {coverage_min:.1f}%%", cover.cast("double"))), F.when(short, F.format_string(f"Completion %.1f%% below partial threshold {partial * 100:.0f}%%", F.col("completion").cast("double"))),
    ))
    status = F.when(failed_tests | critical | thin | short, "FAILED").when(ratio >= completed, "COMPLETED").otherwise("PARTIAL")
    more = F.when(F.col("status") == "PARTIAL", F.array_append("reasons", F.format_string(f"Completion %.1f%% below completed threshold {completed * 100:.0f}%%", F.col("completion").cast("double")))).otherwise(F.col("reasons"))
    return rows.withColumns({"status": status, "reasons": reasons}).withColumn("reasons", more)


def plan_types(files: DataFrame) -> DataFrame:
    """(dir, plan_type) from the `Plan Type:` field of metadata.md, else plan.md; `feature` without one."""
    name = F.substring_index("path", "/", -1)
    told = F.lower(F.regexp_extract("text", r"(?im)^\W*Plan Type\W*:\W*([\w-]+)", 1))
    rows = files.where(name.isin("metadata.md", "plan.md")).select(F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), name.alias("name"), F.when(told != "", told).alias("told"))
    return rows.groupBy("dir").agg(F.coalesce(F.min_by("told", F.when(F.col("told").isNotNull(), F.col("name"))), F.lit("feature")).alias("plan_type"))


def git_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """(status, path, staged, untracked) of porcelain lines; a rename has its new path."""
    state, path = F.substring(line, 1, 2), F.trim(F.expr(f"substring({line}, 4)"))
    path = F.when(F.contains(path, F.lit(" -> ")), F.trim(F.substring_index(path, " -> ", -1))).otherwise(path)
    out = lines.where(F.length(line) >= 4).select(F.trim(state).alias("status"), path.alias("path"), (~F.substring(line, 1, 1).isin(" ", "?")).alias("staged"), (state == "??").alias("untracked"))
    return out.where("path <> ''")


def git_remotes(lines: DataFrame, line: str = "line") -> DataFrame:
    """(name, url) of `name<tab>url (fetch)` lines, each once."""
    pattern = r"^(\S+)\s+(\S+)\s+\(fetch\)$"
    return lines.where(F.col(line).rlike(pattern)).select(F.regexp_extract(line, pattern, 1).alias("name"), F.regexp_extract(line, pattern, 2).alias("url")).distinct()


def repaired(keys: Column) -> Column:
    """An entry's keys (map) with aliases renamed, unknown keys dropped and canonical ones added empty; a name that is there stands before its alias."""
    def value(k: str) -> Column:
        names = [k, *[a for a, c in KEY_ALIASES.items() if c == k]]
        return F.coalesce(*[F.try_element_at(keys, F.lit(n)) for n in names], F.lit(""))

    return F.map_from_arrays(F.array(*[F.lit(k) for k in CANONICAL_KEYS]), F.array(*[value(k) for k in CANONICAL_KEYS]))


def group_order(group: Column) -> list[Column]:
    """Sort keys of group names: numbers by value, then the others by name."""
    number = group.try_cast("int")
    return [number.asc_nulls_last(), group.asc()]


def violations_in_order(rows: DataFrame) -> DataFrame:
    """rows (severity, date) with errors first, then the newest."""
    return rows.orderBy(F.when(F.lower("severity") == "error", 0).otherwise(1), F.desc("date"))


def report(title: str, rows: DataFrame) -> DataFrame:
    """(place, line) of a markdown report: a title, and a table of a result's rows in their order; places rise by one. The result is a report's: it is numbered in one task."""
    head = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    top = rows.sparkSession.createDataFrame(list(enumerate(head)), "place long, line string")
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])
    told = rows.select(F.monotonically_increasing_id().alias("_at"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    body = told.select((F.row_number().over(W.orderBy("_at")) + len(head) - 1).cast("long").alias("place"), "line")
    return top.unionByName(body)


def parse_file_line(raw: Column) -> Column:
    """struct(path, symbol, line_from, line_to) of path, path:line, path:from-to, path:symbol and multi-file notations."""
    s = F.trim(raw)
    before = F.regexp_extract(s, r"^([^:]*?) [/;] ", 1)
    s = F.when(before != "", before).otherwise(s)
    s = F.trim(F.regexp_replace(s, r"(?<=\S) \(.*$", ""))
    path, rest = F.substring_index(s, ":", 1), F.trim(F.regexp_extract(s, r"^[^:]*:(.*)$", 1))
    span = r"^L?(\d+)(?:\s*[-–,]\s*L?(\d+))?"
    low = F.regexp_extract(rest, span, 1).try_cast("int")
    symbol = F.when(low.isNull() & (rest != ""), F.trim(F.substring_index(rest, " / ", 1)))
    return F.when(s != "", F.struct(path.alias("path"), symbol.alias("symbol"), low.alias("line_from"), F.coalesce(F.regexp_extract(rest, span, 2).try_cast("int"), low).alias("line_to")))


def strip_boilerplate(text: Column) -> Column:
    for p in BOILERPLATE:
        text = F.regexp_replace(text, p, "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def code_identifiers(text: Column) -> Column:
    """Distinct code-shaped tokens in lower case: backticked, camel, Pascal, snake and dotted ones of three letters, without prose words."""
    quoted = F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1))
    found = F.concat(quoted, F.flatten(F.transform(quoted, lambda x: F.split(x, r"[ (),]+"))), *[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in IDENTIFIERS])
    clean = F.transform(found, lambda x: F.regexp_replace(F.lower(x), r"^[ .,;:()\[\]{}`]+|[ .,;:()\[\]{}`]+$", ""))
    return F.array_sort(F.array_except(F.filter(clean, lambda x: F.length(x) >= 3), F.array(*[F.lit(w) for w in STOP_WORDS])))


def is_punt(fix: Column) -> Column:
    """Whether a fix defers instead of prescribing."""
    low, out = F.lower(fix), F.lit(False)
    for p in PUNTS:
        out = out | F.contains(low, F.lit(p))
    return out


def grounding(problem: Column, fix: Column) -> Column:
    """Share of a fix's identifiers that its problem does not name; null without any."""
    a, b = code_identifiers(strip_boilerplate(problem)), code_identifiers(strip_boilerplate(fix))
    return F.when(F.size(b) > 0, F.size(F.array_except(b, a)) / F.size(b))


def named_files(found: Column) -> Column:
    """The distinct names among what was found that are of a file: 3 to 200 characters and a known extension."""
    return F.array_distinct(F.filter(found, lambda x: F.length(x).between(3, 200) & F.substring_index(x, ".", -1).isin(*FILE_EXTENSIONS)))


def document_dependencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with files_create, files_modify, files_read, directories, total and confidence: creation beats modification, which beats reading."""
    t = F.coalesce(F.col(text), F.lit(""))
    create, modify, read = (named_files(F.regexp_extract_all(t, F.lit(ACTIONS[a] + NAMED_FILE), F.lit(1))) for a in ("create", "modify", "read"))
    quoted = F.array_except(F.array_except(named_files(F.regexp_extract_all(t, F.lit(r"`([^`\n]+\.[a-zA-Z]{1,10})`"), F.lit(1))), create), read)
    out = docs.withColumns({
        "files_create": F.array_sort(create), "files_modify": F.array_sort(F.array_except(F.array_union(modify, quoted), create)), "_read": read,
        "directories": F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?:^|[\s'\"(])([a-zA-Z0-9_\-./]+/)(?=[\s'\")]|$)"), F.lit(1)))),
    })
    out = out.withColumn("files_read", F.array_sort(F.array_except(F.array_except("_read", "files_create"), "files_modify"))).drop("_read")
    total = F.size("files_create") + F.size("files_modify") + F.size("files_read")
    return out.withColumns({"total": total, "confidence": F.when(total >= 3, "high").when(total >= 1, "medium").otherwise("low")})


def audit_entries(entries: DataFrame) -> DataFrame:
    """entries (id, keys map, body) with missing, unknown, needs_input and placeholders: conformance to the canonical keys."""
    keys = F.coalesce(F.map_keys("keys"), F.array().cast("array<string>"))
    renamed = F.transform(keys, lambda k: F.when(k == "date", "created").otherwise(k))
    canon = F.array(*[F.lit(k) for k in CANONICAL_KEYS])
    soft = F.filter(F.array(*[F.lit(k) for k in SOFT_KEYS]), lambda k: F.coalesce(F.trim(F.try_element_at(F.col("keys"), k)), F.lit("")).isin("", "[]"))
    return entries.withColumns({"missing": F.array_except(canon, renamed), "unknown": F.array_except(renamed, canon), "needs_input": soft, "placeholders": F.regexp_count("body", F.lit(PLACEHOLDER))})


def minimal(df: DataFrame) -> DataFrame:
    """df with abbreviated column names."""
    return df.select(*[F.col(c).alias(KEYS.get(c, c)) for c in df.columns])


def minimal_json(df: DataFrame) -> DataFrame:
    return minimal(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("json"))


def fetch_outcome(status: Column, body: Column, error: Column) -> Column:
    """ok, challenge, blocked or terminal, from a response."""
    challenge = F.lower(body).rlike("just a moment|cf-chl|challenge-platform|verify you are human")
    return (
        F.when(error.isNotNull(), "blocked").when(status.between(200, 299), F.when(challenge, "challenge").otherwise("ok")).when(challenge & status.isin(403, 503, 429), "challenge")
        .when(status.isin(403, 429) | (status >= 500), "blocked").otherwise("terminal")
    )


def line_diff(old: Column, new: Column) -> Column:
    """struct(added, removed, same): lines that a shortest edit script adds and removes between two texts (see functions.line_diff)."""
    told = line_hunks(F.col(old) if isinstance(old, str) else old, F.col(new) if isinstance(new, str) else new)
    of = lambda part: F.aggregate(F.transform(told, lambda h: F.size(h[part]).cast("long")), F.lit(0).cast("long"), lambda n, x: n + x)
    same = (F.col(old) if isinstance(old, str) else old).eqNullSafe(F.col(new) if isinstance(new, str) else new)
    return F.struct(of("added").alias("added"), of("removed").alias("removed"), same.alias("same"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def index_memory(chunks: Column, dims: int) -> Column:
    """Bytes that an index of so many chunks takes."""
    return chunks * (700 + 4 * dims)
