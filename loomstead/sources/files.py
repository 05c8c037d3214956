"""The file system as a relation: lists, trees, sizes, search and grep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstead.functions.text import DEFINITIONS
from loomstead.operators.ordering import running_before
from loomstead.operators.reports import base_name, extension, glob_regex

EXCLUDED_DIRS = ("vendor", "node_modules", ".git")


def scan(spark: SparkSession, root: str, glob: str | None = None, content: bool = False) -> DataFrame:
    """(path, modified, size[, content]) of the files under root; contents are only read if asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    out = reader.load(root).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    return out if content else out.drop("content")


def text_files(files: DataFrame) -> DataFrame:
    """Files without a zero byte, as (path, text)."""
    return files.where(F.position(F.lit(b"\x00"), F.col("content")) == 0).select("path", F.col("content").cast("string").alias("text"))


def globbed(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, excluded_dirs: tuple[str, ...] = EXCLUDED_DIRS, hidden: bool = False, path: str = "path") -> DataFrame:
    """Files that an include glob fits and no exclude glob or directory: globs with a slash or ** see the path, others the base name."""

    def fits(globs: list[str]) -> Column:
        out = F.lit(False)
        for g in globs:
            out = out | (F.col(path) if "/" in g or "**" in g else base_name(F.col(path))).rlike(glob_regex(g))
        return out

    parts = F.split(path, "/")
    keep = ~F.exists(parts, lambda x: x.isin(*excluded_dirs)) if excluded_dirs else F.lit(True)
    if not hidden:
        keep = keep & ~F.exists(parts, lambda x: x.startswith(".") & ~x.isin(".", ".."))
    if include:
        keep = keep & fits(include)
    if exclude:
        keep = keep & ~fits(exclude)
    return files.where(keep)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether ignore patterns (in order, `!` takes one back) cover a path below the root."""
    out = F.lit(False)
    for raw in patterns:
        p = raw.strip()
        if not p or p.startswith("#"):
            continue
        back, p = p.startswith("!"), p.lstrip("!")
        rooted, p = p.startswith("/") or "/" in p.rstrip("/"), p.strip("/")
        body = glob_regex(p)[1:-1]
        hit = path.rlike(("^" if rooted else "(^|/)") + body + "(/|$)")
        out = F.when(hit, F.lit(not back)).otherwise(out)
    return out


def listing(files: DataFrame, by: str = "name", reverse: bool = False, page: int = 1, page_size: int = 0, dirs_first: bool = False) -> DataFrame:
    """Files sorted by name, size or modified, ties by path; directories (is_dir) first if asked for; a page of them if page_size is set."""
    key = {"name": F.lower(base_name(F.col("path"))), "size": F.col("size"), "modified": F.col("modified")}[by]
    first = [F.desc("is_dir")] if dirs_first else []
    out = files.orderBy(*first, key.desc() if reverse else key.asc(), F.asc("path"))
    return out.offset((page - 1) * page_size).limit(page_size) if page_size else out


def pages_of(files: DataFrame, page_size: int) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / page_size).alias("pages"))


def tree(files: DataFrame, depth: int = 5, cap: int = 0) -> DataFrame:
    """(path, name, depth, is_dir, size): files and their directories down to a depth, in path order, the first cap entries."""
    parts = F.split("path", "/")
    rows = files.withColumn("_p", parts).select("size", "_p", F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("depth"))
    rows = rows.where(F.col("depth") <= depth)
    nodes = rows.select(F.array_join(F.slice("_p", 1, F.col("depth")), "/").alias("path"), "depth", (F.col("depth") < F.size("_p")).alias("is_dir"), "size").where("path <> ''")
    each = nodes.groupBy("path", "depth").agg(F.bool_or("is_dir").alias("is_dir"), F.sum("size").alias("size"))
    out = each.select("path", base_name(F.col("path")).alias("name"), "depth", "is_dir", "size").orderBy("path")
    return out.limit(cap) if cap else out


def extension_stats(files: DataFrame) -> DataFrame:
    return files.groupBy(extension(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).orderBy(F.desc("n"), "ext")


def disk_usage(files: DataFrame) -> DataFrame:
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    return files.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"), F.count_distinct(folder).alias("dirs"))


def large_files(files: DataFrame, least: int, limit: int = 100) -> DataFrame:
    return files.where(F.col("size") >= least).orderBy(F.desc("size"), "path").limit(limit)


def continuation(token: Column) -> Column:
    """A page token from a struct: its JSON in base64."""
    return F.regexp_replace(F.base64(F.to_json(token).cast("binary")), r"\s", "")


def resumed(token: Column, schema: str) -> Column:
    return F.from_json(F.unbase64(token).cast("string"), schema)


def grep(numbered: DataFrame, pattern: str, ignore_case: bool = False, invert: bool = False, files_only: bool = False, doc: str = "doc") -> DataFrame:
    hit = F.col("line").rlike(("(?i)" if ignore_case else "") + pattern)
    out = numbered.where(~hit if invert else hit)
    return out.select(doc).distinct() if files_only else out


def definition_pattern(keyword: str) -> str:
    import re

    return "|".join(f"(?:{p % re.escape(keyword)})" for p in DEFINITIONS)


def multigrep(numbered: DataFrame, keywords: list[str], cap: int = 0, doc: str = "doc") -> DataFrame:
    """(keyword, doc, line_no, line, is_def, total): substring hits of a stated list of keywords; the first cap of each keyword and class, and the uncapped total."""
    hits = F.array(*[F.when(F.contains("line", F.lit(k)), F.struct(F.lit(k).alias("keyword"), F.col("line").rlike(definition_pattern(k)).alias("is_def"))) for k in keywords])
    found = numbered.select(doc, "line_no", "line", F.explode(F.array_compact(hits)).alias("h")).select("h.keyword", doc, "line_no", "line", "h.is_def")
    totals = found.groupBy(F.col("keyword").alias("_k")).agg(F.count(F.lit(1)).alias("total"))
    if cap:
        found = found.withColumn("_r", F.row_number().over(W.partitionBy("keyword", "is_def").orderBy(doc, "line_no"))).where(F.col("_r") <= cap).drop("_r")
    return found.join(F.broadcast(totals), F.col("keyword") == F.col("_k")).drop("_k")


def search_code(numbered: DataFrame, pattern: str, regex: bool = False, context: int = 0, limit: int = 1000, doc: str = "doc") -> DataFrame:
    """(doc, line_no, line, before, after) of matching lines with their context."""
    w = W.partitionBy(doc).orderBy("line_no")
    before, after = (F.collect_list("line").over(w.rowsBetween(a, b)) for a, b in ((-context, -1), (1, context))) if context else (F.array().cast("array<string>"),) * 2
    hit = F.col("line").rlike(pattern) if regex else F.contains("line", F.lit(pattern))
    return numbered.withColumns({"before": before, "after": after}).where(hit).orderBy(doc, "line_no").limit(limit)


def replace_text(docs: DataFrame, pattern: str, by: str, regex: bool = False, text: str = "text") -> DataFrame:
    """docs with new_text and changes: what a search and replace would do."""
    import re

    p = pattern if regex else re.escape(pattern)
    to = by if regex else by.replace("\\", "\\\\").replace("$", "\\$")
    return docs.withColumns({"new_text": F.regexp_replace(text, p, to), "changes": F.regexp_count(text, F.lit(p))})


def exists_in(paths: DataFrame, files: DataFrame) -> DataFrame:
    known = files.select(F.col("path").alias("_p")).distinct()
    return paths.join(known, F.col("path") == F.col("_p"), "left").withColumn("exists", F.col("_p").isNotNull()).drop("_p")


def outlines(docs: DataFrame, tokens: int, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line_no, line): headings of markdown files and definitions of code files, of the files that fit a budget of tokens by path."""
    fits = within_budget(docs, tokens, path, text)
    lines = fits.where(F.col(text).isNotNull()).select(F.col(path).alias("path"), F.posexplode(F.split(text, "\n")).alias("p", "line"))
    keyword = r"^\s*(?:(?:export|pub|public|private|async|default|abstract|static)\s+)*(?:def|class|func|fn|function|type|struct|interface|trait|enum|impl)\s+[\w(<]"
    heading = F.col("path").endswith(".md") & F.col("line").rlike(r"^#{1,6}\s")
    return lines.where(heading | (~F.col("path").endswith(".md") & F.col("line").rlike(keyword))).select("path", (F.col("p") + 1).alias("line_no"), F.trim("line").alias("line"))


def within_budget(docs: DataFrame, tokens: int, order: str = "path", text: str = "text") -> DataFrame:
    """Documents in order until the characters before one reach tokens * 4.

    Rows that share a place in the order are kept or left together; a null
    place is the last; a null text has no characters. Characters are added up
    in ranges of the order, never in one task.
    """
    sizes = docs.select(F.col(order).alias("_o"), F.length(text).alias("_n")).groupBy("_o").agg(F.sum("_n").alias("_n"))
    fits = running_before(sizes, [F.col("_o")], F.col("_n"), "_b").where(F.col("_b") < tokens * 4).select("_o")
    return docs.join(fits, docs[order].eqNullSafe(fits["_o"]), "left_semi")
