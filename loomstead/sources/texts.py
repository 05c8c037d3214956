"""Sources and sinks: delimited text, markdown tables, checklists, lines, JSON, CSV, YAML, TOML, key-value logs, manifests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, line_no, line): lines from 1, parted at line ends; null texts have none."""
    return docs.where(F.col(text).isNotNull()).select(doc, F.posexplode(F.split(text, "\n")).alias("p", "line")).select(doc, (F.col("p") + 1).alias("line_no"), "line")


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of files with their numbers."""
    return lines(spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("text")))


def line_range(text: Column, start: int, count: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), start, count), "\n")


def extract_lines(numbered: DataFrame, numbers: list[int] | None = None, span: tuple[int, int] | None = None, pattern: str | None = None, context: int = 0, doc: str = "doc") -> DataFrame:
    """Lines by number, range or pattern, with so many lines of context around matches of the pattern."""
    hit = F.lit(False)
    if numbers:
        hit = hit | F.col("line_no").isin(*numbers)
    if span:
        hit = hit | F.col("line_no").between(*span)
    if pattern:
        match = F.col("line").rlike(pattern)
        near = match if not context else F.max(match.cast("int")).over(W.partitionBy(doc).orderBy("line_no").rowsBetween(-context, context)) == 1
        return numbered.withColumn("_hit", hit | near).where("_hit").drop("_hit")
    return numbered.where(hit)


def parse_delimited(rows: DataFrame, headers: list[str], delimiter: str = "|", value: str = "value") -> DataFrame:
    """rows with cells (map), extra and error: missing cells are empty, more go to _extra_n, and a differing count is an error."""
    cells = F.transform(F.split(value, "\\" + delimiter), lambda x: F.trim(x))
    n = len(headers)
    padded = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.lit(n) - F.size(cells))))
    named = F.map_from_arrays(F.array(*[F.lit(h) for h in headers]), F.slice(padded, 1, n))
    extra = F.transform(F.slice(cells, n + 1, F.greatest(F.lit(0), F.size(cells) - n)), lambda x, i: F.struct(F.concat(F.lit("_extra_"), (i + 1).cast("string")), x))
    error = F.when(F.size(cells) != n, F.concat(F.lit(f"expected {n} columns, got "), F.size(cells).cast("string")))
    return rows.withColumns({"cells": F.map_concat(named, F.map_from_entries(extra)), "error": error})


#: Columns of finding streams by their number of cells; 9 are read as 8, fewer than 5 are rejected.
STREAM_COLUMNS = {
    5: ["severity", "file_line", "problem", "fix", "category"],
    6: ["severity", "file_line", "problem", "fix", "category", "est_minutes"],
    7: ["severity", "file_line", "problem", "fix", "category", "est_minutes", "evidence"],
    8: ["severity", "file_line", "problem", "fix", "category", "est_minutes", "evidence", "reviewer"],
    10: ["severity", "file_line", "problem", "fix", "category", "est_minutes", "evidence", "_group", "_checkbox", "reviewer"],
}


def parse_findings(streams: DataFrame) -> DataFrame:
    """Finding rows of pipe streams (value, tag), with rejected set where there are too few cells."""
    cells = F.transform(F.split("value", r"\|"), lambda x: F.trim(x))
    n = F.size(cells)

    def cell(name: str) -> Column:
        out = F.lit(None).cast("string")
        for size, names in STREAM_COLUMNS.items():
            if name in names:
                fits = (n == size) | ((n == 9) if size == 8 else (n > 10) if size == 10 else F.lit(False))
                out = F.when(fits, F.get(cells, names.index(name))).otherwise(out)
        return out

    out = streams.select("*", *[cell(c).alias(c) for c in STREAM_COLUMNS[8] if c != "est_minutes"], cell("est_minutes").try_cast("double").alias("est_minutes"), F.col("tag").alias("source"), (n < 5).alias("rejected"))
    return out.withColumn("reviewer", F.coalesce(F.nullif(F.col("reviewer"), F.lit("")), F.col("tag")))


def parse_readme(numbered: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, line_no, section, cells): rows of markdown tables under the heading above them; separators and headers are left out."""
    w = W.partitionBy(doc).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    section = F.last(F.when(F.col("line").rlike(r"^#{1,6}\s"), F.regexp_replace("line", r"^#{1,6}\s+", "")), ignorenulls=True).over(w)
    after = F.lead("line").over(W.partitionBy(doc).orderBy("line_no"))
    separator = r"^\s*\|[\s:|-]+\|\s*$"
    told = numbered.withColumns({"section": section, "_after": after})
    body = told.where(F.col("line").rlike(r"^\s*\|") & ~F.col("line").rlike(separator) & ~F.coalesce(F.col("_after").rlike(separator), F.lit(False)))
    inner = F.regexp_replace(F.regexp_replace("line", r"^\s*\|", ""), r"\|\s*$", "")
    return body.select(doc, "line_no", "section", F.transform(F.split(inner, r"(?<!\\)\|"), lambda x: F.trim(x)).alias("cells"))


def parse_checklist(numbered: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, line_no, indent, checked, text) of `- [x] text` lines."""
    pattern = r"^(\s*)[-*+] \[([ xX])\] (.*)$"
    hits = numbered.where(F.col("line").rlike(pattern))
    return hits.select(doc, "line_no", F.length(F.regexp_extract("line", pattern, 1)).alias("indent"), (F.regexp_extract("line", pattern, 2) != " ").alias("checked"), F.regexp_extract("line", pattern, 3).alias("text"))


def headers(numbered: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, line_no, level, title) of markdown headings outside fenced code."""
    pattern = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
    out = outside_fences(numbered, doc).where(F.col("line").rlike(pattern))
    return out.select(doc, "line_no", F.length(F.regexp_extract("line", pattern, 1)).alias("level"), F.regexp_extract("line", pattern, 2).alias("title"))


def outside_fences(numbered: DataFrame, doc: str = "doc") -> DataFrame:
    """Lines that are neither fences nor inside them: the running count of fences is even."""
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    w = W.partitionBy(doc).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    return numbered.withColumn("_f", F.sum(fence.cast("int")).over(w)).where((F.col("_f") % 2 == 0) & ~fence).drop("_f")


def section(numbered: DataFrame, title: str, doc: str = "doc") -> DataFrame:
    """Lines of the section with this title, up to the next heading of its level or above."""
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    w = W.partitionBy(doc).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    told = numbered.withColumn("_l", level).withColumn("_own", (F.col("_l") > 0) & (F.lower(F.regexp_replace("line", r"^#{1,6}\s+|\s+$", "")) == title.lower()))
    told = told.withColumn("_at", F.last(F.when(F.col("_own"), F.col("_l")), ignorenulls=True).over(w))
    told = told.withColumn("_state", F.last(F.when(F.col("_own"), F.lit(1)).when((F.col("_l") > 0) & (F.col("_l") <= F.col("_at")), F.lit(0)), ignorenulls=True).over(w))
    return told.where("_state = 1").drop("_l", "_own", "_at", "_state")


def header_paths(heads: DataFrame, doc: str = "doc") -> DataFrame:
    """heads with path: titles from the outermost ancestor down."""
    w = W.partitionBy(doc).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = F.collect_list(F.struct("level", "title")).over(w)
    kept = F.aggregate(seen, F.array().cast("array<struct<level:int,title:string>>"), lambda acc, x: F.array_append(F.filter(acc, lambda a: a["level"] < x["level"]), x))
    return heads.withColumn("path", F.transform(kept, lambda x: x["title"]))


def last_values(numbered: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, key, value) of `KEY='value'` logs: the last write of a key wins."""
    pattern = r"^([A-Za-z_]\w*)='(.*)'$"
    hits = numbered.where(F.col("line").rlike(pattern)).select(doc, "line_no", F.regexp_extract("line", pattern, 1).alias("key"), F.regexp_extract("line", pattern, 2).alias("value"))
    return hits.groupBy(doc, "key").agg(F.max_by("value", "line_no").alias("value"))


def items_of(documents: DataFrame, text: str = "text") -> DataFrame:
    """(item) of JSON documents: an array, or an object that wraps one as items or rows; each as a variant."""
    whole = F.coalesce(F.get_json_object(text, "$.items"), F.get_json_object(text, "$.rows"), F.col(text))
    return documents.select(F.explode(F.from_json(whole, "array<string>", {"allowUnquotedFieldNames": "false"})).alias("raw")).select(F.try_parse_json("raw").alias("item"))


def _loader(kind: str):
    @F.pandas_udf(T.StringType())
    def load(texts: pd.Series) -> pd.Series:
        import json

        def one(text):
            if text is None:
                return None
            try:
                if kind == "toml":
                    import tomllib

                    value = tomllib.loads(text)
                else:
                    import yaml

                    value = yaml.safe_load(text)
                return json.dumps(value, default=str)
            except Exception:  # any parser's error: the text is not valid
                return None

        return texts.map(one)

    return load


def yaml_as_json(text: Column) -> Column:
    """YAML as JSON text; null where it isn't valid."""
    return _loader("yaml")(text)


def toml_as_json(text: Column) -> Column:
    return _loader("toml")(text)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def flat_keys(documents: pd.Series) -> pd.Series:
    """JSON text as a map from dotted paths to leaves."""
    import json

    def flatten(value, path, out):
        if isinstance(value, dict) and value:
            for k, v in value.items():
                flatten(v, f"{path}.{k}" if path else str(k), out)
        elif isinstance(value, list) and value:
            for i, v in enumerate(value):
                flatten(v, f"{path}[{i}]", out)
        else:
            out[path] = value if isinstance(value, str) else json.dumps(value)
        return out

    return documents.map(lambda d: None if d is None else flatten(json.loads(d), "", {}))


@F.pandas_udf(T.LongType())
def count_nodes(documents: pd.Series) -> pd.Series:
    """Leaves of JSON text."""
    import json

    def count(v):
        return sum(map(count, v.values())) if isinstance(v, dict) else sum(map(count, v)) if isinstance(v, list) else 1

    return documents.map(lambda d: None if d is None else count(json.loads(d)))


def valid_format(ext: Column, text: Column) -> Column:
    """Whether a text is valid for its extension: json, yaml, toml, csv (equal commas in each line), md."""
    rows = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    even = F.size(F.array_distinct(F.transform(rows, lambda x: F.length(F.regexp_replace(x, "\"[^\"]*\"|[^,]", ""))))) <= 1
    return F.when(ext == "json", F.try_parse_json(text).isNotNull()).when(ext.isin("yaml", "yml"), yaml_as_json(text).isNotNull()).when(ext == "toml", toml_as_json(text).isNotNull()).when(ext == "csv", even).otherwise(F.lit(True))


def dependencies(manifests: DataFrame) -> DataFrame:
    """(path, name, version, type) from manifests (path, text): package.json, go.mod, requirements.txt, Gemfile, Cargo.toml, pyproject.toml, pom.xml."""
    name = F.substring_index("path", "/", -1)
    maps = "map<string,string>"
    node = manifests.where(name == "package.json").select("path", F.from_json("text", f"dependencies {maps}, devDependencies {maps}").alias("j"))
    parts = [node.select("path", F.explode(f"j.{k}").alias("name", "version"), F.lit(t).alias("type")) for k, t in (("dependencies", "production"), ("devDependencies", "dev"))]
    rows = manifests.select("path", name.alias("file"), F.explode(F.split("text", r"\r?\n")).alias("line"))

    def by_line(file: str, pattern: str, kind: Column | str = "production") -> DataFrame:
        hits = rows.where((F.col("file") == file) & F.col("line").rlike(pattern))
        return hits.select("path", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("version"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"))

    parts.append(by_line("go.mod", r"^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+(v\S+)", F.when(F.contains("line", F.lit("// indirect")), "indirect").otherwise("production")))
    parts.append(by_line("requirements.txt", r"^\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*([=<>!~]=?[^\s#;]*)?"))
    parts.append(by_line("Gemfile", r"^\s*gem\s+['\"]([^'\"]+)['\"](?:,\s*['\"]([^'\"]+)['\"])?"))
    toml = manifests.where(name.isin("Cargo.toml", "pyproject.toml")).select("path", toml_as_json(F.col("text")).alias("j"))
    for key, kind in (("dependencies", "production"), ("dev-dependencies", "dev"), ("tool.poetry.dependencies", "production")):
        at = "$" + "".join(f"['{k}']" for k in key.split("."))
        parts.append(toml.select("path", F.explode(F.from_json(F.get_json_object("j", at), maps)).alias("name", "version"), F.lit(kind).alias("type")))
    listed = toml.select("path", F.explode(F.from_json(F.get_json_object("j", "$.project.dependencies"), "array<string>")).alias("d"))
    parts.append(listed.select("path", F.regexp_extract("d", r"^\s*([A-Za-z0-9][\w.-]*)", 1).alias("name"), F.regexp_extract("d", r"([=<>!~]=?[^;\s]*)", 1).alias("version"), F.lit("production").alias("type")))
    pom = manifests.where(name == "pom.xml").select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("d"))
    tag = lambda t: F.regexp_extract("d", rf"(?s)<{t}>\s*(.*?)\s*</{t}>", 1)
    parts.append(pom.select("path", F.concat_ws(":", tag("groupId"), tag("artifactId")).alias("name"), tag("version").alias("version"), F.when(tag("scope") == "test", "dev").otherwise("production").alias("type")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """CSV with a header; every column is a string."""
    return spark.read.csv(list(paths), header=True, inferSchema=False)


def read_json(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(list(paths), multiLine=True)


def as_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def from_json_rows(rows: DataFrame, keys: list[str], column: str = "json") -> DataFrame:
    """Columns for the sorted keys; missing ones are empty."""
    m = F.from_json(column, "map<string,string>")
    return rows.select(*[F.coalesce(F.try_element_at(m, F.lit(k)), F.lit("")).alias(k) for k in sorted(keys)])


def pad_stream(rows: DataFrame, width: int = 7, value: str = "value", reviewer: str = "reviewer") -> DataFrame:
    """Rows padded to `width` cells, with the reviewer as one more."""
    cells = F.split(value, r"\|")
    padded = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.lit(width) - F.size(cells))), F.array(reviewer))
    return rows.withColumn(value, F.array_join(padded, "|"))
