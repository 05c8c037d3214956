"""Text, JSON, markdown, encoding, size and duration functions."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of what is extracted from texts, and of definitions of a keyword.
PATTERNS = {
    "urls": r"https?://[^\s<>\"{}|\\^`\[\]]+",
    "paths": r"(?:\.{0,2}/|~/|/)[^\s:;,<>\"|*?]+",
    "variables": r"\{\{([^}]+)\}\}",
    "todos": r"- \[([ xX])\] (.+)",
    "emails": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "ips": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}
DEFINITIONS = (
    r"^\s*(export\s+)?(const|let|var|function|class|interface|type|enum)\s+%s\b",
    r"^\s*(export\s+)?async\s+function\s+%s\b",
    r"^\s*(public|private|protected)?\s*(static\s+)?(async\s+)?%s\s*[(<]",
    r"^\s*def\s+%s\s*\(",
    r"^\s*class\s+%s\s*[:(]",
    r"^\s*func\s+%s\s*\(",
    r"^\s*func\s+\([^)]*\)\s+%s\s*\(",
)
CHECKBOXES = {
    "list": {"checked": r"- \[[xX]\]", "unchecked": r"- \[ \]", "partial": r"- \[/\]"},
    "heading": {"checked": r"(?m)^#{1,6}\s+.*\[[xX]\]", "unchecked": r"(?m)^#{1,6}\s+.*\[ \]", "partial": r"(?m)^#{1,6}\s+.*\[/\]"},
    "table": {"checked": r"\|\s*\[[xX]\]\s*\|", "unchecked": r"\|\s*\[ \]\s*\|", "partial": r"\|\s*\[/\]\s*\|"},
}


def extract(text: Column, kind: str, unique: bool = False) -> Column:
    """Array of what the kind's pattern finds, in order."""
    if kind not in PATTERNS:
        raise ValueError(f"unknown extraction type: {kind}")
    text = F.coalesce(text, F.lit(""))
    if kind == "variables":
        found = F.transform(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(1)), lambda x: F.trim(F.substring_index(x, "|", 1)))
    elif kind == "todos":
        found = F.transform(F.regexp_extract_all(text, F.lit(r"- \[[ xX]\] .+"), F.lit(0)), lambda x: F.concat(F.lit("["), F.when(F.substring(x, 4, 1) == " ", " ").otherwise("x"), F.lit("] "), F.regexp_replace(x, r"^- \[[ xX]\] ", "")))
    else:
        found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    return F.array_distinct(found) if unique else found


def _title(word: Column) -> Column:
    """Each word's first letter in upper case; the others stay."""
    return F.array_join(F.transform(F.split(word, "(?<=\\s)"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")


def change_case(text: Column, to: str) -> Column:
    kind = to.lower()
    if kind in ("camelcase", "pascalcase"):
        parts = F.filter(F.split(text, r"[-_\s]+"), lambda w: w != "")
        caps = F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w)))))
        joined = F.array_join(caps, "")
        if kind == "pascalcase":
            return joined
        leading = F.lower(F.regexp_extract(text, r"^[^-_\s]*", 0))
        rest = F.when(leading == "", joined).otherwise(F.array_join(F.slice(caps, 2, F.greatest(F.lit(0), F.size(caps) - 1)), ""))
        return F.concat(leading, rest)
    if kind == "snake_case":
        s = F.regexp_replace(F.regexp_replace(text, r"(.)([ A-Z][a-z]+)", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2")
        return F.lower(F.regexp_replace(s, r"[-\s]+", "_"))
    if kind == "kebab-case":
        s = F.regexp_replace(F.regexp_replace(text, r"(.)([A-Z][a-z]+)", "$1-$2"), r"([a-z0-9])([A-Z])", "$1-$2")
        return F.lower(F.regexp_replace(s, r"[_\s]+", "-"))
    if kind == "uppercase":
        return F.upper(text)
    if kind == "lowercase":
        return F.lower(text)
    if kind in ("titlecase", "title case"):
        return _title(text)
    raise ValueError(f"unknown case type: {to}")


def digest(content: Column, kind: str = "sha256") -> Column:
    kinds = {"md5": F.md5(content), "sha1": F.sha1(content), "sha256": F.sha2(content, 256), "sha512": F.sha2(content, 512)}
    if kind not in kinds:
        raise ValueError(f"unknown hash: {kind}")
    return kinds[kind]


@F.pandas_udf(T.StringType())
def _base32(s: pd.Series) -> pd.Series:
    import base64

    return s.map(lambda x: None if x is None else base64.b32encode(x.encode()).decode())


@F.pandas_udf(T.StringType())
def _unbase32(s: pd.Series) -> pd.Series:
    import base64

    return s.map(lambda x: None if x is None else base64.b32decode(x).decode("utf-8", "replace"))


def encode(text: Column, kind: str) -> Column:
    """base64, base32, hex (lower case) or url (a blank is %20)."""
    raw = text.cast("binary")
    kinds = {"base64": lambda: F.regexp_replace(F.base64(raw), r"\s", ""), "base32": lambda: _base32(text), "hex": lambda: F.lower(F.hex(raw)), "url": lambda: F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))}
    if kind not in kinds:
        raise ValueError(f"unknown encoding: {kind}")
    return kinds[kind]()


def decode(text: Column, kind: str) -> Column:
    kinds = {"base64": lambda: F.unbase64(text).cast("string"), "base32": lambda: _unbase32(text), "hex": lambda: F.unhex(text).cast("string"), "url": lambda: F.url_decode(text)}
    if kind not in kinds:
        raise ValueError(f"unknown encoding: {kind}")
    return kinds[kind]()


def json_path(path: str) -> str:
    """`a.b.0.c` or `a.b[0].c` as a JSON path."""
    import re

    parts = [p for p in re.split(r"\.|\[(\d+)\]", path) if p]
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in parts)


def json_query(document: Column, path: str) -> Column:
    return F.get_json_object(document, json_path(path))


def json_valid(document: Column) -> Column:
    return F.try_parse_json(document).isNotNull()


def json_merge(*documents: Column) -> Column:
    """Shallow merge of JSON objects; keys of later ones win. Values stay as they are written."""

    def over(old: Column, new: Column) -> Column:
        return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)

    out = F.from_json(documents[0], "map<string,string>")
    for d in documents[1:]:
        out = over(out, F.from_json(d, "map<string,string>"))
    return F.to_json(out)


def preview(signature: Column, content: Column, length: int = 150) -> Column:
    flat = F.regexp_replace(F.when(F.coalesce(signature, F.lit("")) != "", signature).otherwise(content), r"[\n\t]", " ")
    return F.when(F.length(flat) > length, F.concat(F.substring(flat, 1, length), F.lit("..."))).otherwise(flat)


def chunk_id(path: Column, name: Column, start: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, name, start.cast("string")), 256), 1, 16)


def enriched(language: Column, kind: Column, signature: Column, path: Column, content: Column) -> Column:
    return F.concat(F.lit("["), language, F.lit(":"), kind, F.lit("] "), signature, F.lit(" in "), path, F.lit("\n"), content)


def format_size(n: Column) -> Column:
    """Bytes with a unit of 1024s and one decimal; plain below that."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**i, F.format_string(f"%.1f {unit}", n / float(1024**i))).otherwise(out)
    return out


def parse_size(size: Column) -> Column:
    """Bytes of `10`, `10 B`, `1.5 KB`, `2M`, ... with units of 1024s, whatever their case; null for anything else."""
    pattern = r"(?i)^\s*(\d+(?:\.\d+)?)\s*([KMGT]?)(?:I?B)?\s*$"
    n, unit = F.regexp_extract(size, pattern, 1).try_cast("double"), F.upper(F.regexp_extract(size, pattern, 2))
    power = F.locate("K", unit) + 2 * F.locate("M", unit) + 3 * F.locate("G", unit) + 4 * F.locate("T", unit)
    return F.floor(n * F.pow(F.lit(1024.0), power))


def format_duration(seconds: Column, style: str = "human") -> Column:
    """secs, mins, mins-secs, hms, compact or human; a sign stands before it."""
    s = F.abs(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    sign = F.when(seconds < 0, "-").otherwise("")
    parts = {
        "secs": F.concat(s.cast("string"), F.lit("s")), "mins": F.format_string("%.1fm", s / 60.0), "mins-secs": F.format_string("%dm %ds", F.floor(s / 60), r),
        "hms": F.format_string("%02d:%02d:%02d", h, m, r),
        "compact": F.when(h > 0, F.format_string("%dh%dm%ds", h, m, r)).when(m > 0, F.format_string("%dm%ds", m, r)).otherwise(F.format_string("%ds", r)),
        "human": F.concat_ws(" ", F.when(h > 0, F.format_string("%dh", h)), F.when(m > 0, F.format_string("%dm", m)), F.when((r > 0) | (s == 0), F.format_string("%ds", r))),
    }
    if style not in parts:
        raise ValueError(f"unknown duration format: {style}")
    return F.concat(sign, parts[style])


def checkbox_counts(text: Column, style: str = "all") -> dict[str, Column]:
    """checked, unchecked, partial counts of a style of boxes; `all` adds the styles up."""
    styles = CHECKBOXES if style == "all" else {style: CHECKBOXES[style]}
    return {k: sum((F.regexp_count(text, F.lit(s[k])) for s in styles.values()), F.lit(0)) for k in ("checked", "unchecked", "partial")}


def front_matter(text: Column) -> Column:
    """Map of the `key: value` lines between leading dashes; null without."""
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[\w-]+:"))
    return F.when(block != "", F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.substring_index(x, ":", 1), F.trim(F.regexp_replace(x, r"^[\w-]+:", ""))))))


def code_blocks(text: Column) -> Column:
    """Array of (language, code) of fenced blocks."""
    pattern = F.lit(r"(?s)```([\w+-]*)[^\n]*\n(.*?)```")
    return F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("language"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("code"))


def substitute(template: Column, values: dict[str, str]) -> Column:
    """{{name}} and [[name]] replaced by values; {{name|default}} by its value or default."""
    out = template
    for k, v in values.items():
        out = F.regexp_replace(out, r"\{\{\s*" + k + r"\s*(\|[^}]*)?\}\}|\[\[\s*" + k + r"\s*\]\]", v.replace("\\", "\\\\").replace("$", "\\$"))
    return F.regexp_replace(out, r"\{\{[^}|]+\|([^}]*)\}\}", "$1")


_FUNCTIONS = {"abs": "abs", "round": "round", "min": "least", "max": "greatest", "floor": "floor", "ceil": "ceil", "sqrt": "sqrt", "pow": "pow"}
_OPERATORS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%"}


def arithmetic(source: str) -> Column:
    """A column from an arithmetic expression over numbers, columns and a closed list of functions; nothing else is taken."""

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            return F.col(node.id).cast("double")
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow):
            return F.pow(build(node.left), build(node.right))
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            a, b = build(node.left), build(node.right)
            return {"+": a + b, "-": a - b, "*": a * b, "/": a / b, "%": a % b}[_OPERATORS[type(node.op)]]
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _FUNCTIONS and not node.keywords:
            return F.call_function(_FUNCTIONS[node.func.id], *[build(a) for a in node.args])
        raise ValueError(f"not an arithmetic expression: {source}")

    return build(ast.parse(source, mode="eval"))


def shown_number(value: Column) -> Column:
    """Whole numbers bare, others with six significant digits at most."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", ""))
