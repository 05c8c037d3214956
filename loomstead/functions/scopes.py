"""Scope trees of source files, and references resolved from the innermost scope outward."""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from loomstead.functions import chunkers

for _module in (chunkers, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)  # workers need no installed copy of them

SCOPES = "path string, scope string, parent string, type string, name string, start_line int, end_line int, depth int, language string"
REFS = "path string, scope string, ref_type string, ref_name string, target string, line int"

# Words before `(` that call nothing; import forms; forms that name a type.
NO_CALLS = set(
    "if elif else for foreach while switch match case return func function def fn class catch except and or not in is lambda yield await async new typeof isset empty list array echo print "
    "require require_once include include_once use throw raise assert del go defer select range impl where let const var import from type interface struct static with".split()
)
IMPORTS = {
    "python": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", "php": r"^\s*use\s+([\w\\]+)", "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)",
    "javascript": r"^\s*import\s+(?:.*\sfrom\s+)?[\"']([^\"']+)[\"']|require\([\"']([^\"']+)[\"']\)", "go": r"^\s*(?:import\s+)?(?:(\w+)\s+)?\"([\w./-]+)\"\s*$",
}
TYPES = {
    "python": r"(?::|->)\s*([A-Z]\w*)", "php": r"\b(?:new|extends|implements|instanceof)\s+([A-Z]\w*)", "rust": r"(?::\s*&?(?:mut\s+)?|->\s*)([A-Z]\w*)",
    "javascript": r"(?:\bnew\s+|\bextends\s+|\bimplements\s+|:\s*)([A-Z]\w*)", "go": r"\b([A-Za-z_]\w*\.[A-Z]\w*)",
}
CALL = r"((?:\$?[A-Za-z_]\w*(?:\.|->|::))?[A-Za-z_]\w*)\s*\("
_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_MASKED = {"python": re.compile(rf"\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|{_STRINGS}|#[^\n]*")}


def masked(text: str, language: str) -> list[str]:
    """The lines of a text with strings, comments and heredocs blank, so that columns and lines stay."""
    return (_MASKED.get(language) or chunkers.HIDDEN[language]).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text).split("\n")


def scope_tree(text: str, language: str) -> list[dict]:
    """Definitions in order of their start, each with its scope: the names that hold it, joined by dots, and its own.

    A definition lies in the innermost one whose lines hold its own. A Go
    method lies in its receiver's type, though it stands beside it. Depth is
    the number of names before its own.
    """
    found = [dict(zip(("type", "name", "content", "start", "end"), c, strict=True)) for c in chunkers.code_chunks(text, language)]
    found.sort(key=lambda x: (x["start"], -x["end"]))
    held: list[dict] = []
    for x in found:
        while held and held[-1]["end"] < x["end"] or held and held[-1]["end"] < x["start"]:
            held.pop()
        above = held[-1]["scope"] if held else ""
        receiver = re.match(r"\s*func\s+\(\s*(?:\w+\s+)?\*?\s*(\w+)", x["content"]) if language == "go" else None
        if receiver and not above:
            above = receiver[1]
        if x["type"] == "function" and held and held[-1]["type"] in ("struct", "interface"):
            x["type"] = "method"
        x |= {"parent": above, "scope": f"{above}.{x['name']}" if above else x["name"]}
        x["depth"] = x["scope"].count(".")
        held.append(x)
    return found


def scope_references(text: str, language: str) -> list[tuple]:
    """(scope, type, name, target, line): imports, of the file's first scope; calls and types that are named, of the innermost scope that holds them; each once a scope, at its first line.

    A call's target is the definition of that name nearest to the caller: in
    its own scope, then in each that holds it, then in the file; null
    otherwise. A scope doesn't refer to itself by calling its own name.
    """
    tree, lines, plain = scope_tree(text, language), text.split("\n"), masked(text, language)
    inner: list[dict | None] = [None] * (len(lines) + 1)
    for x in tree:  # an inner scope comes after those that hold it
        inner[x["start"] : x["end"] + 1] = [x] * (x["end"] + 1 - x["start"])
    known = {}
    for x in tree:
        known.setdefault((x["parent"], x["name"]), x["scope"])
    out: dict[tuple, tuple] = {}

    def tell(scope: str, kind: str, name: str, line: int, target: str | None = None) -> None:
        out.setdefault((scope, kind, name), (target, line))

    for i, line in enumerate(lines, 1):
        if (at := re.search(IMPORTS[language], line)) and (plain[i - 1].strip() or language in ("go", "javascript")):
            given = [g for g in at.groups() if g]
            name = given[0] if language == "go" and len(given) > 1 and given[0] not in (".", "_") else re.split(r"[/\\.]|::", given[-1])[-1] if language in ("go", "php", "rust") else given[-1]
            tell(tree[0]["scope"] if tree else "", "imports", name, i)
            continue
        own = inner[i]
        scope = own["scope"] if own else ""
        for called in re.findall(CALL, plain[i - 1]):
            name = re.split(r"\.|->|::", called)[-1]
            if name in NO_CALLS or own and name == own["name"] or re.search(rf"\b(?:def|func|function|fn)\s+&?{name}\s*\(", plain[i - 1]):
                continue
            target, place = None, scope
            while target is None:
                target = known.get((place, name))
                if not place:
                    break
                place = place.rpartition(".")[0]
            tell(scope, "calls", re.sub(r"->|::", ".", called).lstrip("$"), i, target)
        for name in re.findall(TYPES[language], plain[i - 1]):
            tell(scope, "uses_type", name, i, known.get(("", name)))
    return [(scope, kind, name, target, line) for (scope, kind, name), (target, line) in out.items()]


def _by_file(files: DataFrame, make, schema: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                language = chunkers.LANGUAGES.get((path or "").rsplit(".", 1)[-1].lower())
                if text and language in chunkers.DEFINITIONS:
                    rows += make(path, text, language)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return files.select("path", "text").mapInPandas(run, schema)


def file_scopes(files: DataFrame) -> DataFrame:
    """(path, scope, parent, type, name, start_line, end_line, depth, language) of the definitions in code files (path, text); others, and null texts, have none. See scope_tree."""
    keys = ("scope", "parent", "type", "name", "start", "end", "depth")
    return _by_file(files, lambda path, text, language: [(path, *(x[k] for k in keys), language) for x in scope_tree(text, language)], SCOPES)


def file_references(files: DataFrame) -> DataFrame:
    """(path, scope, ref_type, ref_name, target, line) of code files (path, text): what each scope imports, calls and names as a type. See scope_references."""
    return _by_file(files, lambda path, text, language: [(path, *r) for r in scope_references(text, language)], REFS)
