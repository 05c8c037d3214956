"""Edits of texts and of YAML documents, as columns; nothing is written."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def replaced_once(text: Column, old: str, new: str) -> Column:
    """text with the first place of a literal replaced."""
    at = F.instr(text, F.lit(old)) if old else F.lit(0)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + len(old), F.length(text)))).otherwise(text)


def edit_blocks(text: Column, edits: list[dict]) -> Column:
    """struct(text, statuses, changes) after a stated list of edits, one after the other.

    An edit has mode replace (old, new: the first place), insert_before,
    insert_after (line, new) or delete_line (line); lines count from 1. Its
    status is success, not_found, skipped (nothing to look for), invalid_line
    or line_out_of_range; what does not succeed changes nothing. Null stays.
    """
    statuses: list[Column] = []
    for e in edits:
        mode, lines = e.get("mode") or "replace", F.split(text, "\n")
        if mode == "replace":
            old = e.get("old") or ""
            found = F.contains(text, F.lit(old)) if old else F.lit(False)
            statuses.append(F.when(found, "success").otherwise("not_found") if old else F.lit("skipped"))
            text = replaced_once(text, old, e.get("new") or "")
            continue
        if mode not in ("insert_before", "insert_after", "delete_line"):
            raise ValueError(f"unknown mode {mode}")
        n, most = e.get("line") or 0, F.size(lines) + (1 if mode == "insert_before" else 0)
        if n < 1:
            statuses.append(F.lit("invalid_line"))
            continue
        head = n if mode == "insert_after" else n - 1
        tail = n if mode == "delete_line" else head
        middle = F.array().cast("array<string>") if mode == "delete_line" else F.array(F.lit(e.get("new") or ""))
        done = F.array_join(F.concat(F.slice(lines, 1, head), middle, F.slice(lines, tail + 1, F.greatest(F.lit(0), F.size(lines) - tail))), "\n")
        statuses.append(F.when(most >= n, "success").otherwise("line_out_of_range"))
        text = F.when(most >= n, done).otherwise(text)
    told = F.array(*statuses).cast("array<string>")
    return F.struct(text.alias("text"), told.alias("statuses"), F.size(F.filter(told, lambda s: s == "success")).alias("changes"))


def path_parts(path: str) -> list[str | int]:
    r"""`a.b[0].c`, `a[-1]` and `a\.b` (a dot that parts nothing) as keys and places."""
    import re

    parts: list[str | int] = []
    for key, place in re.findall(r"((?:\\\.|[^.\[\]])+)|\[(-?\d+)\]", path):
        parts.append(int(place) if place else key.replace("\\.", "."))
    return parts


def _number(value: str):
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def _down(node, part):
    try:
        return node[part] if isinstance(node, list) and isinstance(part, int) else node[str(part)] if isinstance(node, dict) else None
    except (KeyError, IndexError):
        return None


def _edited(root, op: str, path: str, value):
    """(root, value taken out) after one edit; a path that leads nowhere changes nothing but for set and push, which make its keys."""
    parts = path_parts(path)
    if not parts:
        raise ValueError("a path is asked for")
    root = {} if root is None else root
    node = root
    for i, part in enumerate(parts[:-1]):
        below = _down(node, part)
        if below is None and op in ("set", "push") and isinstance(node, dict):
            below = node[str(part)] = [] if isinstance(parts[i + 1], int) else {}
        if not isinstance(below, dict | list):
            return root, None
        node = below
    last = parts[-1]
    here = _down(node, last)
    if op == "set":
        if isinstance(node, dict):
            node[str(last)] = value
        elif isinstance(last, int) and -len(node) <= last < len(node):
            node[last] = value
        elif last == len(node):
            node.append(value)
    elif op == "delete":
        if isinstance(node, dict):
            node.pop(str(last), None)
        elif here is not None:
            del node[last]
    elif op == "push":
        if isinstance(here, list):
            here.append(value)
        elif here is None and isinstance(node, dict):
            node[str(last)] = [value]
    elif op == "pop":
        return root, here.pop() if isinstance(here, list) and here else None
    else:
        raise ValueError(f"unknown edit {op}")
    return root, None


def _run_yaml(texts: pd.Series, edits: list[tuple[str, str, str | None]]) -> pd.DataFrame:
    import copy
    import json

    import yaml

    from loomstead.functions import yaml_splice

    steps = [(op, path, path_parts(path), None if value is None else _number(value)) for op, path, value in edits]

    def one(x):
        try:
            now, popped = x or "", []
            node, root = yaml_splice.parsed(now)
            for op, path, parts, given in steps:
                before = copy.deepcopy(root)
                root, out = _edited(root, op, path, copy.deepcopy(given))
                popped += [out if isinstance(out, str) else json.dumps(out, default=str)] if op == "pop" and out is not None else []
                if root == before and (op != "set" or now):
                    continue
                try:
                    spliced = yaml_splice.splice(now, op, parts, given, node)
                    node, told = yaml_splice.parsed(spliced)
                    if told != root:
                        raise yaml_splice.NoSplice
                    now = spliced
                except (yaml_splice.NoSplice, yaml.YAMLError, ValueError, AttributeError, IndexError, TypeError):
                    now = yaml.safe_dump(root, sort_keys=False, allow_unicode=True)
                    node = yaml_splice.parsed(now)[0]
            return now, popped
        except yaml.YAMLError:
            return None, None

    known = {x: one(x) for x in texts.unique()}  # equal texts of a batch are edited once
    return pd.DataFrame([known[x] for x in texts], columns=["text", "popped"])


def edit_yaml(text: Column, edits: list[tuple[str, str, str | None]]) -> Column:
    """struct(text, popped) of a YAML text after a stated list of (set | delete | push | pop, path, value) edits.

    Values that are numbers are set as such. An edit is a splice: all that it
    doesn't name stays as it is, comments, order and quotes too. What a splice
    gives is read again; where that isn't the edit's meaning (aliases, an only
    entry that goes, an entry beside its list's mark) the text is written anew,
    without comments. Texts that are no YAML give null; null and empty texts
    are empty documents.
    """

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("popped", T.ArrayType(T.StringType()))]))
    def run(texts: pd.Series) -> pd.DataFrame:
        return _run_yaml(texts, edits)

    return run(text)


def yaml_values(text: Column, paths: list[str], default: str = "") -> Column:
    """Array of the values at paths of a YAML text, as text; default where there is none."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        import json

        import yaml

        from loomstead.functions import yaml_splice

        wanted = [path_parts(path) for path in paths]

        def one(x):
            try:
                root = yaml_splice.read(x or "")
            except yaml.YAMLError:
                return None
            out = []
            for parts in wanted:
                node = root
                for part in parts:
                    node = _down(node, part)
                out.append(default if node is None else node if isinstance(node, str) else json.dumps(node))
            return out

        known = {x: one(x) for x in texts.unique()}
        return texts.map(known)

    return run(text)


def json_size(text: Column) -> Column:
    """Bytes of a text as a JSON string, without its quotes."""
    return F.octet_length(text) + F.regexp_count(text, F.lit(r'["\\\n\t\r]')) + 5 * F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))


def byte_range(content: Column, offset: int, size: int) -> Column:
    """`size` bytes of a binary column from `offset` on, counted from 0; fewer at its end."""
    return F.substring(content, offset + 1, max(0, size))
