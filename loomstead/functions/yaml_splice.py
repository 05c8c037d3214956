"""Edits of YAML texts as splices: what an edit does not name stays as it is, byte for byte, comments and order too."""

from __future__ import annotations

import sys

import yaml
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no installed copy of it


#: The faster of the readers that are there.
_Loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def read(text: str):
    """The document of a text."""
    return yaml.load(text, Loader=_Loader)


def parsed(text: str):
    """(node, document) of a text, by one reading."""
    loader = _Loader(text)
    try:
        node = loader.get_single_node()
        root = None if node is None else loader.construct_document(node)
    finally:
        loader.dispose()
    return yaml.compose(text, Loader=_Loader) if "<<" in text else node, root  # merged keys are written into the node


class NoSplice(Exception):
    """The edit can't be said as a splice here."""


_written: dict = {}


def _kept(key: tuple, value, write) -> str:
    """What write gives for a value, kept for edits of many texts repeat it."""
    key = (*key, repr(value))
    if key not in _written:
        if len(_written) >= 1000:
            _written.clear()
        _written[key] = write()
    return _written[key]


def _flow(value) -> str:
    """A value in one line."""
    return _kept(("flow",), value, lambda: yaml.safe_dump(value, default_flow_style=True, allow_unicode=True, sort_keys=False, width=1 << 30).strip().removesuffix("...").strip())


def _end(node, text: str) -> int:
    """Where a node's own characters end, without comments and blank lines after it."""
    if isinstance(node, yaml.ScalarNode):
        at = node.end_mark.index
        return at if node.style in ("'", '"') else len(text[:at].rstrip()) if node.style else at
    if node.flow_style:
        return node.end_mark.index
    last = node.value[-1]
    return max(_end(last[1], text), last[0].end_mark.index) if isinstance(node, yaml.MappingNode) else _end(last, text)


def _line_end(text: str, at: int) -> int:
    """The end of the line that a place is in, which a comment may stand at."""
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def _below(node, part):
    """(index, key, value) of a part of a node; nothing where there is none."""
    if isinstance(node, yaml.MappingNode):
        for i, (key, value) in enumerate(node.value):
            if isinstance(key, yaml.ScalarNode) and key.value == str(part):
                return i, key, value
    elif isinstance(node, yaml.SequenceNode) and isinstance(part, int) and -len(node.value) <= part < len(node.value):
        i = part % len(node.value)
        return i, None, node.value[i]
    return None


def _put(text: str, node, key, value) -> str:
    """text with a new last entry (of a mapping, by key) or item in node."""
    mapping = isinstance(node, yaml.MappingNode)
    if node.flow_style:
        at = node.end_mark.index - 1
        entry = f"{_flow(str(key))}: {_flow(value)}" if mapping else _flow(value)
        head = text[:at].rstrip() if node.value else text[:at]
        return head + (", " if node.value else "") + entry + text[at:]
    indent = " " * node.start_mark.column
    entry = {str(key): value} if mapping else [value]
    told = _kept(("entry",), entry, lambda: yaml.safe_dump(entry, allow_unicode=True, sort_keys=False, width=1 << 30).rstrip("\n"))
    at = _line_end(text, _end(node, text))
    return text[:at] + "".join(f"\n{indent}{line}" for line in told.split("\n")) + text[at:]


def _replace(text: str, key, node, value) -> str:
    """text with a value in the place of a node's."""
    start, end = node.start_mark.index, _end(node, text)
    if key is not None and (start == end or "\n" in text[key.end_mark.index : start]):  # nothing, or a block on its own lines
        start = text.index(":", key.end_mark.index) + 1
        return text[:start] + " " + _flow(value) + text[max(start, end) :]
    return text[:start] + _flow(value) + text[end:]


def _without(text: str, node, i: int) -> str:
    """text without a node's entry or item of that number."""
    mapping = isinstance(node, yaml.MappingNode)
    entries = [e if mapping else (e, e) for e in node.value]
    start, end = entries[i][0].start_mark.index, _end(entries[i][1], text)
    end = max(end, entries[i][0].end_mark.index) if mapping else end
    if len(entries) == 1:
        if not node.flow_style:
            raise NoSplice
        return text[: node.start_mark.index + 1] + text[node.end_mark.index - 1 :]
    if node.flow_style:
        if i + 1 < len(entries):
            return text[:start] + text[entries[i + 1][0].start_mark.index :]
        return text[: _end(entries[i - 1][1], text)] + text[end:]
    line = text.rfind("\n", 0, start) + 1
    before = text[line:start].strip()
    if before not in ("", "-") or mapping and before:
        raise NoSplice
    return text[:line] + text[min(len(text), _line_end(text, end) + 1) :]


def splice(text: str, op: str, parts: list, value, node=None) -> str:
    """text, whose node may be given, after one edit (set, delete, push or pop) of the node at parts; NoSplice where that needs the text to be written anew. A path that leads nowhere changes nothing."""
    node = yaml.compose(text, Loader=_Loader) if node is None else node
    if node is None:
        raise NoSplice
    for n, part in enumerate(parts[:-1]):
        found = _below(node, part)
        if found is None or not isinstance(found[2], yaml.CollectionNode):
            if op not in ("set", "push") or found is not None or not isinstance(node, yaml.MappingNode):
                raise NoSplice
            made = [value] if op == "push" else value
            for p in reversed(parts[n + 1 :]):
                made = [made] if isinstance(p, int) else {str(p): made}
            return _put(text, node, part, made)
        node = found[2]
    found = _below(node, parts[-1])
    if op == "set":
        return _replace(text, *found[1:], value) if found else _put(text, node, parts[-1], value)
    if op == "push":
        return _put(text, found[2], None, value) if found else _put(text, node, parts[-1], [value])
    if found is None:
        return text
    if op == "delete":
        return _without(text, node, found[0])
    return _without(text, found[2], len(found[2].value) - 1)
