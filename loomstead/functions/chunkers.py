"""Chunkers and HTML readers as table functions over (path, text)."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

CHUNK = "path string, type string, name string, content string, start_line int, end_line int, language string"

# Sizes, element sets, link scores and definition patterns.
SIZES = {"generic": 1500, "markdown": 4000}
HTML_CHUNKS, HTML_STRIPPED = {"section", "article", "main", "aside"}, {"script", "style", "nav", "footer", "header", "noscript"}
HTML_KEPT = {"pre", "code", "table", "blockquote"}
HTML_BLOCKS = {"p", "div", "section", "article", "header", "footer", "nav", "aside", "main", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "table", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption"}
LINK_SCORES = {"h1": 100, "h2": 85, "h3": 70, "h4": 55, "h5": 55, "h6": 55, "main": 50, "article": 50, "p": 40, "li": 35, "nav": 30, "header": 25, "aside": 20, "footer": 10, "body": 30}
LINK_DEFAULT, LINK_BOLD, LINK_EM, LINK_BUTTON, LINK_CLASS, LINK_TITLE = 30, 15, 10, 10, 10, 5
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DEFINITIONS = {
    "python": [("struct", r"^(\s*)class\s+(\w+)"), ("function", r"^(\s*)(?:async\s+)?def\s+(\w+)")],
    "javascript": [("function", r"^(\s*)(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("function", r"^(\s*)(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>"), ("struct", r"^(\s*)(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^(\s*)(?:export\s+)?interface\s+(\w+)"), ("interface", r"^(\s*)(?:export\s+)?type\s+(\w+)\s*=")],
    "php": [("struct", r"^(\s*)(?:abstract\s+|final\s+)?class\s+(\w+)"), ("interface", r"^(\s*)interface\s+(\w+)"), ("struct", r"^(\s*)trait\s+(\w+)"), ("function", r"^(\s*)(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(\w+)")],
    "rust": [("struct", r"^(\s*)(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("struct", r"^(\s*)(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("interface", r"^(\s*)(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"), ("struct", r"^(\s*)impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)"), ("function", r"^(\s*)(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"), ("struct", r"^(\s*)(?:pub\s+)?mod\s+(\w+)")],
    "go": [("method", r"^(\s*)func\s+\([^)]*\)\s+(\w+)"), ("function", r"^(\s*)func\s+(\w+)"), ("struct", r"^(\s*)type\s+(\w+)\s+struct"), ("interface", r"^(\s*)type\s+(\w+)\s+interface")],
}
# Strings and comments, in which braces and definitions mean nothing.
_QUOTED = r"\"(?:\\.|[^\"\\\n])*\""
HIDDEN = {
    "python": re.compile(r"\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''"),
    "javascript": re.compile(rf"//[^\n]*|/\*.*?\*/|{_QUOTED}|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S),
    "php": re.compile(rf"<<<[\"']?(?P<mark>\w+)[\"']?\n.*?\n[ \t]*(?P=mark)\b|//[^\n]*|#[^\n]*|/\*.*?\*/|{_QUOTED}|'(?:\\.|[^'\\])*'", re.S),
    "rust": re.compile(rf"//[^\n]*|/\*.*?\*/|{_QUOTED}|'(?:\\.|[^'\\\n])'", re.S),
    "go": re.compile(rf"//[^\n]*|/\*.*?\*/|{_QUOTED}|'(?:\\.|[^'\\\n])*'|`[^`]*`", re.S),
}
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "php": "php", "rs": "rust", "go": "go", "md": "markdown", "html": "html", "htm": "html"}


def generic_chunks(text: str, size: int = SIZES["generic"]) -> list[tuple]:
    """Lines packed until the next would exceed size; a longer line is a chunk of its own."""
    out, held, start, total = [], [], 1, 0
    for number, line in enumerate(text.split("\n"), 1):
        if held and total + len(line) + 1 > size:
            out.append(("file", f"lines {start}-{number - 1}", "\n".join(held), start, number - 1))
            held, start, total = [], number, 0
        held.append(line)
        total += len(line) + 1
    if any(x.strip() for x in held):
        out.append(("file", f"lines {start}-{start + len(held) - 1}", "\n".join(held), start, start + len(held) - 1))
    return out


def markdown_chunks(text: str, size: int = SIZES["markdown"]) -> list[tuple]:
    """Front matter, then sections by heading, named by the headings above them; fences hide headings; long sections are split."""
    lines, out, stack, at, fence = text.split("\n"), [], [], 0, None
    if lines and lines[0].strip() == "---":
        end = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None)
        if end:
            out.append(("file", "frontmatter", "\n".join(lines[: end + 1]), 1, end + 1))
            at = end + 1
    start, held = at, []

    def close(stop: int) -> None:
        body = "\n".join(held)
        if not body.strip():
            return
        name = " > ".join(t for _, t in stack) or "preamble"
        if len(body) <= size:
            out.append(("file", name, body, start + 1, stop))
            return
        for n, (_, _, part, a, b) in enumerate(generic_chunks(body, size), 1):
            out.append(("file", f"{name} ({n})", part, start + a, start + b))

    for i in range(at, len(lines)):
        mark = re.match(r"^\s*(`{3,}|~{3,})", lines[i])
        if mark:
            if fence is None:
                fence = mark[1]
            elif mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                fence = None
        head = None if fence or mark else re.match(r"^(#{1,6})\s+(.*?)\s*#*$", lines[i])
        if head:
            close(i)
            stack = [x for x in stack if x[0] < len(head[1])] + [(len(head[1]), head[2])]
            start, held = i, []
        held.append(lines[i])
    close(len(lines))
    return out


def _block_ends(plain: list[str]) -> list[int]:
    """For each line, the line where a definition that starts on it ends: where the braces opened from there on are closed, or at a `;` before any.

    The depth of braces after each line is compared with that before the
    definition by next smaller elements, so the whole is one pass.
    """
    n, depth = len(plain), [0]
    for x in plain:
        depth.append(depth[-1] + x.count("{") - x.count("}"))
    closed, held = [n] * (n + 1), []  # the first line after which depth is no more than depth[i]
    for i in range(n, -1, -1):
        while held and depth[held[-1]] > depth[i]:
            held.pop()
        closed[i] = held[-1] - 1 if held else n - 1
        held.append(i)
    ends, opens, stops = [0] * n, n, n
    for i in range(n - 1, -1, -1):
        opens = i if "{" in plain[i] else opens
        stops = i if plain[i].rstrip().endswith(";") else stops
        ends[i] = stops if stops < opens else closed[opens] if opens < n else n - 1
    return ends


def code_chunks(text: str, language: str) -> list[tuple]:
    """Definitions by pattern; a block ends by indentation (python) or where its braces close, but for braces in strings and comments."""
    lines, out = text.split("\n"), []
    plain = HIDDEN[language].sub(lambda m: re.sub(r"[^\n]", "_" if language == "python" else " ", m[0]), text).split("\n")
    ends = _block_ends(plain) if language != "python" else []
    widths = [len(x.expandtabs(4)) - len(x.expandtabs(4).lstrip()) for x in plain]
    for i, line in enumerate(plain):
        for kind, pattern in DEFINITIONS[language]:
            found = re.match(pattern, line)
            if not found:
                continue
            indent = len(found[1].expandtabs(4))
            end = i
            if language == "python":
                for j in range(i + 1, len(plain)):
                    if plain[j].strip(" \t_") and widths[j] <= indent and not plain[j].lstrip().startswith((")", "]")):
                        break
                    if lines[j].strip():
                        end = j
                end = max(k for k in range(i, end + 1) if widths[k] > indent or k == i or plain[k].lstrip().startswith((")", "]")))
                if kind == "function" and indent:
                    kind = "method"
            else:
                end = ends[i]
            out.append((kind, found[2], "\n".join(lines[i : end + 1]), i + 1, end + 1))
            break
    return out


class _Page(HTMLParser):
    def __init__(self, base: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.stack, self.out, self.links = base, [], [], []
        self.chunks, self.text, self.title = [], [], ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in HTML_BLOCKS or tag == "br":
            self.text.append("\n")
        if tag in HTML_CHUNKS and not self._in(HTML_STRIPPED):
            self.chunks.append({"tag": tag, "id": a.get("id") or "", "from": len(self.text), "line": self.getpos()[0]})
        if tag == "a" and a.get("href"):
            self.links.append({"href": a["href"], "attrs": a, "at": len(self.text), "context": self._context(), "bold": self._in({"b", "strong"}), "em": self._in({"em", "i"}), "text": ""})
        if tag not in VOID:
            self.stack.append(tag)
        if self.links and "a" in self.stack:
            self.links[-1]["bold"] |= tag in ("b", "strong")
            self.links[-1]["em"] |= tag in ("em", "i")

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack:
            top = self.stack.pop()
            if top in HTML_CHUNKS:
                self._close(top)
            if top == tag:
                break
        if tag in HTML_BLOCKS:
            self.text.append("\n")

    def handle_data(self, data):
        if self.links and "a" in self.stack:
            self.links[-1]["text"] += data
        if not self._in(HTML_STRIPPED) and "title" not in self.stack:
            self.text.append(data if self._in(HTML_KEPT) else re.sub(r"\s+", " ", data))

    def _in(self, names):
        return any(x in names for x in self.stack)

    def _context(self):
        return next((x for x in reversed(self.stack) if x in LINK_SCORES), "")

    def _close(self, tag):
        for c in reversed(self.chunks):
            if c["tag"] == tag and "to" not in c:
                c["to"], c["end"] = len(self.text), self.getpos()[0]
                return


def _flat(parts: list[str]) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in "".join(parts).split("\n"))).strip()


def html_chunks(text: str) -> list[tuple]:
    """Sections, articles, mains and asides; the whole body without any."""
    page = _Page()
    page.feed(text)
    page.close()
    lines, out = text.count("\n") + 1, []
    for c in page.chunks:
        body = _flat(page.text[c["from"] : c.get("to", len(page.text))])
        if body:
            out.append(("file", c["id"] or c["tag"], body, c["line"], c.get("end", lines)))
    if not out and (body := _flat(page.text)):
        out.append(("file", "body", body, 1, lines))
    return out


def page_links(text: str, base: str) -> list[tuple]:
    """(url, text, context, score, position): the first of each resolved address; fragments, scripts and mail are left out."""
    page = _Page(base)
    page.feed(text)
    page.close()
    out, seen = [], set()
    for i, link in enumerate(page.links):
        href = link["href"].strip()
        if not href or href.startswith("#") or href.lower().startswith(("javascript:", "mailto:")):
            continue
        try:
            url = urljoin(base, href)
        except ValueError:
            continue
        if url in seen:
            continue
        seen.add(url)
        a, score = link["attrs"], LINK_SCORES.get(link["context"], LINK_DEFAULT)
        score += LINK_BOLD * bool(link["bold"]) + LINK_EM * bool(link["em"]) + LINK_BUTTON * (a.get("role") == "button")
        score += LINK_CLASS * any(x in (a.get("class") or "") for x in ("btn", "button")) + LINK_TITLE * bool(a.get("title"))
        out.append((url, " ".join(link["text"].split()), link["context"], score, i))
    return out


def chunk_text(path: str, text: str) -> list[tuple]:
    language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower(), "text")
    found = markdown_chunks(text) if language == "markdown" else html_chunks(text) if language == "html" else code_chunks(text, language) if language in DEFINITIONS else []
    return [(path, *c, language) for c in found or generic_chunks(text)]


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of files (path, text), by extension; null texts have none."""

    def chunks(batches):
        for pdf in batches:
            rows = [c for path, text in zip(pdf["path"], pdf["text"], strict=True) if text for c in chunk_text(path, text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK.split(", ")])

    return files.select("path", "text").mapInPandas(chunks, CHUNK)


def overlapped(chunks: DataFrame, files: DataFrame, lines: int, most_bytes: int = 8000) -> DataFrame:
    """chunks with embed_text: each with `lines` lines of its file (path, text) before and after it, under the scope that holds it, cut at most_bytes.

    The first chunk of a file has none before it, the last none after it. The
    scope is a Go file's package. Null texts add nothing.
    """
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    w = W.partitionBy("path").orderBy("start_line", "end_line", "name")
    told = chunks.withColumns({"_n": F.row_number().over(w), "_last": F.count(F.lit(1)).over(W.partitionBy("path"))})
    joined = told.join(files.select(F.col("path").alias("_p"), F.split("text", "\n").alias("_lines"), F.regexp_extract("text", r"(?m)^package\s+(\w+)", 1).alias("_scope")), F.col("path") == F.col("_p"), "left")
    start = F.greatest(F.lit(0), F.col("start_line") - 1 - lines)
    before = F.when((F.col("_n") > 1) & (lines > 0), F.array_join(F.slice("_lines", start + 1, F.col("start_line") - 1 - start), "\n"))
    after = F.when((F.col("_n") < F.col("_last")) & (lines > 0), F.array_join(F.slice("_lines", F.col("end_line") + 1, F.lit(lines)), "\n"))
    scope = F.when((F.col("language") == "go") & (F.col("_scope") != ""), F.concat(F.lit("package "), F.col("_scope")))
    whole = F.concat_ws("\n", scope, F.nullif(before, F.lit("")), "content", F.nullif(after, F.lit("")))
    cut = F.decode(F.substring(F.encode(whole, "UTF-8"), 1, most_bytes), "UTF-8")
    return joined.withColumn("embed_text", F.when(F.octet_length(whole) > most_bytes, F.regexp_replace(cut, "\ufffd+$", "")).otherwise(whole)).select(*chunks.columns, "embed_text")


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, context, score, position) of pages (page_id, url, html)."""

    def links(batches):
        for pdf in batches:
            rows = [(i, *x) for i, base, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True) if html for x in page_links(html, base or "")]
            yield pd.DataFrame(rows, columns=["page_id", "url", "text", "context", "score", "position"])

    return pages.select("page_id", "url", "html").mapInPandas(links, "page_id long, url string, text string, context string, score int, position int")


def extract_refs(chunks: DataFrame) -> DataFrame:
    """(chunk_id, ref_type, ref_name) of code chunks (id, content): calls, imports and used types, by pattern."""
    from pyspark.sql import functions as F

    calls = F.transform(F.regexp_extract_all("content", F.lit(r"\b([A-Za-z_][\w.]*)\s*\("), F.lit(1)), lambda x: F.struct(F.lit("calls").alias("t"), F.substring_index(x, ".", -1).alias("n")))
    imports = F.transform(F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:import|from|use|require)\s+[\"'(]?([\w./:-]+)"), F.lit(1)), lambda x: F.struct(F.lit("imports").alias("t"), x.alias("n")))
    types = F.transform(F.regexp_extract_all("content", F.lit(r"(?::\s*|\*|\bnew\s+|\[\])([A-Z]\w*)"), F.lit(1)), lambda x: F.struct(F.lit("uses_type").alias("t"), x.alias("n")))
    skip = ("if", "for", "while", "switch", "return", "func", "function", "def", "catch")
    out = chunks.select(F.col("id").alias("chunk_id"), F.explode(F.array_distinct(F.concat(calls, imports, types))).alias("r"))
    return out.select("chunk_id", F.col("r.t").alias("ref_type"), F.col("r.n").alias("ref_name")).where(~F.col("ref_name").isin(*skip))
