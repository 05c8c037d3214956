"""Quality rules by the divergence of distributions from language references."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import staged, window_hashes, word_spans, worker_cache

#: Longest word that can be a common word, in letters, and how many of a language are.
COMMON_LETTERS, COMMON_WORDS = 5, 40
#: Marks that may stand around a common word.
MARKS = 3
#: Parts of a whole that shares of characters are rounded to.
SHARES = 1000
#: Jensen-Shannon distances (base 2, 0 to 1) from the language's reference above which a document is rejected; that
#: of the common words has the second number over the root of the word count added, as short texts scatter more.
MOST_CLASSES, MOST_WORDS = 0.15, (0.25, 2.0)
#: Code points below which the classes, words below which the common words aren't judged.
LEAST_CHARS, LEAST_WORDS = 100, 60
#: Base rule: least words, and most percent of words in repeated windows of 8.
BASE_WORDS, BASE_REPEATED, BASE_WINDOW = 20, 30, 8
#: Words whose letters a worker keeps at once; their tables stay in its memory in later stages too.
KEPT_FORMS = 50_000

# The character classes, in order; every byte of UTF-8 that continues a character has none.
CLASSES = ("small or digit", "upper", "other sign", "space", "newline", "stop", "symbol", "control")
SYMBOLS, STOPS, SPACES = b"#*$%&|<>", b".,;:!?'\"()-", b" \t\x0b\x0c\r"
_STRIPPED = ".,;:!?'\"()-#*$%&|<>\u2013\u2014\u2018\u2019\u201c\u201d\u00ab\u00bb\u00bf\u00a1\u2026"


def _byte_class(b: int) -> int:
    if 128 <= b < 192:
        return 255
    if b in SPACES or b == 10:
        return 4 if b == 10 else 3
    if b in SYMBOLS or b in STOPS:
        return 6 if b in SYMBOLS else 5
    if b == 0xE2:  # general punctuation
        return 5
    if b < 32 or b == 127:
        return 7
    return 1 if 65 <= b < 91 else 0 if 48 <= b < 58 or 96 < b < 123 or b > 191 else 2


_CLASS_OF = bytes(_byte_class(b) for b in range(256))


def class_counts(raw: bytes) -> np.ndarray:
    """Characters of each class of a text in UTF-8; letters beyond ASCII count as small."""
    classes = raw.translate(_CLASS_OF)
    return np.array([classes.count(i) for i in range(len(CLASSES))], np.int64)


def letters_of(word: bytes) -> str:
    """The letters of a word, lower-cased, without marks around them; nothing if they are too many for a common word."""
    letters = word.decode("utf-8", "replace").strip(_STRIPPED).lower()
    return letters if len(letters) <= COMMON_LETTERS else ""


def short_words(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of the words that may be common ones, in references and documents alike: of COMMON_LETTERS + MARKS characters at most."""
    inside = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(inside)))
    return np.flatnonzero(before[ends] - before[starts] <= COMMON_LETTERS + MARKS)


def common_counts(raw: bytes, spans: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Counter:
    """How often a text holds each letters_of of its short words."""
    starts, ends, hashes = spans
    short = short_words(raw, starts, ends)
    few, first, times = np.unique(hashes[short], return_index=True, return_counts=True)
    forms, told = worker_cache("letters", dict), Counter()
    if len(forms) > KEPT_FORMS:
        forms.clear()
    for h, i, n in zip(few.tolist(), short[first].tolist(), times.tolist(), strict=True):
        if h not in forms:
            forms[h] = letters_of(raw[starts[i] : ends[i]])
        if forms[h]:
            told[forms[h]] += n
    return told


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms: the square root of the divergence in bits."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0.0) + np.where(q > 0, q * np.log2(q / m), 0.0)
    return math.sqrt(min(1.0, max(0.0, float(parts.sum()) / 2)))


def base_counts(raw: bytes, hashes: np.ndarray, classes: np.ndarray) -> dict[str, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8; ASCII white space parts words."""
    n, seen, doubled, repeated = len(hashes), set(), 0, 0
    for line in raw.split(b"\n"):
        if line in seen:
            doubled += 1
        elif line.strip():  # of bytes: ASCII white space
            seen.add(line)
    if n > BASE_WINDOW:
        windows = window_hashes(hashes, BASE_WINDOW)
        ordered = np.sort(windows)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(again):
            at = np.flatnonzero(np.isin(windows, again))
            steps = np.zeros(n + 1, np.int64)
            steps[at] += 1
            steps[at + BASE_WINDOW] -= 1
            repeated = int((np.cumsum(steps[:-1]) > 0).sum())
    points = len(raw) - raw.translate(_CLASS_OF).count(255)
    return {"n_words": n, "word_chars": points - int(classes[3] + classes[4]), "n_symbols": int(classes[6]), "n_dup_lines": doubled, "n_repeat_words": repeated}


def base_failed(counts: dict[str, int]) -> bool:
    return counts["n_words"] < BASE_WORDS or 100 * counts["n_repeat_words"] > BASE_REPEATED * counts["n_words"]


def _histograms(batches):
    """Sums of a task by language: documents by class and its share in thousandths, and short words, a row each, given out when its tables are full or the task ends."""
    counts: dict[tuple, int] = {}  # by language and hash of a short word as it stands
    forms: dict[int, str] = {}  # its letters
    sums: dict[tuple, int] = {}

    def out():
        for (lang, h), n in counts.items():
            if forms[h]:
                sums[lang, "word", forms[h]] = sums.get((lang, "word", forms[h]), 0) + n
        keys, values = list(sums), list(sums.values())
        for table in (counts, forms, sums):
            table.clear()
        return pa.record_batch([pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array(values, pa.int64())], names=["lang", "kind", "name", "n"])

    for batch in batches:
        found: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            classes, (starts, ends, hashes) = class_counts(raw), word_spans(raw)
            if classes.sum():
                for name, share in zip(CLASSES, np.rint(classes * SHARES / classes.sum()).astype(int).tolist(), strict=True):
                    key = (lang, "class", f"{name}:{share}")
                    sums[key] = sums.get(key, 0) + 1
            sums[lang, "all", ""] = sums.get((lang, "all", ""), 0) + len(hashes)
            short = short_words(raw, starts, ends)
            few, first = np.unique(hashes[short], return_index=True)
            found.setdefault(lang, []).append(hashes[short])
            for h, i in zip(few.tolist(), short[first].tolist(), strict=True):
                if h not in forms:
                    forms[h] = letters_of(raw[starts[i] : ends[i]])
        for lang, arrays in found.items():
            for h, n in zip(*(x.tolist() for x in np.unique(np.concatenate(arrays), return_counts=True)), strict=True):
                counts[lang, h] = counts.get((lang, h), 0) + n
        if len(forms) > KEPT_FORMS:
            yield out()
    if sums:
        yield out()


def language_references(docs: DataFrame) -> dict[str, dict]:
    """lang to its histograms over all its documents: the median share of each class of characters, and its common words.

    Every document with characters counts once for the shares, so the median
    is that of most documents, however odd or long some are; every word counts
    for the words. Tasks sum documents by class and share, and short words;
    the COMMON_WORDS most frequent of a language (ties by code point) make its
    common words. Only those and the shares' counts go to the driver: at most
    as many numbers a language as there are classes and thousandths. Rows
    without lang aren't counted.
    """
    from pyspark.sql import Window as W

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null")
    sums = rows.mapInArrow(_histograms, "lang string, kind string, name string, n long").groupBy("lang", "kind", "name").agg(F.sum("n").alias("n"))
    sums = staged(sums, "histograms")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "name"))
    top = sums.where("kind = 'word'").withColumn("r", rank).where(F.col("r") <= COMMON_WORDS).drop("r")
    found: dict[str, dict] = {}
    shares: dict[str, np.ndarray] = {}
    for lang, kind, name, n in sums.where("kind <> 'word'").unionByName(top).collect():
        one = found.setdefault(lang, {"words": {}, "all": 0})
        of = shares.setdefault(lang, np.zeros((len(CLASSES), SHARES + 1), np.int64))
        if kind == "class":
            of[CLASSES.index(name.split(":")[0]), int(name.split(":")[1])] = n
        elif kind == "word":
            one["words"][name] = n
        else:
            one["all"] = n
    for lang, of in shares.items():
        sums_up = np.cumsum(of, axis=1)
        found[lang]["classes"] = (2 * sums_up >= sums_up[:, -1:]).argmax(axis=1).astype(float)
    return {k: v for k, v in sorted(found.items()) if v["all"] and v["classes"].sum()}


def distances(n_words: int, common: Counter, classes: np.ndarray, reference: dict) -> tuple[float, float]:
    """(classes, common words) distances of a text from a reference; both count words by letters_of."""
    by_class = divergence(classes + 0.0, reference["classes"])
    known = reference["words"]
    held = [common[w] for w in known]
    own = np.array([*held, n_words - sum(held)], float)
    whole = np.array([*known.values(), max(0, reference["all"] - sum(known.values()))], float)
    return by_class, divergence(own, whole) if own.sum() else 1.0


def verdict(n_words: int, common: Counter, classes: np.ndarray, lang: str | None, references: dict[str, dict]) -> tuple[bool, float, float]:
    """(kept, classes, words): the nearest reference decides where the language is unknown.

    Rejected: classes further than MOST_CLASSES in a text of LEAST_CHARS, or
    common words further than MOST_WORDS in one of LEAST_WORDS. Without any
    reference, and without characters, nothing is rejected.
    """
    if not references or not classes.sum():
        return True, 0.0, 0.0
    tried = [lang] if lang in references else list(references)
    by_class, by_word = min((distances(n_words, common, classes, references[r]) for r in tried), key=sum)
    bad = classes.sum() >= LEAST_CHARS and by_class > MOST_CLASSES or n_words >= LEAST_WORDS and by_word > MOST_WORDS[0] + MOST_WORDS[1] / math.sqrt(n_words)
    return not bad, by_class, by_word


def _judged(references: dict[str, dict]):
    def judge(batches):
        for batch in batches:
            columns: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                spans, classes = word_spans(raw), class_counts(raw)
                counts = base_counts(raw, spans[2], classes)
                failed = base_failed(counts)
                kept, by_class, by_word = verdict(len(spans[2]), common_counts(raw, spans), classes, lang, references)
                row = counts | {"base_failed": failed, "kept": bool(kept and not failed), "class_distance": by_class, "word_distance": by_word}
                for k, v in row.items():
                    columns[k].append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            own = [batch.column(i) for i, name in enumerate(batch.schema.names)]
            yield pa.record_batch([*own, *(pa.array(v, t) for v, t in zip(columns.values(), kinds, strict=True))], names=[*batch.schema.names, *columns])

    return judge


_ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def quality_rules(docs: DataFrame, references: dict[str, dict] | None = None) -> DataFrame:
    """doc_id, text, lang, source, n_chars with the counts and verdicts of every document.

    references default to those of the documents themselves. kept is false
    for documents that fail the base rules or diverge (see verdict). Null
    texts have no words and fail. Null or unseen languages are judged by the
    nearest reference. Repeated rows are judged alike; columns other than the
    five are ignored, and missing ones of these but text are null. An empty
    table gives none.
    """
    if references is None:
        references = language_references(docs)
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    rows = docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    return rows.mapInArrow(_judged(references), ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", " + _ADDED)
