"""Substring dedup: winnowed anchors seed matches, contexts and windows extend them, maximal repeats are cut out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import mixed, staged, unstage, word_spans, worker_cache

#: Words of a repeat, at least.
LEAST = 50
#: Words of a seed. Of the (LEAST - GRAM + 1) seeds in a window one is its anchor: about one word in 16 is in the end.
GRAM = 20
_RADIX = 0x9FB21C651E98DF25


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 14)
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, r, np.uint64))), dtype=np.uint64) for r in (_RADIX, pow(_RADIX, -1, 1 << 64)))


class _Runs:
    """Hashes of any runs of a sequence of word hashes, each in constant time."""

    def __init__(self, words: np.ndarray) -> None:
        self.powers = worker_cache("run_powers", _Powers)
        self.powers.reach(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mixed(words) * self.powers.up[: len(words)], out=self.sums[1:])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of words first to last - 1; they tell lengths apart."""
        return mixed((self.sums[last] - self.sums[first]) * self.powers.down[first] + (last - first).astype(np.uint64))


def anchors(words: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, context, place, start, runs) of a document's anchors, from the hashes of its words.

    The anchor of a window of `least` words is its least seed of `gram` words,
    the first of equal ones: equal windows have equal anchors at equal places.
    A row stands for `runs` consecutive windows from `start` on whose anchor
    is the seed at `place`; context is the hash of all words in them. So each
    window belongs to one row, and a shorter document has none.
    """
    n = len(words) - least + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    run = _Runs(words)
    seed = np.arange(len(words) - gram + 1)
    seeds = run(seed, seed + gram)
    best = np.lib.stride_tricks.sliding_window_view(seeds, least - gram + 1).argmin(axis=1) + np.arange(n)
    edge = np.flatnonzero(best[1:] != best[:-1]) + 1
    start, end = np.concatenate(([0], edge)), np.concatenate((edge, [n]))
    place, runs = best[start], end - start
    context = run(start, end + least - 1) ^ mixed((place - start).astype(np.uint64))
    return seeds[place], context, place, start, runs


def _anchored(least: int, gram: int):
    def run(batches):
        for batch in batches:
            columns = [[], [], [], [], [], []]
            for d, th, raw in zip(batch.column("d").to_numpy(), batch.column("th").to_numpy(), batch.column("raw").to_pylist(), strict=True):
                anchor, context, _, start, runs = anchors(word_spans(raw)[2], least, gram)
                for column, x in zip(columns, (anchor.view(np.int64), context.view(np.int64), np.full(len(start), d), np.full(len(start), th), start.astype(np.int32), runs.astype(np.int32)), strict=True):
                    column.append(x)
            arrays = [np.concatenate(c) for c in columns] if columns[0] else []
            if arrays:
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["anchor", "context", "d", "th", "start", "runs"])

    return run


def _extended(least: int):
    """The windows of every class that a row's text shows, each a hash."""

    def run(batches):
        for batch in batches:
            columns = [[], [], [], [], []]
            for d, raw, shown in zip(batch.column("d").to_pylist(), batch.column("raw").to_pylist(), batch.column("shown").to_pylist(), strict=True):
                hashes = _Runs(word_spans(raw)[2])
                of = np.array([(x["anchor"], x["context"], x["start"], x["runs"]) for x in shown], np.int64)
                which = np.repeat(np.arange(len(of)), of[:, 3])
                i = np.arange(len(which)) - np.repeat(np.cumsum(of[:, 3]) - of[:, 3], of[:, 3])
                at = of[which, 2] + i
                for column, x in zip(columns, (of[which, 0], of[which, 1], i.astype(np.int32), hashes(at, at + least).view(np.int64), np.full(len(i), d)), strict=True):
                    column.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["anchor", "context", "i", "window", "d"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, d, th, raw): a row's place in the order of ids (null: after all others), a hash and the bytes of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("raw"))


def covered_windows(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(d, th, start, mask): windows of docs that also start in a row with a smaller id; bit i of mask is the window from start + i on.

    Seed: rows meet on their anchors; anchors of one id alone go. Extend:
    occurrences of an anchor with the same context, the words of all windows
    around it, are one class. In a class all but the least id are covered
    throughout, without a pair. Where an anchor has several classes, each is
    shown by its least row, whose windows, from the anchor as far to the left
    and right as they hold it, meet those of the other classes by hash; the
    least id of a window covers the others. So work grows with occurrences
    and windows of classes, never with their pairs; equality is that of 128
    bits, of the anchor and of a context or window.
    """
    rows = _keyed(docs)
    schema = "anchor long, context long, d long, th long, start int, runs int"
    seeds = rows.select("d", "th", "raw").mapInArrow(_anchored(least, gram), schema)
    shared = seeds.groupBy("anchor").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select(F.col("anchor").alias("of"))
    shared = staged(shared, "shared")  # an exchange of its own for each side, so that a hot anchor's rows can be split
    met = staged(seeds.join(shared.hint("merge"), F.col("anchor") == F.col("of"), "left_semi"), "seeds")

    classes = staged(met.groupBy("anchor", "context").agg(F.min(F.struct("d", "th", "start", "runs")).alias("x")).select("anchor", "context", "x.*"), "classes")
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("anchor").alias("of"))
    shown = classes.join(several, F.col("anchor") == F.col("of"), "left_semi")
    shown = shown.groupBy(F.col("d").alias("d1"), F.col("th").alias("th1")).agg(F.collect_list(F.struct("anchor", "context", "start", "runs")).alias("shown"))
    texts = rows.join(shown, (F.col("d") == F.col("d1")) & (F.col("th") == F.col("th1"))).select("d", "raw", "shown")
    windows = staged(texts.mapInArrow(_extended(least), "anchor long, context long, i int, window long, d long"), "windows")
    first = windows.groupBy(F.col("anchor").alias("a1"), F.col("window").alias("w1")).agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi")
    later = windows.join(first, (F.col("anchor") == F.col("a1")) & (F.col("window") == F.col("w1")) & (F.col("d") > F.col("lo")))
    masks = later.groupBy(F.col("anchor").alias("a1"), F.col("context").alias("c1")).agg(F.expr("bit_or(shiftleft(1L, i))").alias("partly"))
    told = classes.join(masks, (F.col("anchor") == F.col("a1")) & (F.col("context") == F.col("c1")), "left")
    told = told.select(F.col("anchor").alias("a2"), F.col("context").alias("c2"), F.col("d").alias("least"), F.coalesce("partly", F.lit(0).cast("long")).alias("partly"))
    told = staged(told, "masks")

    whole = F.expr("shiftleft(1L, runs) - 1")
    members = met.join(told, (F.col("anchor") == F.col("a2")) & (F.col("context") == F.col("c2")))
    members = members.select("d", "th", "start", F.when(F.col("d") > F.col("least"), whole).otherwise(F.col("partly")).alias("mask")).where("mask <> 0")
    found = staged(members.distinct(), "covered")  # rows that are equal throughout show the same windows
    unstage(shared, met, classes, windows, told)
    return found


def covered_words(n: int, spans: list[tuple[int, int]], least: int = LEAST) -> np.ndarray:
    """For each of n words whether a window of spans (start, mask) covers it."""
    change = np.zeros(n + 1, np.int64)
    if spans:
        told = np.array(spans, np.int64)
        bits = (told[:, 1:] >> np.arange(int(told[:, 1].max()).bit_length())) & 1
        which, i = np.nonzero(bits)
        at = told[which, 0] + i
        np.add.at(change, at, 1)
        np.add.at(change, at + least, -1)
    return np.cumsum(change[:-1]) > 0


def _cut(least: int):
    names = ["doc_id", "n_words", "n_removed", "text", "repeats"]
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for doc_id, raw, spans in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words, repeats, gone = raw.split(), [], 0
                n = len(words)
                if spans:
                    cover = covered_words(n, [(x["start"], x["mask"]) for x in spans], least)
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], cover.view(np.int8), [0]))))
                    repeats = [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    gone = int(cover.sum())
                    words = [words[i] for i in np.flatnonzero(~cover)]
                for column, x in zip(out, (doc_id, n, gone, b" ".join(words).decode("utf-8", "replace"), repeats), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), kind), strict=True)], names=names)

    return run


def cut_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, text, repeats of every row of docs: the text without what rows with smaller ids hold too.

    A word goes if a window of `least` consecutive words covers it whose words
    also start in a row with a smaller id, in the texts as given. repeats are
    the maximal runs of such words (first, last; from 0); text is the other
    words, joined by one space. least - gram may be 61 at most.

    Null texts are empty: no words. Rows with equal ids take nothing from each
    other (repeated rows each stay), null ids come after all others, as the
    greatest. Texts of any length are taken whole. Other columns are ignored,
    whatever their names; an empty table gives none.
    """
    if not 0 < gram <= least <= gram + 61:
        raise ValueError("gram must be from least - 61 to least")
    spans = covered_windows(docs, least, gram).groupBy(F.col("d").alias("d1"), F.col("th").alias("th1")).agg(F.collect_list(F.struct("start", "mask")).alias("spans"))
    rows = _keyed(docs)
    joined = rows.join(spans, (rows.d == F.col("d1")) & (rows.th == F.col("th1")), "left").select("doc_id", "raw", "spans")
    return joined.mapInArrow(_cut(least), "doc_id long, n_words long, n_removed long, text string, repeats array<struct<first: long, last: long>>")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS o, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
x AS (SELECT r, o, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
h AS (SELECT r, o, i, n, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h FROM x),
l AS (SELECT r, i, o > min(o) OVER (PARTITION BY h) AS late FROM h WHERE i <= n - 49),
g AS (SELECT r, i, count(*) FILTER (WHERE late) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone FROM x LEFT JOIN l USING (r, i)),
k AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM x JOIN g USING (r, i) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
