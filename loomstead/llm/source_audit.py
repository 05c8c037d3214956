"""Source divergence audit: word distributions of sources priced by supports, without a dense table of terms."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstead.llm.common import staged, unstage

#: A term in UTF-8 bytes after A-Z are lower-cased: letters of ASCII and all beyond it.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Documents of a language that a kept term is in, at least.
LEAST_DOCS = 3
#: Ranks of the terms of a group.
TOP = 200
#: What probabilities are scaled to.
UNIT = 1_000_000_000
#: Terms that a task counts before it hands them on.
HELD = 400_000
#: Rows after which it does so too: so many have room beside the occurrences.
MOST_ROWS = 1 << 22
#: A row that holds a term, beside its occurrences, in one number.
_ROW = 1 << 40


def _counted(batches):
    """Counts of (lang, source, term) within a part of a task's rows: occurrences, and rows with the term."""
    groups: dict[tuple, dict[bytes, int]] = {}

    def out():
        sizes = [len(seen) for seen in groups.values()]
        terms = pa.array([term for seen in groups.values() for term in seen], pa.binary())
        told = np.fromiter((n for seen in groups.values() for n in seen.values()), np.int64, sum(sizes))
        names = [pa.array(np.repeat(np.array([key[i] for key in groups], object), sizes), pa.string()) for i in (0, 1)]
        groups.clear()
        return pa.RecordBatch.from_arrays([*names, terms.cast(pa.string()), pa.array(told % _ROW), pa.array(told // _ROW)], names=["lang", "source", "term", "c", "docs"])

    held = rows = 0
    for batch in batches:
        for lang, source, raw in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "raw")), strict=True):
            seen = groups.setdefault((lang, source), {})
            before, get = len(seen), seen.get
            for term, n in Counter(TERM.findall(raw.lower())).items():  # bytes.lower changes A-Z only
                seen[term] = get(term, 0) + n + _ROW
            held, rows = held + len(seen) - before, rows + 1
            if held > HELD or rows >= MOST_ROWS:
                yield out()
                held = rows = 0
    if groups:
        yield out()


def _p(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (n + v)), exactly."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + 1)
    return F.call_function("div", above, (n + v).cast("decimal(20,0)")) + 1


def _f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of longs up to UNIT + 1: no step leaves a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, c, docs) of docs: occurrences of every term and rows that hold it, counted in tasks before they are dealt out."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = rows.select("lang", "source", F.col("text").cast("binary").alias("raw"))
    told = rows.mapInArrow(_counted, "lang string, source string, term string, c long, docs long")
    return told.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))


def kept_postings(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, c, total, once) of the terms that least_docs rows of a language hold: total is the language's count; once marks one row of each term."""
    of = W.partitionBy("lang", "term")  # a row for each source
    told = counts.withColumns({"held": F.sum("docs").over(of), "total": F.sum("c").over(of), "rank": F.row_number().over(of.orderBy("source"))})
    return told.where(F.col("held") >= least_docs).select("lang", "source", "term", "c", "total", (F.col("rank") == 1).cast("long").alias("once"))


def group_figures(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, n, v, all_n, p0) of every (lang, source) of docs: its occurrences of kept terms, the language's kept terms and occurrences, and the probability of a term that it lacks (null without kept terms)."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    held = postings.groupBy(F.col("lang").alias("l1"), F.col("source").alias("s1")).agg(F.sum("c").alias("n"), F.sum("once").alias("once"))
    langs = held.groupBy(F.col("l1").alias("l2")).agg(F.sum("once").alias("v"), F.sum("n").alias("all_n"))
    rows = named.join(held, (F.col("lang") == F.col("l1")) & (F.col("source") == F.col("s1")), "left").join(langs, F.col("lang") == F.col("l2"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    rows = rows.select("lang", "source", zero("n"), zero("v"), zero("all_n"))
    return rows.withColumn("p0", F.when(F.col("v") > 0, _p(F.lit(0), F.col("n"), F.col("v"))))


def pair_values(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): for every two sources of a language the sum of f(p, q) over all its kept terms, p of source and q of item.

    By supports: as if neither had any term, a constant; for terms that one
    has, what they add where the other has none, from the histogram of its
    counts; for terms of both, what that is off, from their postings. A row of
    the last is made for two sources that share a term, once for both
    directions; histograms meet a source once for each of its distinct counts.
    """
    one, two = (groups.select("lang", F.col("source").alias(f"{x}_source"), "v", F.col("p0").alias(f"{x}_p0")) for x in "ab")
    pairs = one.join(two.drop("v"), "lang").where("a_source <> b_source")
    zero, p0, q0 = F.lit(0).cast("long"), F.col("a_p0"), F.col("b_p0")
    constant = pairs.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), F.coalesce(F.col("v") * _f(p0, q0), zero).alias("value"))

    figures = groups.select(F.col("lang").alias("l1"), F.col("source").alias("s1"), "n", "v")
    priced = postings.join(figures, (F.col("lang") == F.col("l1")) & (F.col("source") == F.col("s1"))).select("lang", "source", "term", "c", _p(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    histogram = priced.groupBy(F.col("lang").alias("l1"), F.col("source").alias("s1"), "p").agg(F.count(F.lit(1)).alias("terms"))
    met = histogram.join(pairs, (F.col("l1") == F.col("lang")) & (F.col("s1") == F.col("a_source")))
    p = F.col("p")
    sided = met.groupBy("lang", "a_source", "b_source").agg(F.sum(F.col("terms") * (_f(p, q0) - _f(p0, q0))).alias("ab"), F.sum(F.col("terms") * (_f(q0, p) - _f(q0, p0))).alias("ba"))

    terms = priced.join(groups.select(F.col("lang").alias("l1"), F.col("source").alias("s1"), "p0"), (F.col("lang") == F.col("l1")) & (F.col("source") == F.col("s1")))
    x, y = (terms.select("lang", "term", F.col("source").alias(f"{s}_source"), F.col("p").alias(f"{s}_p"), F.col("p0").alias(f"{s}_p0")) for s in "ab")
    both, q = x.join(y, ["lang", "term"]).where("a_source < b_source"), F.col("b_p")
    p = F.col("a_p")
    off = lambda p, q, p0, q0: F.sum(_f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0))
    shared = both.groupBy("lang", "a_source", "b_source").agg(off(p, q, p0, q0).alias("ab"), off(q, p, q0, p0).alias("ba"))
    ways = F.explode(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item"), F.col("ab").alias("value")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item"), F.col("ba").alias("value"))))
    added = sided.unionByName(shared).select("lang", ways.alias("x")).select("lang", "x.*")
    return constant.unionByName(added).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): f(p, q) of the terms that a source has and that are likelier there (p) than in its language (q)."""
    figures = groups.select(F.col("lang").alias("l1"), F.col("source").alias("s1"), "n", "v", "all_n")
    met = postings.join(figures, (F.col("lang") == F.col("l1")) & (F.col("source") == F.col("s1")))
    told = met.select("lang", "source", F.col("term").alias("item"), _p(F.col("c"), F.col("n"), F.col("v")).alias("p"), _p(F.col("total"), F.col("all_n"), F.col("v")).alias("q"))
    return told.where("p > q").select("lang", "source", "item", _f(F.col("p"), F.col("q")).alias("value"))


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far sources of a language are from each other (`pair`) and which terms set them apart from it (`term`, to rank `top`).

    Null text, lang and source are empty. Each row is a document, whatever its
    id, repeated rows too. A source without terms is met by the others of its
    language; where a language has no kept term, all its values are 0; a
    language of one source has no pair. Ties rank by item, bytewise. Other
    columns are ignored, whatever their names; an empty table gives none.
    """
    counts = term_counts(docs)
    postings = staged(kept_postings(counts, least_docs), "postings")
    groups = staged(group_figures(docs, postings), "groups")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).cast("int").alias("rank"))
    pairs = ranked(pair_values(postings, groups), "pair")
    return pairs.unionByName(ranked(term_values(postings, groups), "term").where(F.col("rank") <= top))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (n + v) AS p FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)) // (any_value(n) + any_value(v)) AS q FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pv AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
tv AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pv
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM tv) WHERE rank <= 200
"""
