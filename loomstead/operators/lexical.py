"""Postings, BM25 and lexical search."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.plans.staging import staged

K1, B = 1.2, 0.75
# The endings of Porter's steps 2 to 4.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
TOKEN = r"[\p{L}\p{N}]+"
_QUERY_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def query_terms(query: str) -> list[str]:
    """The terms of a user's query; operators and quotes are nothing but separators."""
    return list(dict.fromkeys(_QUERY_TOKEN.findall(query.lower())))


def stem(word: str) -> str:
    """Porter's stem of a lower-case ASCII word of three letters or more; others stay."""
    if not re.fullmatch(r"[a-z]{3,}", word):
        return word
    c, v = r"(?:[^aeiou][^aeiouy]*)", r"(?:[aeiouy][aeiou]*)"
    measured = rf"^{c}?((?:{v}{c})*){v}?$"

    def m(stem_: str) -> int:
        found = re.match(measured, stem_)
        return len(re.findall(rf"{v}{c}", found[1])) if found else 0

    def vowel(stem_: str) -> bool:
        return re.search(rf"^{c}?{v}", stem_) is not None

    def short(stem_: str) -> bool:
        return re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", stem_) is not None and re.search(rf"^{c}[aeiouy][^aeiouwxy]$", stem_) is not None

    def swap(w: str, pairs: dict[str, str], least: int) -> str:
        for end in sorted(pairs, key=len, reverse=True):
            if w.endswith(end):
                return w[: -len(end)] + pairs[end] if m(w[: -len(end)]) > least else w
        return w

    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif re.search(r"([^aeiouylsz])\1$", w):
                    w = w[:-1]
                elif m(w) == 1 and short(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    w = swap(w, STEP_2, 0)
    w = swap(w, STEP_3, 0)
    for end in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(end):
            if m(w[: -len(end)]) > 1 and (end != "ion" or w[:-3].endswith(("s", "t"))):
                w = w[: -len(end)]
            break
    if w.endswith("e") and (m(w[:-1]) > 1 or m(w[:-1]) == 1 and not short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and m(w) > 1 else w


@F.pandas_udf(T.StringType())
def stems(words: pd.Series) -> pd.Series:
    known = {w: stem(w) for w in words.unique() if w is not None}
    return words.map(known)


def build_postings(docs: DataFrame, id_col: str = "id", text: str | list[str] = "text", stemmed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(postings (term, id, tf), stats (id, length)) of a corpus: the lexical side index.

    Several columns count as one text. Stems are made of words that are
    counted by document already, so each is looked up once a batch.
    """
    columns = [text] if isinstance(text, str) else text
    split = docs.select(F.col(id_col).alias("id"), tokens(F.concat_ws("\n", *columns)).alias("t"))
    postings = split.select("id", F.explode("t").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
    if stemmed:
        postings = postings.withColumn("term", stems("term")).groupBy("term", "id").agg(F.sum("tf").alias("tf"))
    return postings, split.select("id", F.size("t").alias("length"))


def deleted_postings(postings: DataFrame, stats: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The side index without some documents (id)."""
    gone = ids.select("id").distinct()
    return postings.join(gone, "id", "left_anti").select(*postings.columns), stats.join(gone, "id", "left_anti").select(*stats.columns)


def bm25(docs: DataFrame, query: str, id_col: str = "id", text: str = "text", match_all: bool = True) -> DataFrame:
    """(id, score) of the documents that hold the query's terms (all of them, or any).

    Only term counts of the query are made, in one scan whose counts are
    written, so no postings are shuffled; for many queries see
    bm25_from_postings. Corpus figures (documents, mean length, document
    frequencies) are one row, joined by a broadcast of that row.
    """
    terms = query_terms(query)
    if not terms:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    tf = [F.when(F.contains(low, F.lit(w)), F.regexp_count(low, F.lit(rf"{w}(?![\p{{L}}\p{{N}}])(?<![\p{{L}}\p{{N}}]{w})"))).otherwise(0).alias(f"tf{i}") for i, w in enumerate(terms)]
    counted = docs.select(F.col(id_col).alias("id"), F.regexp_count(low, F.lit(TOKEN)).alias("dl"), *tf)
    counted = staged(counted, "counts")  # a few numbers a document, read twice
    figures = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    both = counted.crossJoin(F.broadcast(figures))
    parts, held = [], []
    for i in range(len(terms)):
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - df + 0.5) / (df + 0.5)))
        parts.append(F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0))
        held.append(f > 0)
    keep = held[0]
    for h in held[1:]:
        keep = keep & h if match_all else keep | h
    return both.where(keep).select("id", sum(parts[1:], parts[0]).alias("score"))


def bm25_from_postings(postings: DataFrame, stats: DataFrame, query: str, stemmed: bool = False) -> DataFrame:
    """(id, score) with all terms, from a stored side index: only the query's postings are read."""
    terms = list(dict.fromkeys(map(stem, query_terms(query)))) if stemmed else query_terms(query)
    hits = postings.where(F.col("term").isin(*terms or [""]))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    figures = stats.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avgdl"))
    rows = hits.join(F.broadcast(df), "term").join(stats, "id").crossJoin(F.broadcast(figures))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    return rows.groupBy("id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(terms)).drop("_n")


def index_gaps(docs: DataFrame, postings: DataFrame, stats: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, side): documents missing from a side index, and index rows without a document."""
    ids = docs.select(F.col(id_col).alias("id"))
    missing = ids.join(stats, "id", "left_anti").select("id", F.lit("unindexed").alias("side"))
    extra = stats.select("id").union(postings.select("id")).distinct().join(ids, "id", "left_anti").select("id", F.lit("orphan").alias("side"))
    return missing.unionByName(extra)
