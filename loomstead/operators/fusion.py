"""Fusion of ranked lists, multi-query boosts and regrouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60
BOOST, MOST_QUERIES = 0.05, 10


def ranked(df: DataFrame, id_col: str = "id", by: list[str] | None = None) -> DataFrame:
    """df with rank: place by score, ties by id; lists are bounded results, so one window a list is small."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*(by or [])).orderBy(F.desc("score"), F.asc(id_col))))


def fuse_rrf(lists: list[DataFrame], k: int = RRF_K, id_col: str = "id", limit: int = 0) -> DataFrame:
    """(id, score): sum of 1 / (k + rank) over the lists, which have id and score; best first, ties by id."""
    if k <= 0:
        raise ValueError("k must be positive")
    parts = [ranked(x.select(id_col, "score"), id_col).select(id_col, (1.0 / (F.lit(k) + F.col("rank"))).alias("part")) for x in lists]
    summed = reduce(DataFrame.unionByName, parts).groupBy(id_col).agg(F.sum("part").alias("score"))
    ordered = summed.orderBy(F.desc("score"), F.asc(id_col))
    return ordered.limit(limit) if limit > 0 else ordered


def fuse_weighted(dense: DataFrame, lexical: DataFrame, alpha: float | None = None, id_col: str = "id", limit: int = 0) -> DataFrame:
    """(id, score): alpha * dense + (1 - alpha) * lexical, a missing side is 0; alpha None is 0.7."""
    alpha = 0.7 if alpha is None else alpha
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be between 0 and 1")
    parts = dense.select(id_col, (F.col("score") * alpha).alias("part")).unionByName(lexical.select(id_col, (F.col("score") * (1 - alpha)).alias("part")))
    ordered = parts.groupBy(id_col).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), F.asc(id_col))
    return ordered.limit(limit) if limit > 0 else ordered


def boosted(score: Column, matches: Column) -> Column:
    return F.least(F.lit(1.0), score + BOOST * (matches - 1))


def multisearch(hits: DataFrame, queries: list[str], id_col: str = "id", limit: int = 0) -> DataFrame:
    """(id, base, score, matched) from hits (query, id, score): best score a row, boosted by the number of queries that found it.

    matched lists the queries in their given order. At most MOST_QUERIES queries, none twice or empty.
    """
    if not queries or len(queries) > MOST_QUERIES or len(set(queries)) < len(queries) or not all(queries):
        raise ValueError("one to ten different queries are asked for")
    found = hits.groupBy(id_col).agg(F.max("score").alias("base"), F.collect_set("query").alias("found"))
    matched = F.filter(F.array(*[F.lit(q) for q in queries]), lambda q: F.array_contains(F.col("found"), q))
    out = found.select(id_col, "base", boosted(F.col("base"), F.size("found")).alias("score"), matched.alias("matched"))
    ordered = out.orderBy(F.desc("score"), F.asc(id_col))
    return ordered.limit(limit) if limit > 0 else ordered


def by_query(results: DataFrame, queries: list[str]) -> DataFrame:
    """(query, results): a group for each query, empty ones as well."""
    spark = results.sparkSession
    wanted = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "place int, query string")
    rows = results.withColumn("query", F.explode("matched"))
    return wanted.join(rows, "query", "left").orderBy("place")


def by_collection(results: DataFrame, domain: str = "domain") -> DataFrame:
    """results with their collection: an empty or null domain is `default`."""
    return results.withColumn("collection", F.when(F.coalesce(F.col(domain), F.lit("")) == "", "default").otherwise(F.col(domain)))


def max_union(lists: list[DataFrame], id_col: str = "id") -> DataFrame:
    """Union of result lists, the best scored row of each id."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists)
    rest = [c for c in both.columns if c != id_col]
    best = both.groupBy(id_col).agg(F.max_by(F.struct(*rest), "score").alias("best"))
    return best.select(id_col, *[F.col(f"best.{c}").alias(c) for c in rest])
