"""Composite searches: dense, hybrid, prefiltered, multi-query, memory and offline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.operators import fusion, lexical, scoring, vectors


def filtered(chunks: DataFrame, *, type: str | None = None, language: str | None = None, file_path: str | None = None, domain: str | None = None, path_prefix: str | None = None, parity: bool = False, tags: list[str] | None = None, status: str | None = None, source: str | None = None) -> DataFrame:
    """Equality, prefix and tag filters, each optional; they reach the scan.

    parity: the prefix is a case-blind pattern with live wildcards. A tag
    matches any of a row's, whatever its case.
    """
    for name, value in (("type", type), ("language", language), ("file_path", file_path), ("domain", domain), ("status", status), ("source", source)):
        if value is not None:
            chunks = chunks.where(F.col(name) == value)
    if path_prefix:
        chunks = chunks.where(F.col("file_path").ilike(path_prefix + "%") if parity else F.col("file_path").startswith(path_prefix))
    if tags:
        wanted = [t.lower() for t in tags]
        chunks = chunks.where(F.exists("tags", lambda t: F.lower(t).isin(*wanted)))
    return chunks


def over_fetch(k: int, kind: str) -> int:
    """Candidates to fetch for k results, by what follows."""
    return {"rerank": max(5 * k, 50), "memory": max(3 * k, 50), "prefilter": max(10 * k, 100), "tags": min(3 * k, 1000)}[kind]


def dense_search(chunks: DataFrame, query: list[float], k: int = 10, threshold: float = 0.0, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    scored = vectors.score_against(chunks, query, vector).drop(vector)
    return scoring.percentile_labels(vectors.top_k(scored, k, id_col, threshold), id_col)


def rerank(candidates: DataFrame, score: Column, k: int, threshold: float = 0.0, id_col: str = "id") -> DataFrame:
    """Candidates with their scores replaced, sorted, cut at the threshold and then at k."""
    return vectors.top_k(candidates.withColumn("score", score), k, id_col, threshold)


def hybrid_search(dense: DataFrame, words: DataFrame, k: int = 10, method: str = "rrf", alpha: float | None = None, rrf_k: int = fusion.RRF_K, id_col: str = "id", decay: Column | None = None) -> DataFrame:
    """Fusion of a dense and a lexical list (id, score), labelled by percentile; a decay of the score comes before the cut."""
    if method not in ("rrf", "weighted"):
        raise ValueError(f"unknown method {method}")
    both = fusion.fuse_rrf([dense, words], rrf_k, id_col) if method == "rrf" else fusion.fuse_weighted(dense, words, alpha, id_col)
    if decay is not None:
        both = both.withColumn("score", decay)
    return scoring.percentile_labels(vectors.top_k(both, k, id_col), id_col)


def prefilter_search(chunks: DataFrame, allowed: DataFrame, query: list[float], k: int = 10, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """Dense search among the ids of a lexical result."""
    return dense_search(chunks.join(allowed.select(id_col).distinct(), id_col, "left_semi"), query, k, 0.0, id_col, vector)


def offline_search(chunks: DataFrame, query: str, k: int = 10, dims: int = 256, id_col: str = "id", text: str = "text") -> DataFrame:
    """Search with the keyword embedder, boosted by the query's words in the text, sorted after the boost."""
    embed = vectors.keyword_embedder(dims)
    spark = chunks.sparkSession
    wanted = spark.createDataFrame([(query,)], "q string").select(embed("q").alias("v")).first()["v"]
    words = [w for w in query.lower().split() if len(w) >= 2]
    scored = vectors.score_against(chunks.withColumn("_v", embed(F.col(text))), wanted, "_v").drop("_v")
    hits = sum((F.contains(F.lower(F.col(text)), F.lit(w)).cast("int") for w in words), F.lit(0))
    n = max(1, len(query.split()))
    boosted = F.when(hits > 0, scoring.clamped(F.col("score") + 0.2 * hits / n)).otherwise(F.col("score"))
    return vectors.top_k(scored.withColumn("score", boosted), k, id_col)


def memory_search(entries: DataFrame, query: list[float], words: str, as_of: Column, k: int = 10, half_life_days: float = 90.0, negative: bool = False) -> DataFrame:
    """Hybrid search over memory entries (id, question, answer, embedding, created_at) with temporal decay before the cut; negative: entries made after as_of gain instead of staying."""
    fetch = over_fetch(k, "memory")
    dense = vectors.top_k(vectors.score_against(entries.select("id", "embedding"), query).select("id", "score"), fetch)
    text = entries.select("id", F.concat_ws(" ", "question", "answer").alias("text"))
    lex = vectors.top_k(lexical.bm25(text, words), fetch)
    both = fusion.fuse_rrf([dense, lex]).join(entries.select("id", "created_at"), "id")
    decayed = both.withColumn("score", scoring.temporal_decay(F.col("score"), F.col("created_at"), as_of, half_life_days, negative))
    return scoring.percentile_labels(vectors.top_k(decayed.drop("created_at"), k))
