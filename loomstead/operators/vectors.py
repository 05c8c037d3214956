"""Vector similarity, exact top-k, quantisation and embedding codecs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query vectors that are broadcast at most; more are scored in blocks of so many.
QUERY_BLOCK = 256


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for differing sizes, null vectors and zero norms."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), 0.0).when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def score_against(corpus: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    """corpus with a score: its cosine with one query vector, which is a literal of the plan, as is its norm."""
    a, norm = F.col(vector), float(np.linalg.norm(np.asarray(query, np.float64)))
    norms = F.sqrt(dot(a, a)) * norm
    along = dot(a, F.array(*[F.lit(float(x)) for x in query]))
    return corpus.withColumn("score", F.when(F.coalesce(F.size(a), F.lit(-1)) != len(query), 0.0).when(norms > 0, along / norms).otherwise(0.0))


def matrix_scores(corpus: DataFrame, queries: list[tuple[str, list[float]]], id_col: str = "id", vector: str = "embedding", floor: float | None = None) -> DataFrame:
    """(query, id, score) of every query against every row, by one matrix product a batch.

    Queries are a stated, bounded set; they go with the tasks in blocks of QUERY_BLOCK.
    """
    names = [q for q, _ in queries]
    wanted = [np.asarray(v, np.float64) for _, v in queries]

    def scored(batches):
        for pdf in batches:
            for start in range(0, len(wanted), QUERY_BLOCK):
                for size, rows in pdf.groupby(pdf[vector].map(lambda v: -1 if v is None else len(v))):
                    m = np.stack(rows[vector].to_numpy()).astype(np.float64) if size > 0 else np.zeros((len(rows), 1))
                    norm = np.linalg.norm(m, axis=1)
                    for name, q in zip(names[start : start + QUERY_BLOCK], wanted[start : start + QUERY_BLOCK], strict=True):
                        d = norm * np.linalg.norm(q)
                        s = np.divide(m @ q, d, out=np.zeros(len(rows)), where=d > 0) if len(q) == size else np.zeros(len(rows))
                        keep = slice(None) if floor is None else s >= floor
                        yield pd.DataFrame({"query": name, "id": rows[id_col].to_numpy()[keep], "score": s[keep]})

    kind = corpus.schema[id_col].dataType.simpleString()
    return corpus.select(id_col, vector).mapInPandas(scored, f"query string, id {kind}, score double")


def top_k(scored: DataFrame, k: int, id_col: str = "id", threshold: float = 0.0) -> DataFrame:
    """The k best rows by score, ties by id; all if k is 0; a positive threshold drops rows below it first."""
    kept = scored.where(F.col("score") >= threshold) if threshold > 0 else scored
    ordered = kept.orderBy(F.desc("score"), F.asc(id_col))
    return ordered.limit(k) if k > 0 else ordered


def top_k_each(scored: DataFrame, by: list[str], k: int, id_col: str = "id") -> DataFrame:
    """The k best rows of each group; Spark keeps k a task and group before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), F.asc(id_col)))
    ranked = scored.withColumn("rank", rank)
    return ranked.where(F.col("rank") <= k) if k > 0 else ranked


def quantise(vector: Column) -> Column:
    """struct(data, scale, offset): values mapped to 0..254, shifted by -127, cut toward zero; null for empty vectors."""
    low, high = F.array_min(vector), F.array_max(vector)
    scale = F.when(high == low, F.lit(1.0).cast("float")).otherwise(((high - low) / F.lit(254.0)).cast("float"))
    data = F.transform(vector, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), (x - low).cast("double") / scale - 127.0)).cast("tinyint"))
    return F.when(F.size(vector) > 0, F.struct(data.alias("data"), scale.alias("scale"), low.alias("offset")))


def dequantise(compact: Column) -> Column:
    return F.transform(compact["data"], lambda x: ((x.cast("double") + 127.0) * compact["scale"] + compact["offset"]).cast("float"))


@F.pandas_udf(T.BinaryType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").copy())


def mean_pool(tokens: DataFrame, by: str = "id", vector: str = "embedding") -> DataFrame:
    """(by, embedding): mean of the token vectors of each id, dimension by dimension."""
    spread = tokens.select(by, F.posexplode(vector).alias("place", "value"))
    means = spread.groupBy(by, "place").agg(F.avg("value").alias("value"))
    collected = means.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("x"))
    return collected.select(by, F.transform("x", lambda s: s["value"]).alias("embedding"))


def keyword_embedder(dims: int = 256):
    """A pandas UDF: hashed words and pairs of words, weighted by place, of length one; deterministic and offline."""
    import re

    word = re.compile(r"[a-z0-9_]+")

    def fnv1a(text: str) -> int:
        h = 0x811C9DC5
        for b in text.encode():
            h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
        return h

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        def one(text):
            v = np.zeros(dims, np.float32)
            words = word.findall((text or "").lower())
            for i, w in enumerate(words):
                if len(w) < 2:
                    continue
                at = fnv1a(w) % dims
                v[at] = (v[at] + np.float32(1)) * np.float32(1 + 0.1 / (1 + i // 5))
                if i + 1 < len(words):
                    v[fnv1a(f"{w}_{words[i + 1]}") % dims] += np.float32(0.5)
            norm = float(np.sqrt((v * v).sum()))
            return v / np.float32(norm) if norm else v

        return texts.map(one)

    return embed
