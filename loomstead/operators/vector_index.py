"""Approximate dense search: inverted lists over a coarse quantiser, product codes, and an exact re-rank."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstead.plans.staging import staged, unstage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no installed copy of it

#: Rows that centroids and codes are fitted on, at most; every row is indexed.
SAMPLE = 20_000
#: Lists of an index, at most.
LISTS = 4096
#: Rows of a list that one task meets, about, and queries that it meets them with.
CHUNK, QUERIES = 50_000, 20_000
ROWS = "id {id}, unit array<float>, code binary, chunk int, list int"


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def k_means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k centroids, or as many as there are points; empty ones move to the point that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        far = (points * points).sum(1)[:, None] - 2 * points @ centroids.T + (centroids * centroids).sum(1)
        own = far.argmin(1)
        for i in range(len(centroids)):
            mine = points[own == i]
            centroids[i] = mine.mean(0) if len(mine) else points[far.min(1).argmax()]
    return centroids


def nearest(points: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centroids of every point, the nearest first."""
    far = (centroids * centroids).sum(1) - 2 * points @ centroids.T
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def _stack(vectors: pd.Series, size: int) -> np.ndarray:
    """Unit vectors; those of another size, or null, are zeros."""
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == size:
            out[i] = np.nan_to_num(np.asarray(v, np.float64))
    return _unit(out)


class VectorIndex:
    """Unit vectors by list, with their codes, in a folder that all executors share (see build)."""

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray, codes: list[np.ndarray], id_type: str) -> None:
        self.spark, self.path, self.centroids, self.codes, self.id_type = spark, path, centroids, codes, id_type

    @classmethod
    def build(cls, rows: DataFrame, path: str, lists: int | None = None, parts: int = 8, words: int = 64, vector: str = "embedding") -> VectorIndex:
        """Index rows (id, vector), all of them.

        Centroids (`lists`, or the square root of the number of rows, LISTS at
        most) and the code words of `parts` slices of a vector are fitted on the
        driver on about SAMPLE rows, drawn by a hash of the id. Each row goes to
        the list of its nearest centroid; lists are folders, dealt out in chunks
        of about CHUNK rows. The size of vectors is the most frequent one; rows
        of another, nulls and zeros have no direction: they have similarity 0
        to all. Repeated rows stay; other columns are ignored; an empty table
        gives an index without rows.
        """
        spark = rows.sparkSession
        given = rows.select("id", F.col(vector).cast("array<float>").alias("v"))
        sizes = given.where("size(v) > 0").groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
        size, n = (sizes["size"], sizes["n"]) if sizes else (1, 0)
        drawn = given.where((F.size("v") == size) & (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < math.ceil(min(1.0, SAMPLE / max(1, n)) * 1_000_000)))
        sample = _stack(drawn.orderBy(F.xxhash64("id", "v")).limit(2 * SAMPLE).toPandas()["v"], size)  # a limit of the fit's memory, twice what is drawn
        sample = sample if len(sample) else np.zeros((1, size))
        centroids = k_means(sample, lists or max(1, min(LISTS, round(math.sqrt(n)))))
        bounds = np.linspace(0, size, min(parts, size) + 1).astype(int)
        codes = [k_means(sample[:, a:b], words, seed=5 + i) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
        id_type = rows.schema["id"].dataType.simpleString()

        def coded(batches):
            for pdf in batches:
                unit = _stack(pdf["v"], size)
                told = np.stack([nearest(unit[:, a:b], c)[:, 0] for c, a, b in zip(codes, bounds[:-1], bounds[1:], strict=True)], 1).astype(np.uint8)
                yield pd.DataFrame({"id": pdf["id"], "unit": list(unit.astype(np.float32)), "code": [x.tobytes() for x in told], "list": nearest(unit, centroids)[:, 0].astype(np.int32)})

        told = staged(given.mapInPandas(coded, f"id {id_type}, unit array<float>, code binary, list int"), "coded")
        held = told.groupBy(F.col("list").alias("l")).agg(F.count(F.lit(1)).alias("n"))  # a row for each list
        chunk = F.expr(f"cast(pmod(xxhash64(id), ceil(n / {CHUNK})) as int)")
        met = told.join(F.broadcast(held), F.col("list") == F.col("l")).withColumn("chunk", chunk)
        met.select("id", "unit", "code", "chunk", "list").repartition("list", "chunk").write.mode("overwrite").partitionBy("list").parquet(path)
        unstage(told)
        return cls(spark, path, centroids, codes, id_type)

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """The rows of some lists, or of all; other lists are not read."""
        rows = self.spark.read.schema(ROWS.format(id=self.id_type)).parquet(self.path)
        return rows if lists is None else rows.where(F.col("list").isin(*lists))

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """(q, unit, list): every query (q, vector) with the lists of its nearest centroids."""
        centroids = self.centroids

        def near(batches):
            for pdf in batches:
                unit = _stack(pdf["vector"], centroids.shape[1])
                lists = nearest(unit, centroids, probes)
                yield pd.DataFrame({"q": pdf["q"], "unit": list(unit.astype(np.float32)), "lists": list(lists.astype(np.int32))})

        kind = queries.schema["q"].dataType.simpleString()
        told = queries.select("q", F.col("vector").cast("array<float>").alias("vector")).mapInPandas(near, f"q {kind}, unit array<float>, lists array<int>")
        return told.select("q", "unit", F.explode("lists").alias("list"))

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, rerank: int = 100) -> DataFrame:
        """(q, id, score, rank): the k rows of the greatest cosine for each of queries (q, vector), among its `probes` nearest lists.

        In each chunk of a list the codes choose `rerank` rows (0: all) for a
        query, whose cosines decide; ties rank by id. With all lists and no
        choice by codes the result is exact, up to single precision. Chunks of
        rows and of queries are met in one task each, by matrix products; k
        rows of a query leave it. Queries without a direction have cosine 0
        with all rows; null ids come last; an empty table gives none.
        """
        asked = staged(self.probed(queries, probes), "asked")
        lists = sorted(r[0] for r in asked.select("list").distinct().collect())  # LISTS at most
        blocks = max(1, math.ceil(asked.select("q").distinct().count() / QUERIES))
        rows = self.rows(lists).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        chunks = self.rows(lists).groupBy(F.col("list").alias("l")).agg(F.max("chunk").alias("last"))  # a row for each list
        asked = asked.join(F.broadcast(chunks), F.col("list") == F.col("l")).select("q", "unit", "list", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), "last")).alias("chunk"))
        codes = self.codes
        bounds = np.cumsum([0, *[c.shape[1] for c in codes]])
        kind = queries.schema["q"].dataType.simpleString()

        def met(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out = {"q": [], "id": [], "score": []}
            if len(rows) and len(asked):
                unit = np.stack(rows["unit"].to_numpy()).astype(np.float64)
                told = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), len(codes))
                ids = rows["id"].to_numpy()
                for q, v in zip(asked["q"], asked["unit"], strict=True):
                    v = np.asarray(v, np.float64)
                    best = np.arange(len(rows))
                    if rerank and rerank < len(rows):
                        about = sum((c @ v[a:b])[told[:, i]] for i, (c, a, b) in enumerate(zip(codes, bounds[:-1], bounds[1:], strict=True)))
                        best = np.argpartition(-about, rerank)[:rerank]
                    score = unit[best] @ v
                    at = np.lexsort((ids[best], -score)) if ids.dtype != object else np.argsort(-score, kind="stable")
                    at = at[:k] if ids.dtype != object else at[score[at] >= score[at[min(k, len(at)) - 1]]]  # ties of other ids are told apart after
                    out["q"] += [q] * len(at)
                    out["id"] += list(ids[best[at]])
                    out["score"] += list(score[at])
            return pd.DataFrame(out)

        by = ("list", "chunk", "block")
        found = rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(met, f"q {kind}, id {self.id_type}, score double")
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))))
        return ranked.where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the queries (q) of exact, and the share of its rows (q, id) that found has."""
    hit = exact.select("q", "id").join(found.select(F.col("q").alias("q1"), F.col("id").alias("id1"), F.lit(1).alias("hit")), (F.col("q") == F.col("q1")) & (F.col("id") == F.col("id1")), "left")
    return hit.agg(F.countDistinct("q").alias("queries"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
