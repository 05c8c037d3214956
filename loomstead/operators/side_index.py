"""The stored lexical side index: postings in buckets with digests, so that damage is found and mended where it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.operators.lexical import build_postings
from loomstead.plans.staging import file_system, staged, unstage

POSTINGS = "term string, id {id}, tf long, bucket int"


def digest(*columns: str) -> Column:
    """A digest of a group's rows that does not depend on their order: their number, and sums of two hashes modulo 2**64 as their halves."""
    parts = [F.count(F.lit(1)).cast("decimal(38,0)").alias("rows")]
    for i, salt in enumerate((0, 1)):
        h = F.xxhash64(F.lit(salt), *[F.col(c) for c in columns])
        parts += [F.sum(F.pmod(h, F.lit(1 << 32)).cast("decimal(38,0)")).alias(f"low{i}"), F.sum(F.shiftrightunsigned(h, 32).cast("decimal(38,0)")).alias(f"high{i}")]
    return F.sha2(F.concat_ws(":", *[F.coalesce(p, F.lit(0)).cast("string") for p in parts]), 256)


class SideIndex:
    """Postings (term, id, tf) of documents (id, text) in buckets of ids, in a folder that all executors share.

    For each bucket the index keeps the digest of the documents that it was
    built from and that of its postings. Null texts have no postings; null ids
    are a bucket's like others; of a term's rows with one id there is one.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, id_type: str = "long", stemmed: bool = False) -> None:
        self.spark, self.path, self.buckets, self.stemmed = spark, path.rstrip("/"), buckets, stemmed
        self.schema = POSTINGS.format(id=id_type)
        for part in ("postings", "digests"):
            system, at = file_system(spark, f"{self.path}/{part}")
            system.mkdirs(at)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(self.buckets)).cast("int"))

    def postings(self, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/postings").parquet(f"{self.path}/postings")
        return rows if buckets is None else rows.where(F.col("bucket").isin(*buckets))

    def stored_digests(self) -> DataFrame:
        return self.spark.read.schema("docs_digest string, postings_digest string, bucket int").option("basePath", f"{self.path}/digests").parquet(f"{self.path}/digests")

    def build(self, docs: DataFrame, buckets: list[int] | None = None) -> None:
        """Index docs (id, text), or those of some buckets, whose postings and digests take the place of the old ones."""
        rows = self._bucketed(docs.select("id", "text"))
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(*buckets))
        found = staged(self._bucketed(build_postings(rows.select("id", "text"), stemmed=self.stemmed)[0]), "postings")
        told = rows.groupBy("bucket").agg(digest("id", "text").alias("docs_digest"))
        own = found.groupBy(F.col("bucket").alias("b")).agg(digest("term", "id", "tf").alias("postings_digest"))
        digests = staged(told.join(own, F.col("bucket") == F.col("b"), "left").select("docs_digest", "postings_digest", "bucket"), "digests")
        for name, table in (("postings", found), ("digests", digests)):
            table.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")
            held = {r[0] for r in table.select("bucket").distinct().collect()}  # at most as many as there are buckets
            for bucket in set(range(self.buckets) if buckets is None else buckets) - held:
                system, at = file_system(self.spark, f"{self.path}/{name}/bucket={bucket}")
                system.delete(at, True)
        unstage(found, digests)

    def check(self, docs: DataFrame) -> DataFrame:
        """(bucket, state) of every bucket: `whole`; `stale` where documents differ from those indexed; `damaged` where postings differ from those written. No text is split for it."""
        now = self._bucketed(docs.select("id", "text")).groupBy("bucket").agg(digest("id", "text").alias("docs_now"))
        own = self.postings().groupBy(F.col("bucket").alias("b1")).agg(digest("term", "id", "tf").alias("postings_now"))
        told = self.stored_digests().withColumnRenamed("bucket", "b2")
        met = now.join(told, F.col("bucket") == F.col("b2"), "full").withColumn("bucket", F.coalesce("bucket", "b2"))
        met = met.join(own, F.col("bucket") == F.col("b1"), "full").withColumn("bucket", F.coalesce("bucket", "b1"))
        stale, damaged = ~F.col("docs_now").eqNullSafe(F.col("docs_digest")), ~F.col("postings_now").eqNullSafe(F.col("postings_digest"))
        return met.select("bucket", F.when(stale, "stale").when(damaged, "damaged").otherwise("whole").alias("state"))

    def repair(self, docs: DataFrame) -> int:
        """Build the buckets that are not whole again, and only those; their number."""
        bad = sorted(r[0] for r in self.check(docs).where("state <> 'whole'").collect())
        if bad:
            self.build(docs, bad)
        return len(bad)
