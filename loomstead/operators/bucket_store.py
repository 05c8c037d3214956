"""A store that is changed in place: Parquet in hash buckets, of which a change rewrites those that it names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.plans.staging import file_system, staged, unstage

#: The partition column; a store's own columns are named otherwise.
BUCKET = "bucket"


class BucketStore:
    """Rows by key in a folder that all executors share.

    Every change reads the buckets of the keys that it names, writes them anew
    beside the store and puts them in its place (dynamic partition overwrite);
    other buckets are neither read nor written. A change that fails a check
    (a key twice, there already, or missing) changes nothing. One writer at a
    time; a change that is broken off while its buckets are put in place is
    run again: upserts, replacements and deletions give the same store then.
    Null keys are an error. Buckets hold about as many rows each, whatever the
    keys, but rows of one key are in one: keys are unique except for `replace`.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: str = "id", buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        system, at = file_system(spark, self.path)
        system.mkdirs(at)

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.kind[self.key].dataType).cast("string")), F.lit(self.buckets)).cast("int")

    def _read(self, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(T.StructType([*self.kind.fields, T.StructField(BUCKET, T.IntegerType())])).option("basePath", self.path).parquet(self.path)
        return rows if buckets is None else rows.where(F.col(BUCKET).isin(*buckets))

    def rows(self, keys: DataFrame | None = None) -> DataFrame:
        """All rows, or those of keys (a table with the key), of whose buckets alone are read."""
        if keys is None:
            return self._read().drop(BUCKET)
        wanted = keys.select(F.col(self.key).alias("_k")).distinct()
        return self._read(self._touched(keys)).join(wanted, F.col(self.key) == F.col("_k"), "left_semi").drop(BUCKET)

    def _touched(self, keys: DataFrame) -> list[int]:
        """The buckets of keys, at most as many as there are."""
        return sorted(r[0] for r in keys.select(self.bucket_of(F.col(self.key))).distinct().collect())

    def _given(self, rows: DataFrame) -> DataFrame:
        """rows with the store's columns, written; missing ones are null."""
        cast = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.kind.fields]
        given = staged(rows.select(*cast), "change")
        twice = given.groupBy(self.key).agg(F.count(F.lit(1)).alias("n")).where(F.col(self.key).isNull() | (F.col("n") > 1))
        bad = twice.agg(F.count(F.lit(1)).alias("n"), F.min(self.key).alias("key")).first()
        if bad["n"]:
            unstage(given)
            raise ValueError(f"{self.key} {bad['key']} is null or given more than once")
        return given

    def _put(self, touched: list[int], rows: DataFrame) -> None:
        """The touched buckets hold these rows (with the bucket) and no others."""
        if not touched:
            return
        new = staged(rows.repartition(BUCKET), "buckets")  # written before what it is read from is put away
        held = {r[0] for r in new.select(BUCKET).distinct().collect()}
        new.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        for bucket in set(touched) - held:
            system, at = file_system(self.spark, f"{self.path}/{BUCKET}={bucket}")
            system.delete(at, True)
        unstage(new)

    def _met(self, touched: list[int], given: DataFrame) -> DataFrame:
        """Old rows (o) and given ones (n) of the touched buckets, by key."""
        old = self._read(touched).select(F.struct(*self.kind.names).alias("o"), F.col(self.key).alias("_old"))
        new = given.select(F.struct(*given.columns).alias("n"), F.col(self.key).alias("_new"))
        met = old.join(new, F.col("_old") == F.col("_new"), "full")
        return met.withColumn(BUCKET, self.bucket_of(F.coalesce("_old", "_new")))

    def _counts(self, met: DataFrame) -> tuple[int, int, object, object]:
        """Given keys that are there, that are not, and the least of each."""
        there, lacking = F.col("_old").isNotNull() & F.col("_new").isNotNull(), F.col("_old").isNull()
        x = met.agg(F.count_if(there).alias("there"), F.count_if(lacking).alias("lacking"), F.min(F.when(there, F.col("_new"))).alias("one"), F.min(F.when(lacking, F.col("_new"))).alias("none")).first()
        return x["there"], x["lacking"], x["one"], x["none"]

    def insert(self, rows: DataFrame) -> int:
        """Add rows and return their number; ValueError, and no change, where a key is there already."""
        given = self._given(rows)
        touched = self._touched(given)
        met = self._met(touched, given)
        there, new, one, _ = self._counts(met)
        if there:
            unstage(given)
            raise ValueError(f"{self.key} {one} is there already")
        self._put(touched, met.select(F.coalesce("o", "n").alias("x"), BUCKET).select("x.*", BUCKET))
        unstage(given)
        return new

    def upsert(self, rows: DataFrame, keep: tuple[str, ...] = ("created_at",)) -> dict[str, int]:
        """Put rows over those of the same key, but for the columns in keep where the old row has a value; {inserted, updated}."""
        given = self._given(rows)
        touched = self._touched(given)
        met = self._met(touched, given)
        there, new, _, _ = self._counts(met)
        kept = [F.coalesce(f"o.{c}", f"n.{c}") if c in keep else F.when(F.col("_new").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in self.kind.names]
        self._put(touched, met.select(*[x.alias(c) for x, c in zip(kept, self.kind.names, strict=True)], BUCKET))
        unstage(given)
        return {"inserted": new, "updated": there}

    def update(self, rows: DataFrame) -> int:
        """Change the columns that rows has in the rows of their keys and return their number; LookupError, and no change, where one is missing."""
        given = self._given(rows)
        touched = self._touched(given)
        met = self._met(touched, given)
        there, lacking, _, none = self._counts(met)
        if lacking:
            unstage(given)
            raise LookupError(f"no row with {self.key} {none}")
        changed = [F.when(F.col("_new").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in rows.columns else F.col(f"o.{c}") for c in self.kind.names]
        self._put(touched, met.select(*[x.alias(c) for x, c in zip(changed, self.kind.names, strict=True)], BUCKET))
        unstage(given)
        return there

    def delete(self, keys: DataFrame) -> int:
        """Delete the rows of keys and return their number; LookupError, and no change, where one is missing. Keys given twice count once."""
        given = staged(keys.select(F.col(self.key).cast(self.kind[self.key].dataType).alias(self.key)).distinct(), "keys")
        touched = self._touched(given)
        met = self._met(touched, given)
        there, lacking, _, none = self._counts(met)
        if lacking:
            unstage(given)
            raise LookupError(f"no row with {self.key} {none}")
        self._put(touched, met.where("_new is null").select("o.*", BUCKET))
        unstage(given)
        return there

    def delete_where(self, column: str, value) -> int:
        """Delete the rows whose column has the value and return their number, which may be 0; null is no value."""
        hit = F.coalesce(F.col(column) == F.lit(value), F.lit(False))
        found = {r[BUCKET]: r["n"] for r in self._read().where(hit).groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()}
        self._put(sorted(found), self._read(sorted(found)).where(~hit))
        return sum(found.values())

    def replace(self, keys: DataFrame, rows: DataFrame) -> dict[str, int]:
        """Put rows, whose keys are among keys and may repeat, in the place of all rows of keys; {deleted, inserted}."""
        wanted = staged(keys.select(F.col(self.key).cast(self.kind[self.key].dataType).alias("_k")).distinct(), "keys")
        given = staged(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.kind.fields]), "change")
        touched = self._touched(wanted.withColumnRenamed("_k", self.key))
        old = self._read(touched).join(wanted.withColumn("_gone", F.lit(True)), F.col(self.key) == F.col("_k"), "left")
        stray = given.join(wanted, F.col(self.key) == F.col("_k"), "left_anti")
        if not stray.isEmpty():
            raise ValueError(f"{self.key} {stray.first()[self.key]} is not among the keys")
        counts = {"deleted": old.where("_gone").count(), "inserted": given.count()}
        self._put(touched, old.where("_gone is null").drop("_gone", "_k").unionByName(given.withColumn(BUCKET, self.bucket_of(F.col(self.key)))))
        unstage(wanted, given)
        return counts

    def clear(self) -> int:
        """Delete all rows and return their number."""
        n = self._read().count()
        system, at = file_system(self.spark, self.path)
        for status in system.listStatus(at):
            if status.getPath().getName().startswith(f"{BUCKET}="):
                system.delete(status.getPath(), True)
        return n

    def once(self, name: str, change: Callable[[], object]) -> bool:
        """Run a change under a name unless one of that name was run to its end; whether it was run now."""
        system, mark = file_system(self.spark, f"{self.path}/_ledger/{name}")
        if system.exists(mark):
            return False
        change()
        system.mkdirs(mark)
        return True
