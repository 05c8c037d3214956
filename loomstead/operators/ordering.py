"""Running totals over a whole table without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstead.plans.staging import staged, unstage


def running_before(rows: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """rows with out: the sum of value over all rows before, by order (see running_sums)."""
    return running_sums(rows, order, {out: value})


def running_sums(rows: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """rows with a column for each of values: its sum over all rows before, by order.

    Rows are dealt out in ranges of the order and written once; each range
    adds up its own rows, and the ranges before it (a row each). order must
    tell rows apart, but for rows whose places among each other don't matter.
    Nulls come last; null values count nothing; an empty table gives none.
    """
    spark = rows.sparkSession
    keys, sums = [f"_o{i}" for i in range(len(order))], [f"_v{i}" for i in range(len(values))]
    told = rows.withColumns({**{k: F.coalesce(v, F.lit(0)) for k, v in zip(sums, values.values(), strict=True)}, **dict(zip(keys, order, strict=True))})
    ascending = [F.asc_nulls_last(k) for k in keys]
    dealt = told.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *ascending)
    dealt = staged(dealt.withColumn("_part", F.spark_partition_id()), "ordered")
    parts = dealt.groupBy("_part").agg(*[F.sum(k).alias(f"{k}_sum") for k in sums])
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_part", *[F.coalesce(F.sum(f"{k}_sum").over(earlier), F.lit(0)).alias(f"{k}_base") for k in sums])
    own = W.partitionBy("_part").orderBy(*ascending).rowsBetween(W.unboundedPreceding, -1)
    inside = dealt.withColumns({f"{k}_own": F.coalesce(F.sum(k).over(own), F.lit(0)) for k in sums}).join(parts, "_part")  # a row for each range
    return inside.withColumns({out: F.col(f"{k}_base") + F.col(f"{k}_own") for out, k in zip(values, sums, strict=True)}).select(*rows.columns, *values)


def numbered_within(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with place (from 0 in each group, by order, nulls last) and held, the group's number of rows; group has no nulls.

    Rows are dealt out in ranges of group and order and counted in each, so a
    group can lie in many ranges and none is numbered in one task. The result
    is written; unstage deletes it.
    """
    keys = [F.asc_nulls_last(c) for c in order]
    dealt = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.asc(group), *keys)
    dealt = staged(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(F.col("_range").alias("_r"), F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    of = W.partitionBy("_g")  # a row for each range that the group lies in
    before = F.coalesce(F.sum("_n").over(of.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_r", "_g", before.alias("_base"), F.sum("_n").over(of).alias("held"))
    own = dealt.withColumn("_own", F.row_number().over(W.partitionBy("_range", group).orderBy(*keys)))
    found = own.join(counts, (F.col("_range") == F.col("_r")) & (F.col(group) == F.col("_g")))
    found = staged(found.select(*rows.columns, (F.col("_base") + F.col("_own") - 1).alias("place"), "held"), "numbered")
    unstage(dealt)
    return found
