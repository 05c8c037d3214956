"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstead.llm.common import n_words, staged, unstage
from loomstead.operators.ordering import running_before, running_sums

#: Bits of a document's place in its source, and of one level of histograms.
PLACE_BITS, LEVEL_BITS = 60, 12


def place_of(doc_id: Column) -> Column:
    """A document's place among those of its source: 60 bits of md5 of its id; null counts as an empty id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], share_percent: int, most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): a row a source.

    Sources by code point, null last, take the weights in turn. Targets are
    min(most * size, level * weight), with the one level at which they sum to
    share_percent of all sizes: that is where resharing excess ends. Sources
    fill up in order of cap / weight; the level is that of the first that does
    not, which is the largest level under which a source stays open. Orders
    are dealt out in ranges, so any number of sources is no single task.
    """
    place = running_before(sources, [F.col("source")], F.lit(1), "before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("before", F.lit(len(weights))) + 1).cast("int"))
    told = place.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    told = running_sums(told, [F.col("cap") / F.col("weight"), F.col("source")], {"capped": F.col("cap"), "filled": F.col("weight")})
    totals = told.agg((F.sum("source_size") * F.lit(share_percent / 100.0)).alias("budget"), F.sum("weight").alias("all"))  # one row
    told = told.crossJoin(F.broadcast(totals))
    level = F.greatest(F.lit(0.0), (F.col("budget") - F.col("capped")) / (F.col("all") - F.col("filled")))
    highest = told.agg(F.max(F.when(level * F.col("weight") <= F.col("cap"), level)).alias("level"))  # one row
    told = told.crossJoin(F.broadcast(highest))
    return told.select("source", "source_size", F.least(F.col("cap"), F.coalesce("level", F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _thresholds(places: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, passes, below): every document of the source is taken `passes` times, and once more if its place is under `below`.

    Histograms of tokens over the top bits of the places find, per source, the
    bucket in which the rest of the budget ends; only its documents go into
    the next level's histogram. At the end one place is left: its documents
    are taken if that brings the source nearer to its target.
    """
    at = targets.select("source", "source_size", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).cast("long").alias("passes"), "target")
    at = at.select("source", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("bucket"))
    at = staged(at, "thresholds")
    for level in range(PLACE_BITS // LEVEL_BITS):
        shift = PLACE_BITS - LEVEL_BITS * (level + 1)
        keys = at.select(F.col("source").alias("s"), F.col("bucket").alias("upper"))
        inside = places.join(keys, places.source.eqNullSafe(F.col("s")) & (F.shiftright(places.place, shift + LEVEL_BITS) == F.col("upper")))
        histogram = inside.groupBy("source", F.shiftright("place", shift).alias("b")).agg(F.sum("size").alias("tokens"))
        before = F.coalesce(F.sum("tokens").over(W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        filled = histogram.withColumn("before", before)
        joined = at.drop("tokens").join(filled.select(F.col("source").alias("s"), "b", "before", "tokens"), at.source.eqNullSafe(F.col("s")) & (F.col("before") <= F.col("rest")), "left")
        pick = joined.groupBy("source", "passes", "rest", "bucket").agg(F.max(F.struct("b", "before", "tokens")).alias("x"))
        after = staged(
            pick.select(
                "source", "passes", (F.col("rest") - F.coalesce("x.before", F.lit(0))).alias("rest"),
                F.coalesce("x.b", F.shiftleft("bucket", LEVEL_BITS)).alias("bucket"), F.coalesce("x.tokens", F.lit(0)).alias("tokens"),
            ), "thresholds",
        )
        unstage(at)
        at = after
    takes_last = (F.col("rest") > 0) & (2 * F.col("rest") >= F.col("tokens"))
    return at.select(F.col("source").alias("s"), "passes", (F.col("bucket") + F.when(takes_last, 1).otherwise(0)).alias("below"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share_percent: int = 150, most: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document.

    size counts the words of the text (null: 0). A source takes its documents
    a whole number of times, and once more those under its hash threshold, so
    no document is taken more than `most` times; its words come within half
    the size of one document of its target. No rows are sorted, and reruns
    agree, since places are hashes of ids.

    Null sources are one source, the last; null ids share a place, as do rows
    with equal ids: such rows are taken together. Texts without words take
    nothing. Empty tables give none; other columns are ignored. Sums are by
    source and bucket before any shuffle, and the joins have one row a source
    on their small side, so a hot source is no hot task.
    """
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"), place_of(F.col("doc_id")).alias("place"))
    places = staged(rows, "places")
    sizes = places.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = staged(source_targets(sizes, weights, share_percent, most), "targets")
    cut = _thresholds(places, targets)
    told = targets.join(cut, targets.source.eqNullSafe(F.col("s"))).select(F.col("source").alias("of"), "source_size", "target", "passes", "below")
    joined = places.join(told, places.source.eqNullSafe(F.col("of")), "left")
    taken = F.col("size") * (F.col("passes") + F.when((F.col("passes") < most) & (F.col("place") < F.col("below")), 1).otherwise(0))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
      coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
      sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_w FROM w),
l AS (SELECT max(CASE WHEN greatest(0, (budget - capped) / open_w) * weight <= cap THEN greatest(0, (budget - capped) / open_w) END) AS lev FROM f),
t AS (SELECT source, source_size, least(cap, lev * weight) AS target FROM f, l),
q AS (SELECT *, (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END)::BIGINT AS passes FROM t),
p AS (SELECT source, place, sum(size) AS tokens FROM d GROUP BY source, place),
c AS (SELECT p.*, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
b AS (SELECT c.source, c.place, q.passes < 2 AND CASE WHEN before + tokens <= target - passes * source_size THEN true
      ELSE target - passes * source_size - before > 0 AND 2 * (target - passes * source_size - before) >= tokens END AS more FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source)
SELECT d.doc_id, d.size, q.source_size, q.target AS target, (d.size * (q.passes + CASE WHEN b.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.place = b.place
"""
