"""Relevance labels, calibration, recency, decay and rank normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstead.operators.ordering import running_before

#: Shares of the rows that are labelled high, and high or medium below that.
HIGH, MEDIUM = 0.2, 0.7
#: Multipliers of the calibrated range, and thresholds where it is invalid.
CALIBRATED = (0.70, 0.40, 0.15)


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def percentile_labels(df: DataFrame, id_col: str = "id", by: list[str] | None = None) -> DataFrame:
    """df with relevance: the best fifth (one at least) high, to nine tenths medium, the rest low; up to three rows have no low."""
    part = W.partitionBy(*(by or []))
    rank = F.row_number().over(part.orderBy(F.desc("score"), F.asc(id_col)))
    n = F.count(F.lit(1)).over(part)
    high = F.greatest(F.lit(1), F.floor(n * HIGH))
    to_medium = F.greatest(high, F.floor(n * MEDIUM))
    label = F.when(rank <= high, "high").when((rank <= to_medium) | (n <= 3), "medium").otherwise("low")
    return df.withColumn("relevance", label)


def calibration_thresholds(perfect: Column, baseline: Column) -> list[Column]:
    """high, medium and low thresholds from the median scores of self matches and of unrelated queries."""
    return [F.when(perfect > baseline, baseline + m * (perfect - baseline)).otherwise(F.lit(m)) for m in CALIBRATED]


def calibrate(perfect: DataFrame, unrelated: DataFrame) -> DataFrame:
    """One row: perfect, baseline, high, medium, low, from two tables of probe scores."""
    p = perfect.agg(F.median("score").alias("perfect"))
    b = unrelated.agg(F.median("score").alias("baseline"))
    high, medium, low = calibration_thresholds(F.col("perfect"), F.col("baseline"))
    return p.crossJoin(b).select("perfect", "baseline", high.alias("high"), medium.alias("medium"), low.alias("low"))


def threshold_labels(df: DataFrame, calibration: DataFrame) -> DataFrame:
    """df with relevance by the thresholds of a one-row calibration table."""
    c = F.broadcast(calibration.select(F.col("high").alias("_h"), F.col("medium").alias("_m"), F.col("low").alias("_l")).limit(1))
    s = clamped(F.col("score"))
    label = F.when(s >= F.col("_h"), "high").when(s >= F.col("_m"), "medium").otherwise("low")
    return df.crossJoin(c).withColumn("relevance", label).drop("_h", "_m", "_l")


def age_days(at: Column, as_of: Column, negative: bool = False) -> Column:
    """Days from at to as_of; the future has no age, or with negative one below zero."""
    age = (F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(86_400_000_000.0)
    return age if negative else F.greatest(F.lit(0.0), age)


def recency_boost(score: Column, at: Column, as_of: Column, factor: float = 0.5, efold_days: float = 7.0) -> Column:
    """score * (1 + factor * exp(-age / efold_days)); an unknown time boosts nothing."""
    if factor < 0 or efold_days <= 0:
        raise ValueError("factor must not be negative, efold_days must be positive")
    return F.when(at.isNull(), score).otherwise(score * (1 + factor * F.exp(-age_days(at, as_of) / efold_days)))


def temporal_decay(score: Column, at: Column, as_of: Column, half_life_days: float = 90.0, negative: bool = False) -> Column:
    """score halved every half_life_days; an unknown time decays nothing, nor does the future, but with negative it grows by the same rule."""
    return F.when(at.isNull(), score).otherwise(score * F.exp(-F.log(F.lit(2.0)) / half_life_days * age_days(at, as_of, negative)))


def rank_normalised(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with out: the average rank of column scaled to 0..1."""
    return ranks_normalised(df, {column: out})


def coherence_signals(df: DataFrame, problem_vector: str = "problem_vector", fix_vector: str = "fix_vector", rerank: str = "rerank", problem: str = "problem", fix: str = "fix") -> DataFrame:
    """df with cosine_signal, rerank_signal and ground_signal: how far a fix is from its problem, by vectors, by a reranker's score, and by the identifiers that it names."""
    from loomstead.operators import inspection, vectors

    return df.withColumns({
        "cosine_signal": F.when(F.col(problem_vector).isNotNull() & F.col(fix_vector).isNotNull(), 1.0 - vectors.cosine(F.col(problem_vector), F.col(fix_vector))),
        "rerank_signal": 1.0 - F.col(rerank), "ground_signal": inspection.grounding(F.col(problem), F.col(fix)),
    })


def calibration_row(calibration: DataFrame, model: str, as_of: Column) -> DataFrame:
    """A calibration as a row of an index' metadata: (key, value), value being JSON."""
    told = F.struct(F.lit(model).alias("model"), as_of.cast("string").alias("calibrated_at"), "perfect", "baseline", "high", "medium", "low")
    return calibration.limit(1).select(F.lit("calibration").alias("key"), F.to_json(told).alias("value"))


def stored_calibration(metadata: DataFrame, model: str) -> DataFrame:
    """The calibration of a model in an index' metadata; none where it is of another model or absent."""
    kind = "model string, calibrated_at string, perfect double, baseline double, high double, medium double, low double"
    return metadata.where(F.col("key") == "calibration").select(F.from_json("value", kind).alias("c")).select("c.*").where(F.col("model") == model).drop("model")


def ranks_normalised(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the average rank of each column, scaled to 0..1, under its name in columns; 0 for a single value, null for null.

    Ranks come from counts by value, so equal values of many rows are summed
    before anything is put in order; the order is dealt out in ranges.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")
    counts = df.select(stacked).where("x.v is not null").groupBy("x.c", "x.v").agg(F.count(F.lit(1)).alias("n"))
    below = running_before(counts, [F.col("c"), F.col("v")], F.col("n"), "before")
    totals = below.groupBy("c").agg(F.min("before").alias("start"), F.sum("n").alias("all"))  # a row for each column
    scaled = F.when(F.col("all") > 1, (F.col("before") - F.col("start") + (F.col("n") - 1) / 2.0) / (F.col("all") - 1)).otherwise(0.0)
    told = below.join(totals, "c").select("c", "v", scaled.alias("norm"))
    out = df
    for c, name in columns.items():
        own = told.where(F.col("c") == c).select(F.col("v").alias("_v"), F.col("norm").alias(name))
        out = out.join(own, out[c].cast("double") == own["_v"], "left").drop("_v")
    return out


def coherence_flags(df: DataFrame, signals: dict[str, float], percent: float = 20.0, id_col: str = "id") -> DataFrame:
    """df with suspicion and flagged: the weighted mean of rank-normalised signals, and whether a row is in its top percent.

    signals: column to weight; null signals of a row are left out of its mean.
    Ties of suspicion are broken by id; rows that share an id are told apart
    by nothing else. The table is read, ranked and written in ranges before
    the result is built. An empty table gives none.
    """
    ranked = ranks_normalised(df, {s: f"{s}_norm" for s in signals})
    top = sum((F.coalesce(F.col(f"{s}_norm") * w, F.lit(0.0)) for s, w in signals.items()), F.lit(0.0))
    weights = sum((F.when(F.col(s).isNotNull(), F.lit(w)).otherwise(0.0) for s, w in signals.items()), F.lit(0.0))
    ranked = ranked.withColumn("suspicion", F.when(weights > 0, top / weights).otherwise(0.0))
    placed = running_before(ranked, [-F.round("suspicion", 12), F.col(id_col)], F.lit(1), "_place")
    most = placed.agg(F.ceil(F.count(F.lit(1)) * percent / 100).alias("_most"))  # one row
    return placed.crossJoin(F.broadcast(most)).withColumn("flagged", F.col("_place") < F.col("_most")).drop("_place", "_most")
