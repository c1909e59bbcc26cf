"""Robust tempo over (key, time, position) points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import islands
from .timeline import ordered


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key by order (descending order: the last ones)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def theil_sen(df: DataFrame, key: str, t: str, q: str, least_dt: float, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Median of the slopes dq/dt of all pairs of a key's points (few for each key) that are more than least_dt apart and rise,
    kept within bounds if given, and the median intercept."""
    points = df.groupBy(key).agg(F.collect_list(F.struct(F.col(t).alias("t"), F.col(q).alias("q"))).alias("p"))
    every = F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: (b["t"] - a["t"] > least_dt) & (b["q"] > a["q"])), lambda b: (b["q"] - a["q"]) / (b["t"] - a["t"]))))
    slopes = points.select(key, F.explode(every).alias("s")).groupBy(key).agg(F.percentile("s", 0.5).alias("slope"))
    if bounds is not None:
        slopes = slopes.withColumn("slope", F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), F.col("slope"))))
    level = points.select(key, F.explode("p").alias("x")).join(slopes, key).groupBy(key, "slope").agg(F.percentile(F.col("x.q") - F.col("slope") * F.col("x.t"), 0.5).alias("intercept"))
    return level


def trimmed_ratio(df: DataFrame, key: str, dt: str, dq: str, share: float) -> DataFrame:
    """Sum dt / sum dq without the given share of rows at either end of the order by dt / dq."""
    w = Window.partitionBy(key)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(F.col(dt) / F.col(dq), dt, dq))).withColumn("_n", F.count("*").over(w)).withColumn("_cut", F.floor(F.col("_n") * share))
    kept = ranked.where((F.col("_r") > F.col("_cut")) & (F.col("_r") <= F.col("_n") - F.col("_cut")))
    return kept.groupBy(key).agg((F.sum(dt) / F.sum(dq)).alias("ratio"), F.count("*").alias("n"))


def paused(intervals: DataFrame, key: str, dt: str, dq: str) -> DataFrame:
    """Intervals with s (seconds a quarter) and whether they are a pause: 1.2 s or more, and over 2.5 times as slow as the median."""
    own = intervals.withColumn("s", F.col(dt) / F.col(dq))
    median = F.percentile("s", 0.5).over(Window.partitionBy(key))
    return own.withColumn("pause", (F.col(dt) >= 1.2) & (F.col("s") > 2.5 * median))


def tempo_summary(intervals: DataFrame, key: str, dt: str, dq: str) -> DataFrame:
    """key, ratio (trimmed seconds a quarter without pauses), bpm and pauses of keys with five intervals or more."""
    flagged = paused(intervals, key, dt, dq)
    count = flagged.groupBy(key).agg(F.count_if("pause").alias("pauses"), F.count("*").alias("_n")).where("_n >= 5").drop("_n")
    ratio = trimmed_ratio(flagged.where("not pause").drop("s", "pause"), key, dt, dq, 0.1).select(key, "ratio")
    return ratio.join(count, key).select(key, "ratio", F.floor(60 / F.col("ratio") + 0.5).alias("bpm"), "pauses")


def measure_speeds(intervals: DataFrame, key: str, measure: str, dt: str, dq: str, bar: float) -> DataFrame:
    """The median seconds a quarter of each measure's intervals without pauses, where these hold half of a bar (in quarters) at least."""
    own = paused(intervals, key, dt, dq).where("not pause").groupBy(key, measure)
    return own.agg(F.percentile("s", 0.5).alias("s"), F.sum(dq).alias("heard")).where(F.col("heard") >= 0.5 * bar)


def regions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], ratio: str, slow: float, fast: float) -> DataFrame:
    """Neighbouring rows that are all slow or all fast become one region with the rounded mean ratio."""
    kind = F.when(F.col(ratio) >= slow, "slow").when(F.col(ratio) <= fast, "fast").otherwise("ok")
    typed = df.withColumn("kind", kind)
    runs = islands(typed, keys, order, F.col("kind") != F.lag("kind").over(ordered(keys, order)))
    return runs.where("kind <> 'ok'").groupBy(*keys, "island", "kind").agg(F.count("*").alias("n"), F.avg(ratio).alias("mean_ratio"))
