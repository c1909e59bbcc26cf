"""Does a bar add up? The checks differ in what they measure and in what they forgive; each variant stands on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLACK = 1e-6


def status(length: Column, full: Column) -> Column:
    """over, short, ok; empty where there is nothing."""
    return F.when(length.isNull(), "empty").when(length > full + SLACK, "over").when(length < full - SLACK, "short").otherwise("ok")


def overfull(length: Column, full: Column) -> Column:
    return length > full + SLACK


def vote_valid(length: Column, full: Column) -> Column:
    """Nothing at all is not valid."""
    return F.coalesce(F.abs(length - full) < SLACK, F.lit(False))


def padding(length: Column, full: Column) -> Column:
    return F.greatest(F.lit(0.0), full - length)


def colour(blue: Column, red: Column, orange: Column) -> Column:
    """Earlier colours are not painted over."""
    return F.when(blue, "blue").when(red, "red").when(orange, "orange")


def timed(elements: DataFrame) -> DataFrame:
    """Score elements with onset and end in divisions: a running sum of signed lengths within the bar; chord members share their
    leader's onset; grace notes take no time."""
    bar = Window.partitionBy("score_id", "part_id", "measure_idx").orderBy("elem_idx")
    length = F.coalesce(F.col("duration"), F.lit(0))
    delta = F.when(F.col("tag") == "backup", -length).when(F.col("tag") == "forward", length).when((F.col("tag") == "note") & ~F.col("is_chord") & ~F.col("is_grace"), length).otherwise(0)
    begun = F.coalesce(F.sum(delta).over(bar.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    leader = F.when((F.col("tag") == "note") & ~F.col("is_chord"), begun)
    onset = F.when(F.col("is_chord"), F.last(leader, ignorenulls=True).over(bar.rowsBetween(Window.unboundedPreceding, -1))).otherwise(begun)
    return elements.withColumn("onset", onset).withColumn("end", F.col("onset") + F.when(F.col("is_grace"), 0).otherwise(length))


def state_at_bars(elements: DataFrame) -> DataFrame:
    """One row per bar with the divisions, beats and beat_type in force after its attributes; 1 and 4/4 before any."""
    bar = elements.groupBy("score_id", "part_id", "measure_idx", "measure_no").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("elem_idx"))).alias(c) for c in ("divisions", "beats", "beat_type")], F.max("implicit").alias("implicit"))
    run = Window.partitionBy("score_id", "part_id").orderBy("measure_idx").rowsBetween(Window.unboundedPreceding, 0)
    for c, start in (("divisions", 1), ("beats", 4), ("beat_type", 4)):
        bar = bar.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(run), F.lit(start)))
    return bar


def issues(elements: DataFrame) -> DataFrame:
    """Per bar and staff: the fullest voice's end in quarters, what is expected, and over, short, empty or ok. A pickup bar may be short."""
    bars = state_at_bars(elements)
    ends = timed(elements).where("tag = 'note'").groupBy("score_id", "part_id", "measure_idx", "staff", "voice").agg(F.max("end").alias("end"))
    fullest = ends.groupBy("score_id", "part_id", "measure_idx", "staff").agg(F.max("end").alias("end"))
    staves = elements.where("tag = 'note'").select("score_id", "part_id", "staff").distinct()
    every = bars.join(staves, ["score_id", "part_id"]).join(fullest, ["score_id", "part_id", "measure_idx", "staff"], "left")
    quarters, full = F.col("end") / F.col("divisions"), F.col("beats") * 4.0 / F.col("beat_type")
    found = every.withColumn("length", quarters).withColumn("expected", full).withColumn("status", status(quarters, full))
    return found.withColumn("status", F.when((F.col("status") == "short") & F.col("implicit"), "ok").otherwise(F.col("status"))).select("score_id", "part_id", "measure_idx", "measure_no", "staff", "length", "expected", "status")
