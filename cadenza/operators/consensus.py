"""Agreement between several readings: overlap ratios, medoid, modes, votes, lexicographic extremes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; two empty sets agree."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def pairs(sets: DataFrame, key: str, reading: str, elements: str) -> DataFrame:
    """Pairs of readings of one key with their overlap. A key holds a bounded number of readings."""
    x, y = sets.alias("x"), sets.alias("y")
    both = x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col(f"x.{reading}") < F.col(f"y.{reading}")))
    return both.select(F.col(f"x.{key}").alias(key), F.col(f"x.{reading}").alias("a"), F.col(f"y.{reading}").alias("b"), jaccard(F.col(f"x.{elements}"), F.col(f"y.{elements}")).alias("jaccard"))


def medoid(pairs_of: DataFrame, sets: DataFrame, key: str, reading: str) -> DataFrame:
    """The reading with the greatest sum of overlaps; the least reading (the primary one) wins sums equal to nine digits."""
    both = pairs_of.select(key, F.explode(F.array(F.col("a"), F.col("b"))).alias(reading), "jaccard").groupBy(key, reading).agg(F.sum("jaccard").alias("score"))
    scored = sets.select(key, reading).join(both, [key, reading], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
    return scored.groupBy(key).agg(F.min_by(reading, F.struct((-F.col("score")).alias("s"), F.col(reading).alias("r"))).alias("medoid"), F.max("score").alias("score"))


def medoid_of_sets(sets: DataFrame, key: str, reading: str, elements: str) -> DataFrame:
    """The same as medoid() over pairs(), but equal sets of a key are one class that counts for its members: pairs grow with a key's
    different sets, not with its readings. elements: sorted arrays without repeats, so that equal sets are equal arrays."""
    classes = sets.groupBy(key, F.col(elements).alias("own")).agg(F.count("*").alias("n"), F.min(reading).alias("least"))
    x, y = classes.alias("x"), classes.alias("y")
    met = x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"))
    shared = F.col("y.n") - (F.col("x.own") == F.col("y.own")).cast("long")  # a reading doesn't vote for itself
    scored = met.groupBy(F.col(f"x.{key}").alias(key), F.col("x.least").alias("least")).agg(F.round(F.sum(shared * jaccard(F.col("x.own"), F.col("y.own"))), 9).alias("score"))
    return scored.groupBy(key).agg(F.min_by("least", F.struct((-F.col("score")).alias("s"), F.col("least").alias("r"))).alias("medoid"), F.max("score").alias("score"))


def mode(df: DataFrame, keys: Sequence[str], value: str, least: int = 1) -> DataFrame:
    """The most frequent value with at least `least` votes; the least value of equals."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("votes")).where(F.col("votes") >= least)
    best = F.struct((-F.col("votes")).alias("v"), F.col(value).alias("x"))
    return counted.groupBy(*keys).agg(F.min_by(value, best).alias("mode"), F.max("votes").alias("votes"))


def first_best(df: DataFrame, keys: Sequence[str], rank: Sequence[Column], value: str, out: str) -> DataFrame:
    """The value of the row that is least by `rank`, compared one after another."""
    order = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(rank)])
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(out))


def chosen(readings: DataFrame, valid: str, certainty: str, bar: Sequence[str], reading: str) -> DataFrame:
    """Bar by bar: a valid reading before an invalid one, then mean certainty (none counts as 0), then the highest reading."""
    rank = F.struct(F.col(valid).cast("int").alias("v"), F.coalesce(certainty, F.lit(0.0)).alias("c"), F.col(reading).alias("r"))
    return readings.groupBy(*bar).agg(F.max_by(reading, rank).alias("chosen"))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first by order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
