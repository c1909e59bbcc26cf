"""Nearest, as-of, range and overlap joins as windows and bucketed equi-joins: none of them compares all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str, out: str, forward: bool = False) -> DataFrame:
    """For each left row the value of the last right row at or before it (first at or after it, if forward): one sort of the
    union instead of a range join. Equal times: the greatest value."""
    lefts = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    rights = right.groupBy(*keys, at).agg(F.max(value).alias("_value"))
    rights = rights.select(*[F.col(c) if c in (*keys, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.lit(0).alias("_side"), "_value")
    both = lefts.unionByName(rights)
    time = F.col(at).desc() if forward else F.col(at)
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    # only right rows carry a value, so the last one that is not null is the match
    return both.withColumn(out, F.last("_value", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_value")


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], place: str, target: str, tie: str, out: str) -> DataFrame:
    """For each left row the `tie` of the right row with the nearest target; of equals the least tie. As-of from both sides."""
    r = right.groupBy(*keys, F.col(target).alias(place)).agg(F.min(tie).alias("_tie")).withColumn("_v", F.struct(F.col(place).alias("p"), F.col("_tie").alias("t")))
    low = asof(left, r, keys, place, "_v", "_low")
    both = asof(low, r, keys, place, "_v", "_high", forward=True)
    below, above = F.col(place) - F.col("_low.p"), F.col("_high.p") - F.col(place)
    pick = F.when(F.col("_low").isNull(), F.col("_high.t")).when(F.col("_high").isNull(), F.col("_low.t")).when(below < above, F.col("_low.t")).when(above < below, F.col("_high.t")).otherwise(F.least("_low.t", "_high.t"))
    return both.withColumn(out, pick).drop("_low", "_high")


def containing(points: DataFrame, spans: DataFrame, keys: Sequence[str], place: Column, low: Column, high: Column) -> DataFrame:
    """Points joined to the spans of their key that hold them (low <= place < high)."""
    return points.join(spans, list(keys)).where((place >= low) & (place < high))


def overlapping(spans: DataFrame, ident: str, begin: str, end: str, width: float) -> DataFrame:
    """Pairs of spans that share a point, a < b, found through buckets of `width`; a pair is reported in its first common bucket."""
    numbered = spans.select(F.struct(ident).alias("id"), F.col(ident).alias("ident"), F.col(begin).cast("double").alias("b"), F.col(end).cast("double").alias("e"))
    dealt = numbered.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("b") / width), F.floor(F.col("e") / width))))
    x, y = dealt.alias("x"), dealt.alias("y")
    hit = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.ident") < F.col("y.ident")) & (F.col("x.b") <= F.col("y.e")) & (F.col("y.b") <= F.col("x.e"))
    return x.join(y, hit).where(F.col("x.bucket") == F.floor(F.greatest("x.b", "y.b") / width)).select(F.col("x.ident").alias("a"), F.col("y.ident").alias("b"))


def exclusive(df: DataFrame, sign: str, note: str, gap: str) -> DataFrame:
    """Candidate (sign, note, gap) rows: each sign takes its nearest note, then a note keeps its closest sign."""
    first = Window.partitionBy(sign).orderBy(gap, note)
    own = df.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return own.withColumn("_r", F.row_number().over(Window.partitionBy(note).orderBy(gap, sign))).where("_r = 1").drop("_r")


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `new` replace all rows of their keys."""
    return table.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def missing(groups: DataFrame, group: str, members: Column, present: DataFrame, member: str) -> DataFrame:
    """(group, member) combinations that are not present. members: the array of what each group should have."""
    return groups.select(group, F.explode(members).alias(member)).join(present.select(group, member).distinct(), [group, member], "left_anti")
