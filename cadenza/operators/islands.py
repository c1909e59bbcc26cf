"""Gaps and islands: runs of rows, sessions, regions, natural order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import ordered


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], breaks: Column, out: str = "island") -> DataFrame:
    """Numbers runs from 1: a row where `breaks` holds (or is null: the first row) begins one."""
    w = ordered(keys, order)
    return df.withColumn("_new", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def before(column: str | Column, keys: Sequence[str], order: Sequence[str | Column]) -> Column:
    return F.lag(column).over(ordered(keys, order))


def sessions(df: DataFrame, key: str, time: str, seconds: int, tie: str) -> DataFrame:
    """One row per session: rows of a key that are at most `seconds` apart."""
    w = [time, tie]
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(before(time, [key], w).cast("timestamp")) > seconds * 1_000_000
    return islands(df, [key], w, gap, "session").groupBy(key, "session").agg(F.min(time).alias("begin"), F.max(time).alias("end"), F.count("*").alias("n"))


def chains(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], place: str, gap: float) -> DataFrame:
    """Groups of values at most `gap` from their neighbour, with extent and mean."""
    runs = islands(df, keys, order, F.col(place) - before(place, keys, order) > gap)
    return runs.groupBy(*keys, "island").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.avg(place).alias("mean"), F.count("*").alias("n"))


def numbered(df: DataFrame, order: Sequence[str], out: str, parts: int = 64) -> DataFrame:
    """Places from 1 by columns whose values differ between rows, without a window over the whole table.

    Rows are dealt into ranges of the order, numbered within them, and each range begins where the counts of those before end. The
    cuts are drawn from a share of the rows (some 100 for each part, picked by hash) and only decide about balance."""
    key = F.struct(*order)
    total = df.count()
    share = max(1, total // (100 * parts))
    drawn = df.select(key.alias("k")).where(F.pmod(F.xxhash64(*order), F.lit(share)) == 0)
    cuts = drawn.select("k", F.ntile(parts).over(Window.orderBy("k")).alias("t")).groupBy("t").agg(F.max("k").alias("k")).collect()
    known = [F.struct(*(F.lit(r["k"][c]).cast(df.schema[c].dataType).alias(c) for c in order)) for r in cuts]
    dealt = df.withColumn("_part", F.size(F.filter(F.array(*known), lambda c: c < key)) if known else F.lit(0))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    begins = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_begin"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return own.join(F.broadcast(begins), "_part").withColumn(out, F.col("_own") + F.col("_begin")).drop("_part", "_own", "_begin")


def natural_key(name: Column) -> Column:
    """Sorts 2 before 10 and ignores case: digits are padded, letters lower-cased."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")
