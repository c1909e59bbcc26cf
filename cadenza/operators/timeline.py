"""Ordered state over keyed event tables: running positions, carried values, changes, renumbering.

Every operator takes key and order columns; the order must be total within a key for a defined result, so callers add a
tie-break. All of them are one sort-based window over one shuffle by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], order: Sequence[str | Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def cursor(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], delta: Column, out: str = "onset") -> DataFrame:
    """Where each row begins: the sum of the signed lengths before it."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(delta).over(w), F.lit(0.0)))


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, out: str) -> DataFrame:
    """The last value that is not null, up to this row."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def changes(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], state: Sequence[str]) -> DataFrame:
    """Rows whose state differs from the row before; the first row of a key counts as one."""
    w = ordered(keys, order)
    now = F.struct(*state)
    return df.withColumn("_before", F.lag(now).over(w)).where(~F.col("_before").eqNullSafe(now)).drop("_before")


def renumbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "number") -> DataFrame:
    return df.withColumn(out, F.row_number().over(ordered(keys, order)))


def offsets(sizes: DataFrame, keys: Sequence[str], order: Sequence[str | Column], size: str, out: str = "offset") -> DataFrame:
    """The sum of sizes before each row: page or movement offsets."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0)))


def increasing(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str) -> DataFrame:
    """Rows whose value is above all earlier ones."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_top", F.max(value).over(w)).where(F.col("_top").isNull() | (F.col(value) > F.col("_top"))).drop("_top")


def previous_only(df: DataFrame, keys: Sequence[str], bar: str, value: str, reset: str, out: str) -> DataFrame:
    """One row per bar with its last value and a reset flag: the value of the bar directly before, unless there was a reset."""
    w = ordered(keys, [bar])
    near = F.lag(bar).over(w) == F.col(bar) - 1
    return df.withColumn(out, F.when(near & ~F.col(reset), F.lag(value).over(w)))


def paired(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], kind: str, start: str, stop: str, place: str) -> DataFrame:
    """Each stop with the last start before it that no other stop has used; a new start replaces an open one."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    marks = df.where(F.col(kind).isin(start, stop))
    last = F.last(F.struct(F.col(kind).alias("kind"), F.col(place).alias("place"))).over(w)
    return marks.withColumn("_last", last).where((F.col(kind) == stop) & (F.col("_last.kind") == start)).withColumn("opened", F.col("_last.place")).drop("_last")
