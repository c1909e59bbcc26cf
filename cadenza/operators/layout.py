"""Rows, pages and played runs of bars: where they begin and end, what meets across their breaks, and where a cursor stands.

Tables hold one row per bar (or per chord, for runs). Keys tell pieces apart and may be null; the order must be total within a key,
and each key's rows are one sorted window. An empty table gives no rows; other columns are carried along."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins
from .islands import islands
from .timeline import ordered, renumbered


def played_runs(chords: DataFrame, keys: Sequence[str], order: Sequence[str | Column], measure: str, beat: str, out: str = "run") -> DataFrame:
    """Numbers the measures as they are played: a run ends where the measure changes or, the same bar being repeated, the beat falls."""
    w = ordered(keys, order)
    return islands(chords, keys, order, ~F.col(measure).eqNullSafe(F.lag(measure).over(w)) | (F.col(beat) < F.lag(beat).over(w)), out)


def run_bounds(chords: DataFrame, keys: Sequence[str], order: Sequence[str | Column], measure: str, beat: str, quarters: float) -> DataFrame:
    """Adds run, place (from 1), first and last (the places of the run's ends) and position: bars of `quarters` played before, and the beat."""
    own = renumbered(played_runs(chords, keys, order, measure, beat), keys, order, "place")
    whole = Window.partitionBy(*keys, "run")
    return own.withColumn("first", F.min("place").over(whole)).withColumn("last", F.max("place").over(whole)).withColumn("position", (F.col("run") - 1) * quarters + F.col(beat))


def run_tiles(runs: DataFrame, keys: Sequence[str], measure: str, place: str, wrong: Column) -> DataFrame:
    """A row for each run: how many of its chords are wrong, ok / warn (one) / err (more), and the first wrong one's place."""
    of = runs.groupBy(*keys, "run", measure).agg(F.count_if(wrong).alias("mistakes"), F.min(F.when(wrong, F.col(place))).alias("first_wrong"))
    return of.withColumn("tile", F.when(F.col("mistakes") == 0, "ok").when(F.col("mistakes") == 1, "warn").otherwise("err"))


def merged_sets(records: DataFrame, keys: Sequence[str], sets: Sequence[str]) -> DataFrame:
    """The sorted union of each array column over all records of a key. Single members are made distinct before they are gathered,
    so a key holds as many as there are different ones, however often it was played."""
    def tag(k: int):
        return lambda v: F.struct(F.lit(k).alias("set"), v.alias("value"))

    tagged = F.flatten(F.array(*(F.transform(F.coalesce(s, F.array()), tag(k)) for k, s in enumerate(sets))))
    single = records.select(*keys, F.explode_outer(tagged).alias("member")).distinct()
    return single.groupBy(*keys).agg(*(F.array_sort(F.collect_set(F.when(F.col("member.set") == k, F.col("member.value")))).alias(s) for k, s in enumerate(sets)))


def rows_of_bars(bars: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bar: str, new_row: Column, new_page: Column) -> DataFrame:
    """page, row (both numbered from 1 over the piece), first and last bar of each row. A page break begins a row, too; the first
    bar's own breaks only begin what is there."""
    w = ordered(keys, order)
    first = F.row_number().over(w) == 1
    paged, rowed = F.coalesce(new_page, F.lit(False)), F.coalesce(new_row, F.lit(False))
    flagged = bars.select(*keys, bar, F.sum((paged & ~first).cast("int")).over(w).alias("page"), F.sum((paged | rowed | first).cast("int")).over(w).alias("row"))
    return flagged.groupBy(*keys, "page", "row").agg(F.min(bar).alias("first"), F.max(bar).alias("last")).withColumn("page", F.col("page") + 1)


def listing(bars: DataFrame, keys: Sequence[str], bar: str) -> DataFrame:
    """First and last bar and number of bars of each row; keys name it, for example page and system."""
    return bars.groupBy(*keys).agg(F.min(bar).alias("first_bar"), F.max(bar).alias("last_bar"), F.count("*").alias("bars"))


def across_breaks(bars: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sheet: str) -> DataFrame:
    """The last bar of each sheet but the piece's last one, with the bar that follows it: its columns as `next_*`."""
    others = [c for c in bars.columns if c not in keys]
    # the struct is null after a piece's last bar
    both = bars.select(F.struct(*bars.columns).alias("bar"), F.lead(F.struct(*others)).over(ordered(keys, order)).alias("next"))
    broken = both.where(F.col("next").isNotNull() & ~F.col(f"next.{sheet}").eqNullSafe(F.col(f"bar.{sheet}")))
    return broken.select("bar.*", *(F.col(f"next.{c}").alias(f"next_{c}") for c in others))


def broken_arcs(arcs: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Arcs (begin, end: bars) with `stray`: they reach over a break of rows (row, first, last) and don't go from the last bar of a
    row to the first one of the next. An arc whose bars are in no row is stray."""
    r = rows.select(*keys, "row", "first", "last")
    begins = r.select(*keys, F.col("row").alias("row_a"), F.col("last").alias("last_a"), F.explode(F.sequence("first", "last")).alias("begin"))
    ends = r.select(*keys, F.col("row").alias("row_b"), F.col("first").alias("first_b"), F.explode(F.sequence("first", "last")).alias("end"))
    both = arcs.join(begins, [*keys, "begin"], "left").join(ends, [*keys, "end"], "left")
    fits = (F.col("row_a") == F.col("row_b")) | ((F.col("row_b") == F.col("row_a") + 1) & (F.col("begin") == F.col("last_a")) & (F.col("end") == F.col("first_b")))
    return both.select(*arcs.columns, (~F.coalesce(fits, F.lit(False))).alias("stray"))


def first_places(records: DataFrame, bars: DataFrame, keys: Sequence[str], number: str, place: str, out: str) -> DataFrame:
    """Records with the first place of the bar that has their number; 0 where no bar has it."""
    least = bars.groupBy(*keys, number).agg(F.min(place).alias(out))
    return records.join(least, [*keys, number], "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def same_pitches(left: DataFrame, right: DataFrame, keys: Sequence[str], pitch: str, left_id: str, right_id: str) -> DataFrame:
    """Notes of two chords one to one by equal pitch: of repeated pitches the first id meets the first."""
    names = [*keys, pitch]
    w = Window.partitionBy(*names)
    a = left.select(*names, F.col(left_id).alias("from"), F.row_number().over(w.orderBy(left_id)).alias("nth"))
    b = right.select(*names, F.col(right_id).alias("to"), F.row_number().over(w.orderBy(right_id)).alias("nth"))
    return a.join(b, [*names, "nth"]).select(*names, "from", "to")


def cursor_places(asked: DataFrame, layout: DataFrame, keys: Sequence[str], at: str, x: str, line: str) -> DataFrame:
    """x and line of each asked position: those of the last layout row at or before it (of equal positions the last x), moved
    towards the next row in proportion where that stands further on in the same line. Before the first row: null."""
    w = Window.partitionBy(*keys).orderBy(at)
    one = layout.groupBy(*keys, at).agg(F.max(F.struct(F.col(x), F.col(line))).alias("here"))
    known = one.select(*keys, at, F.struct(F.col(at).alias("q"), F.col(f"here.{x}").alias("x"), F.col(f"here.{line}").alias("line"), F.lead(at).over(w).alias("q2"), F.lead(f"here.{x}").over(w).alias("x2"), F.lead(f"here.{line}").over(w).alias("line2")).alias("box"))
    found = joins.asof(asked, known, keys, at, "box", "box")
    share = F.least(F.lit(1.0), (F.col(at) - F.col("box.q")) / (F.col("box.q2") - F.col("box.q")))
    moved = F.when(F.col("box.line") == F.col("box.line2"), F.col("box.x") + share * (F.col("box.x2") - F.col("box.x")))
    return found.select(*asked.columns, F.coalesce(moved, F.col("box.x")).alias(x), F.col("box.line").alias(line))


def report_marks(lines: DataFrame, keys: Sequence[str], number: str, text: str) -> DataFrame:
    """bar and marks of a text report: lines that begin with four spaces after a `bar N (page` line belong to it, up to any other
    line. Of two blocks of one bar the later one holds. Null lines end a block."""
    head = F.nullif(F.regexp_extract(text, r"^bar (\d+) \(page", 1), F.lit(""))
    kind = F.when(head.isNotNull(), "head").when(F.col(text).startswith("    "), "mark").otherwise("other")
    typed = lines.select(*keys, F.col(number).alias("line"), head.cast("int").alias("bar"), kind.alias("kind"), F.trim(text).alias("said"))
    blocks = islands(typed, keys, ["line"], F.col("kind") != "mark", "block")
    first = F.col("kind") == "head"
    of = blocks.groupBy(*keys, "block").agg(F.max(F.when(first, F.col("bar"))).alias("bar"), F.array_sort(F.collect_list(F.when(F.col("kind") == "mark", F.struct("line", "said")))).alias("own")).where("bar is not null")
    last = of.groupBy(*keys, "bar").agg(F.max_by("own", "block").alias("own"))
    return last.select(*keys, "bar", F.col("own.said").alias("marks"))


def page_images(files: DataFrame, path: str = "path") -> DataFrame:
    """Files named *_pN.png with their page N, which sorts as a number."""
    own = files.withColumn("page", F.regexp_extract(path, r"_p(\d+)\.png$", 1))
    return own.where("page <> ''").withColumn("page", F.col("page").cast("int"))
