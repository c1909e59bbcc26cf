"""Rules about notes and signs of single bars: what a sign changes, which notes go together, what is missing.

Tables hold one row per note, sign or element; keys name the bar (and staff). A bar is a bounded group: what is gathered of one is a
few notes. Null keys are a bar of their own; an empty table gives no rows; other columns are carried along where rows are kept."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import ordered

#: The lengths, in quarters, of plain rests.
RESTS = (4.0, 2.0, 1.0, 0.5, 0.25, 0.125)
#: The quarters of the note types that unwritten triplets have.
PLAIN = {"eighth": 0.5, "16th": 0.25, "32nd": 0.125}
#: Ornaments that left-over fingerings are read as.
ORNAMENTS = (
    "trill-mark", "turn", "inverted-turn", "delayed-turn", "mordent", "inverted-mordent", "shake", "schleifer",
    "tremolo", "wavy-line", "arpeggiate", "non-arpeggiate", "breath-mark", "caesura",
)


def pitched_counts(notes: DataFrame, keys: Sequence[str], rest: Column) -> DataFrame:
    return notes.groupBy(*keys).agg(F.count_if(~rest).alias("notes"))


def first_notes(notes: DataFrame, keys: Sequence[str], onset: str, end: str, staff: str, order: str) -> DataFrame:
    """The note that stands for each onset (the first of the upper staff, 1; else the first) and where the bar ends."""
    each = notes.groupBy(*keys, onset).agg(F.min_by(order, F.struct(~(F.coalesce(F.col(staff), F.lit(0)) == 1), F.col(order))).alias("note"), F.max(end).alias("end"))
    return each.withColumn("end", F.max("end").over(Window.partitionBy(*keys)))


def lasting(notes: DataFrame, keys: Sequence[str], onset: str, end: str) -> DataFrame:
    """The notes that last to the latest end of their bar and, of those, begin last."""
    last = F.struct(F.col(end), F.col(onset))
    return notes.withColumn("lasts", F.max(last).over(Window.partitionBy(*keys)) == last).where("lasts").drop("lasts")


def bar_clefs(elements: DataFrame, keys: Sequence[str], bar: str, order: str, is_note: Column, clef: Column) -> DataFrame:
    """Each bar's clef before its first note and at its end; a bar without one goes on with the clef the one before ended with."""
    first = F.min(F.when(is_note, F.col(order))).over(Window.partitionBy(*keys, bar))
    own = elements.select(*keys, bar, F.col(order).alias("at"), clef.alias("clef"), first.alias("first"))
    early = F.col("clef").isNotNull() & (F.col("first").isNull() | (F.col("at") < F.col("first")))
    late = F.col("clef").isNotNull()
    bars = own.groupBy(*keys, bar).agg(F.max_by("clef", F.when(early, F.col("at"))).alias("start"), F.max_by("clef", F.when(late, F.col("at"))).alias("end"))
    w = ordered(keys, [bar])
    begun = F.last("end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return bars.select(*keys, bar, F.coalesce(F.col("start"), begun).alias("start"), F.last("end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("end"))


def double_bars(barlines: DataFrame, keys: Sequence[str], location: str, style: str) -> DataFrame:
    """Bars whose right barline (the default place) is not an ordinary one."""
    return barlines.where((F.coalesce(location, F.lit("right")) == "right") & F.col(style).isNotNull() & (F.col(style) != "regular")).select(*keys).distinct()


def with_naturals(notes: DataFrame, keys: Sequence[str], step: str, octave: str, time: str, alter: str, accidental: str, chosen: Column, key_alter: Column) -> DataFrame:
    """Chosen notes that the key signature alters become naturals (alter 0, sign `natural`); later notes of the bar on the same line
    or space that sound like they did and have no sign of their own follow. Null alterations count as 0."""
    old = F.coalesce(F.col(alter), F.lit(0))
    hit = F.coalesce(chosen & (old != 0) & (old == key_alter), F.lit(False))
    same = Window.partitionBy(*keys, step, octave, old)
    after = F.coalesce(F.min(F.when(hit, F.col(time))).over(same) < F.col(time), F.lit(False)) & F.col(accidental).isNull() & (old != 0)
    marked = notes.withColumn("made", F.when(hit, 2).when(after, 1).otherwise(0))
    return (
        marked.withColumn(alter, F.when(F.col("made") > 0, 0).otherwise(F.col(alter)))
        .withColumn(accidental, F.when((F.col("made") == 2) & F.col(accidental).isNull(), "natural").otherwise(F.col(accidental)))
        .drop("made")
    )


def doubled_accidentals(notes: DataFrame, keys: Sequence[str], step: str, octave: str, owner: str, alter: str, key_alter: Column) -> DataFrame:
    """Two notes of one step at one moment (keys) in different hands, one or two octaves apart, one plain and one as the key
    signature alters it: the plain one follows the key. Adds `aligned`."""
    w = Window.partitionBy(*keys, step)
    now = F.coalesce(F.col(alter), F.lit(0))
    apart = F.max(octave).over(w) - F.min(octave).over(w)
    hands = F.min(owner).over(w) != F.max(owner).over(w)
    pair = (F.count("*").over(w) == 2) & hands & apart.isin(1, 2) & (key_alter != 0) & (F.min(now).over(w) == F.least(F.lit(0), key_alter)) & (F.max(now).over(w) == F.greatest(F.lit(0), key_alter))
    aligned = F.coalesce(pair & (now != key_alter), F.lit(False))
    return notes.withColumn("aligned", aligned).withColumn(alter, F.when(F.col("aligned"), key_alter).otherwise(F.col(alter)))


def dots_for_wedges(signs: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """Signs (keys: the piece; other columns: the note) with `staccatissimo` made `staccato` in pieces that have at least as many of
    the latter; a note with both keeps one. Pieces' counts are joined back, so one that holds most rows is not gathered."""
    counts = signs.groupBy(*keys).agg(F.count_if(F.col(kind) == "staccatissimo").alias("wedges"), F.count_if(F.col(kind) == "staccato").alias("dots"))
    gate = counts.where("wedges > 0 and dots >= wedges").select(*(F.col(k).alias(f"_{k}") for k in keys))
    found = signs.join(gate, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_semi").where(F.col(kind).isin("staccatissimo", "staccato")).withColumn(kind, F.lit("staccato")).distinct()
    turned = signs.join(gate, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
    others = signs.join(gate, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_semi").where(~F.coalesce(F.col(kind).isin("staccatissimo", "staccato"), F.lit(False)))
    return turned.unionByName(others).unionByName(found)


def kept_signs(signs: DataFrame, kind: str, certainty: str, below: float | None = None) -> DataFrame:
    """Signs without doubtful ornaments: without a threshold all of these go, with one those of a known certainty below it."""
    doubtful = F.lit(True) if below is None else F.coalesce(F.col(certainty) < below, F.lit(False))
    return signs.where(~(F.coalesce(F.col(kind).isin(*ORNAMENTS), F.lit(False)) & doubtful))


def undotted(duration: Column, dots: Column, grace: Column) -> Column:
    """Two thirds of a length with one dot, where that is a whole number; else the length as it is."""
    return F.when((dots == 1) & ~grace & (F.pmod(duration * 2, F.lit(3)) == 0), F.call_function("div", duration * 2, F.lit(3)).cast("long")).otherwise(duration.cast("long"))


def untupled(duration: Column, actual: Column, normal: Column) -> Column:
    """The length before a tuplet shortened it, where that is a whole number."""
    return F.when(F.pmod(duration * actual, normal) == 0, F.call_function("div", duration * actual, normal).cast("long")).otherwise(duration.cast("long"))


def missing_rest(events: DataFrame, keys: Sequence[str], x: str, length: str, expected: str) -> DataFrame:
    """Where one rest was not read: a bar's events are short of `expected` by a plain rest, and a single gap between neighbours is over
    1.6 times the middle one. keys, place (events before the rest), x and length of the rest."""
    w = ordered(keys, [x])
    gapped = events.withColumn("gap", F.lead(x).over(w) - F.col(x)).withColumn("place", F.row_number().over(w))
    bars = gapped.groupBy(*keys).agg((F.max(expected) - F.sum(length)).alias("missing"), F.array_sort(F.collect_list("gap")).alias("gaps"), F.max(F.struct("gap", "place", F.col(x).alias("x"))).alias("widest"))
    typical = F.element_at("gaps", (F.floor(F.size("gaps") / 2) + 1).cast("int"))
    wide = F.size(F.filter("gaps", lambda g: g > 1.6 * typical))
    found = bars.where((F.size("gaps") > 0) & F.col("missing").isin(*RESTS)).withColumn("wide", wide).where("wide = 1")
    return found.select(*keys, F.col("widest.place").alias("place"), (F.col("widest.x") + F.col("widest.gap") / 2).alias("x"), F.col("missing").alias("length"))


def regular(dashes: DataFrame, keys: Sequence[str], x: str, width: str) -> DataFrame:
    """Whether a chain of dashes is a dashed line: four fifths of the widths within 35 % of their median, four fifths of the steps
    within 25 % of theirs; chains of fewer than four pass."""
    own = dashes.withColumn("step", F.lead(x).over(ordered(keys, [x])) - F.col(x))
    middle = own.groupBy(*keys).agg(F.percentile(width, 0.5).alias("mw"), F.percentile("step", 0.5).alias("ms"), F.count("*").alias("n"))
    near_w = F.avg((F.abs(F.col(width) - F.col("mw")) <= 0.35 * F.col("mw")).cast("double"))
    near_s = F.avg((F.abs(F.col("step") - F.col("ms")) <= 0.25 * F.col("ms")).cast("double"))
    return own.join(middle, list(keys)).groupBy(*keys, "n").agg(near_w.alias("w"), near_s.alias("s")).select(*keys, ((F.col("n") < 4) | ((F.col("w") >= 0.8) & (F.col("s") >= 0.8))).alias("regular"))


def octave_chords(notes: DataFrame, keys: Sequence[str], midi: str, voice: str, rest: Column) -> DataFrame:
    """The top note of groups of two or more notes of one voice, no rests, whose highest is an octave above another."""
    own = notes.withColumn("rest_", rest).groupBy(*keys).agg(F.collect_set(midi).alias("pitches"), F.count("*").alias("n"), F.countDistinct(F.coalesce(F.col(voice).cast("string"), F.lit(""))).alias("voices"), F.max("rest_").alias("rests"))
    top = F.array_max("pitches")
    return own.where(~F.col("rests") & (F.col("n") >= 2) & (F.col("voices") == 1) & F.array_contains("pitches", top - 12)).select(*keys, top.alias("top"))


def equal_threes(notes: DataFrame, keys: Sequence[str], kind: str, duration: str, divisions: str, plain: Column) -> DataFrame:
    """Groups (keys) of exactly three notes of one plain type and its very length: candidates of an unwritten triplet."""
    quarters = F.element_at(F.create_map(*(F.lit(x) for kv in PLAIN.items() for x in kv)), F.col(kind))
    fits = F.coalesce(plain & (F.abs(F.col(duration) - quarters * F.col(divisions)) <= 1e-6), F.lit(False))
    own = notes.withColumn("fits", fits).groupBy(*keys).agg(F.count("*").alias("n"), F.min("fits").alias("all"), F.min(F.struct(kind, duration)).alias("low"), F.max(F.struct(kind, duration)).alias("high"))
    return own.where("n = 3 and all and low = high").select(*keys, F.col(f"low.{kind}").alias(kind), F.col(f"low.{duration}").alias(duration))


def stems(notes: DataFrame, bar: Sequence[str], staff: str, owner: str, kind: str, rest: Column, out: str = "stem") -> DataFrame:
    """Stems of lower-staff notes in bars where the right hand (owner 1) writes there: up for it, down for the left. Else null."""
    crossing = F.max(F.coalesce((F.col(staff) == 2) & (F.col(owner) == 1), F.lit(False))).over(Window.partitionBy(*bar))
    own = crossing & (F.col(staff) == 2) & ~rest & ~F.col(kind).eqNullSafe(F.lit("whole"))
    return notes.withColumn(out, F.when(own, F.when(F.col(owner) == 1, "up").otherwise("down")))


def staff_blocks(elements: DataFrame, keys: Sequence[str], staff: str, order: str) -> DataFrame:
    """First and last place of each staff's notes in its bar, and whether another staff's stand between them."""
    own = elements.groupBy(*keys, staff).agg(F.min(order).alias("low"), F.max(order).alias("high"))
    # places at which the staff changes: a block that is whole is one island
    w = ordered(keys, [order])
    runs = elements.select(*keys, F.col(staff), (~F.col(staff).eqNullSafe(F.lag(staff).over(w)) | (F.row_number().over(w) == 1)).alias("new"))
    count = runs.where("new").groupBy(*keys, staff).agg((F.count("*") > 1).alias("interleaved"))
    return own.join(count, [*keys, staff])


def fingerprints(notes: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """A digest of each bar's notes in order; equal bars have equal ones. Null and empty values differ."""
    said = F.to_json(F.struct(*(F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(columns))))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), said.alias("said"))))
    return notes.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(listed, lambda s: s["said"]), "\n"), 256).alias("digest"))


def followed_marks(marks: DataFrame, taken: DataFrame, keys: Sequence[str], reading: str) -> DataFrame:
    """Marks of the readings that a vote took their bars from; a bar that was not replaced is the first reading's (0)."""
    source = taken.select(*keys, F.col(reading).alias("taken"))
    return marks.join(source, list(keys), "left").where(F.col(reading) == F.coalesce("taken", F.lit(0))).drop("taken")


def spaced(places: DataFrame, key: str, place: str, score: str, least: float) -> DataFrame:
    """Greedy choice by score, best first (of equals the least place): a place stays if all chosen ones are further than `least` off.
    Each key is one sequential group; its rows are sorted once."""
    kinds = [places.schema[c].dataType.simpleString() for c in (key, place, score)]

    def chosen(own: pd.DataFrame) -> pd.DataFrame:
        kept: list[float] = []
        rows = []
        for k, at, value in own.sort_values([score, place], ascending=[False, True])[[key, place, score]].itertuples(index=False, name=None):
            if all(abs(at - c) > least for c in kept):
                kept.append(at)
                rows.append((k, at, value))
        return pd.DataFrame(rows, columns=[key, place, score])

    return places.select(key, place, score).groupBy(key).applyInPandas(chosen, ", ".join(f"`{c}` {t}" for c, t in zip((key, place, score), kinds)))


def regrouped(bars: DataFrame, score: str, part: str, order: str, bar: str, notes: str, staves: str, expected: int) -> DataFrame:
    """score, part, target: which part a fragment goes into until a score has `expected` parts. The part with the fewest notes is the
    fragment; it goes to the one with the most notes that has as many staves and no notes in the same bars. A part that stays is
    its own target. A score's parts and bars are one bounded group."""
    kinds = {c: bars.schema[c].dataType.simpleString() for c in (score, part)}

    def joined(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order)
        held = {p: {b: n for b, n in zip(g[bar], g[notes]) if n > 0} for p, g in own.groupby(part, sort=False)}
        lines = own.groupby(part, sort=False)[staves].first().to_dict()
        target = {p: p for p in held}
        left = list(held)
        while len(left) > expected:
            least = min(left, key=lambda p: sum(held[p].values()))
            free = [p for p in left if p != least and lines[p] == lines[least] and not held[p].keys() & held[least].keys()]
            if not free:
                break
            to = max(free, key=lambda p: sum(held[p].values()))
            held[to] |= held[least]
            left.remove(least)
            target = {p: to if t == least else t for p, t in target.items()}
        return pd.DataFrame([(own[score].iloc[0], p, t) for p, t in target.items()], columns=[score, part, "target"])

    return bars.select(score, part, order, bar, notes, staves).groupBy(score).applyInPandas(joined, f"`{score}` {kinds[score]}, `{part}` {kinds[part]}, target {kinds[part]}")


def real_endings(endings: DataFrame, text: str) -> DataFrame:
    """Volta brackets with a digit in their text; others are arcs that were misread."""
    return endings.where(F.coalesce(F.col(text).rlike(r"\d"), F.lit(False)))
