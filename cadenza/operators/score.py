"""Operators over score elements (the rows of sources.musicxml): state, merging, voting, repairs and reports.

Each repair is a projection or a join: what proves it is computed from the rows before it, and the rows after it are new rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import scalars as S

from .align import played
from .consensus import jaccard
from .rhythm import SLACK, state_at_bars, status, timed

BAR = ["score_id", "part_id", "measure_idx"]
ORDER = ["measure_idx", "elem_idx"]


def _part():
    return Window.partitionBy("score_id", "part_id").orderBy(*ORDER)


def notes(elements: DataFrame) -> DataFrame:
    """Sounding notes with their MIDI number and their onset in quarters; grace notes and ends of ties are left out."""
    own = timed(elements).join(state_at_bars(elements).select(*BAR, F.col("divisions").alias("_d")), BAR)
    own = own.where((F.col("tag") == "note") & F.col("step").isNotNull() & ~F.col("is_grace") & ~F.coalesce("tie_stop", F.lit(False)))
    return own.withColumn("midi", S.midi(F.col("step"), F.col("octave"), F.col("alter"))).withColumn("quarter", F.col("onset") / F.col("_d")).drop("_d")


def onsets(elements: DataFrame) -> DataFrame:
    """(score, measure, onset) with the distinct pitches of all parts: bars of parts meet by place."""
    return notes(elements).groupBy("score_id", "measure_idx", "quarter").agg(F.array_sort(F.collect_set("midi")).alias("notes"))


def bar_flags(elements: DataFrame) -> DataFrame:
    """(score, measure) with the jump names of all parts, sorted, for align.played(); bars without one have an empty list."""
    return elements.groupBy("score_id", "measure_idx").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("flags", F.array().cast("array<string>")))))).alias("flags"))


def play_chords(elements: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """(score, play_pos, measure, quarter, notes): chords as they are played, jumps followed, of the bars numbered low to high.

    Jumps follow the whole score; the range only picks bars of it, by the number the first part writes."""
    numbers = elements.groupBy("score_id", "measure_idx").agg(F.min_by("measure_no", "part_id").alias("measure_no"))
    own = played(onsets(elements).join(numbers, ["score_id", "measure_idx"]), bar_flags(elements))
    return own if low is None or high is None else in_range(own, low, high)


def in_range(elements: DataFrame, low: int, high: int) -> DataFrame:
    """Bars by written number; a number that isn't whole counts as -1."""
    return elements.where(F.coalesce(F.expr("try_cast(measure_no as int)"), F.lit(-1)).between(low, high))


# ---- state


def key_in_force(elements: DataFrame) -> DataFrame:
    """Elements with the key signature in force."""
    return elements.withColumn("key", F.coalesce(F.last("fifths", ignorenulls=True).over(_part().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))


def clef_in_force(elements: DataFrame) -> DataFrame:
    """Notes with the clef of their staff, carried over bars."""
    own = elements.withColumn("_staff", F.coalesce("clef_staff", "staff"))
    w = Window.partitionBy("score_id", "part_id", "_staff").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    clef = F.when(F.col("clef_sign").isNotNull(), F.struct(F.col("clef_sign").alias("sign"), F.col("clef_line").alias("line")))
    return own.withColumn("clef", F.last(clef, ignorenulls=True).over(w)).drop("_staff")


def sounding_alter(elements: DataFrame) -> DataFrame:
    """What a written pitch sounds like: a sign holds for its step and octave to the end of the bar, else the key decides."""
    sign = F.when(F.col("accidental") == "sharp", 1).when(F.col("accidental") == "flat", -1).when(F.col("accidental") == "natural", 0).when(F.col("accidental") == "double-sharp", 2).when(F.col("accidental") == "flat-flat", -2)
    w = Window.partitionBy(*BAR, "staff", "step", "octave").orderBy("elem_idx").rowsBetween(Window.unboundedPreceding, 0)
    own = key_in_force(elements).withColumn("_sign", F.last(sign, ignorenulls=True).over(w))
    return own.withColumn("sounding", F.when(F.col("step").isNotNull(), F.coalesce("_sign", S.key_alter(F.col("key"), F.col("step"))))).drop("_sign")


def courtesy_naturals(elements: DataFrame) -> DataFrame:
    """Notes whose pitch was altered in the bar directly before, unless the key changed in between, and that are plain now."""
    altered = key_in_force(elements).where("step is not null").groupBy(*BAR, "staff", "step", "octave").agg(F.max_by("alter", "elem_idx").alias("alter"), F.max("key").alias("key"))
    before = altered.where("alter <> 0").select("score_id", "part_id", (F.col("measure_idx") + 1).alias("measure_idx"), "staff", "step", "octave", F.col("key").alias("old_key"))
    now = key_in_force(elements).where("step is not null and coalesce(alter, 0) = 0 and accidental is null")
    first = Window.partitionBy(*BAR, "staff", "step", "octave").orderBy("elem_idx")
    return now.withColumn("_r", F.row_number().over(first)).where("_r = 1").join(before, [*BAR, "staff", "step", "octave"]).where("key = old_key").select(*BAR, "elem_idx", "staff", "step", "octave")


# ---- merging


def unified_divisions(elements: DataFrame, group: str) -> DataFrame:
    """All scores of a group at the least common multiple of their divisions; durations are scaled with them."""
    own = elements.join(state_at_bars(elements).select(*BAR, F.col("divisions").alias("_now")), BAR)
    common = own.groupBy(group).agg(F.collect_set("_now").alias("_all")).select(group, S.least_common_multiple(F.col("_all")).alias("_lcm"))
    own = own.join(common, group)
    scaled = (F.col("duration") * F.floor(F.col("_lcm") / F.col("_now"))).cast("int")
    return own.withColumn("duration", scaled).withColumn("divisions", F.when(F.col("divisions").isNotNull(), F.col("_lcm").cast("int"))).drop("_now", "_lcm")


def merged_movements(elements: DataFrame, group: str, movement: str) -> DataFrame:
    """The scores of a group one after another: bars are numbered on, and state that only repeats is left out."""
    size = elements.groupBy(group, movement).agg((F.max("measure_idx") + 1).alias("_n"))
    w = Window.partitionBy(group).orderBy(movement).rowsBetween(Window.unboundedPreceding, -1)
    offset = size.withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    own = unified_divisions(elements, group).join(offset, [group, movement])
    own = own.withColumn("measure_idx", (F.col("measure_idx") + F.col("_offset")).cast("int")).withColumn("measure_no", (F.col("measure_idx") + 1).cast("string")).withColumn("score_id", F.col(group).cast("string")).drop("_offset")
    run = Window.partitionBy("score_id", "part_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    for c in ("divisions", "beats", "beat_type", "fifths"):
        own = own.withColumn(f"_{c}", F.last(c, ignorenulls=True).over(run))
    time_same = F.col("beats").eqNullSafe(F.col("_beats")) & F.col("beat_type").eqNullSafe(F.col("_beat_type"))
    own = own.withColumn("divisions", F.when(F.col("divisions") != F.coalesce("_divisions", F.lit(-1)), F.col("divisions"))).withColumn("fifths", F.when(F.col("fifths") != F.coalesce("_fifths", F.lit(99)), F.col("fifths")))
    own = own.withColumn("beats", F.when(~time_same, F.col("beats"))).withColumn("beat_type", F.when(~time_same, F.col("beat_type")))
    kept = (F.col("tag") != "attributes") | F.coalesce("divisions", "beats", "fifths", "clef_line").isNotNull() | F.col("clef_sign").isNotNull()
    return own.where(kept).drop("_divisions", "_beats", "_beat_type", "_fifths")


def bars_by_voice(elements: DataFrame) -> DataFrame:
    """Sum of lengths per voice, without chord members and grace notes; gaps that are only skipped don't count."""
    own = elements.where((F.col("tag") == "note") & ~F.col("is_chord") & ~F.col("is_grace"))
    return own.groupBy(*BAR, "measure_no", "staff", "voice").agg(F.sum("duration").alias("length"))


def usual_length(elements: DataFrame) -> DataFrame:
    """Per score the most frequent length of a bar's fullest voice in quarters, to a quarter of one; the first seen of equals."""
    state = state_at_bars(elements).select(*BAR, "divisions")
    full = bars_by_voice(elements).join(state, BAR).groupBy("score_id", "part_id", "measure_idx").agg(F.max(F.round(F.col("length") / F.col("divisions") * 4) / 4).alias("q"))
    counted = full.groupBy("score_id", "q").agg(F.count("*").alias("n"), F.min("measure_idx").alias("first"))
    return counted.groupBy("score_id").agg(F.min_by("q", F.struct(-F.col("n"), "first")).alias("usual"))


# ---- voting


def of_shape(elements: DataFrame, reading: str, primary) -> DataFrame:
    """The readings that have as many bars in each part as the primary one."""
    parts = elements.groupBy(reading, "part_id").agg(F.countDistinct("measure_idx").alias("n"))
    shape = parts.groupBy(reading).agg(F.array_sort(F.collect_list(F.struct("part_id", "n"))).alias("shape"))
    same = shape.join(shape.where(F.col(reading) == primary).select("shape"), "shape", "left_semi")
    return elements.join(same.select(reading), reading, "left_semi")


def staff_readings(elements: DataFrame, reading: str, primary=None) -> DataFrame:
    """Per reading, bar and staff: the set of (onset, midi) events and whether the staff adds up. Bars meet by index in voted(), so
    readings of another shape than the primary one's, if that is given, are left out."""
    if primary is not None:
        elements = of_shape(elements, reading, primary)
    state = state_at_bars(elements).select(*BAR, F.col("divisions").alias("_d"), F.col("beats").alias("_b"), F.col("beat_type").alias("_t"))
    own = timed(elements).where("tag = 'note'").join(state, BAR)
    event = F.when(F.col("step").isNotNull() & ~F.col("is_grace"), F.concat_ws(":", F.round(F.col("onset") / F.col("_d"), 6), S.midi(F.col("step"), F.col("octave"), F.col("alter"))))
    end = F.max(F.col("end") / F.col("_d"))
    return own.groupBy(reading, "part_id", "measure_idx", "staff").agg(F.collect_set(event).alias("events"), (F.abs(end - F.first(F.col("_b") * 4.0 / F.col("_t"))) < SLACK).alias("valid"))


def voted(readings: DataFrame, reading: str, primary) -> DataFrame:
    """Per bar and staff the chosen reading: among the valid ones (all, if none is) the one that agrees most with the others; the
    primary reading wins ties, and stays where nothing is valid."""
    place = ["part_id", "measure_idx", "staff"]
    x = readings.withColumn("_any", F.max("valid").over(Window.partitionBy(*place))).where("valid or not _any").drop("_any")
    a, b = x.alias("a"), x.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in place]
    pairs = a.join(b, same + [F.col(f"a.{reading}") != F.col(f"b.{reading}")]).select(*[F.col(f"a.{c}") for c in (*place, reading)], jaccard(F.col("a.events"), F.col("b.events")).alias("j"))
    score = x.join(pairs.groupBy(*place, reading).agg(F.sum("j").alias("score")), [*place, reading], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
    score = score.withColumn("score", F.when(~F.col("valid"), F.lit(0.0)).otherwise(F.col("score")))
    rank = F.struct((-F.col("score")).alias("s"), (F.col(reading) != primary).alias("p"), F.col(reading).alias("r"))
    return score.groupBy(*place).agg(F.min_by(reading, rank).alias("chosen"), F.max("score").alias("score"))


def voted_slurs(pairs: DataFrame, reading: str, base, needed: int = 2) -> DataFrame:
    """Slurs (by the notes they join) that at least `needed` readings have and the base reading lacks."""
    ends = [c for c in pairs.columns if c != reading]
    common = pairs.groupBy(*ends).agg(F.countDistinct(reading).alias("votes")).where(F.col("votes") >= needed)
    return common.join(pairs.where(F.col(reading) == base).select(*ends), ends, "left_anti")


def slur_pairs(elements: DataFrame) -> DataFrame:
    """Starts and stops of slurs of one number, paired in order; a new start replaces an open one."""
    ends = F.concat(F.transform("slur_stop", lambda n: F.struct(n.alias("number"), F.lit(False).alias("start"))), F.transform("slur_start", lambda n: F.struct(n.alias("number"), F.lit(True).alias("start"))))
    own = elements.where("tag = 'note'").select("score_id", "part_id", "measure_idx", "elem_idx", F.posexplode(ends).alias("k", "e")).select("*", "e.*").drop("e")
    w = Window.partitionBy("score_id", "part_id", "number").orderBy("measure_idx", "elem_idx", "k").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.struct("start", "measure_idx", "elem_idx")).over(w)
    return own.withColumn("_l", last).where(~F.col("start") & F.col("_l.start")).select("score_id", "part_id", F.col("_l.measure_idx").alias("from_measure"), F.col("_l.elem_idx").alias("from_elem"), F.col("measure_idx").alias("to_measure"), F.col("elem_idx").alias("to_elem"))


# ---- repairs


def padded(elements: DataFrame) -> DataFrame:
    """Bars whose cursor, gaps included, doesn't reach the bar's end get a rest at the end; pickup bars don't."""
    own = timed(elements).where("tag in ('note', 'forward')").groupBy(*BAR).agg(F.max("end").alias("end"), F.max("elem_idx").alias("last"))
    short = state_at_bars(elements).join(own, BAR).withColumn("full", S.bar_length(F.col("beats"), F.col("beat_type"), F.col("divisions"))).where("end < full and not implicit")
    rest = short.select("score_id", "part_id", "measure_idx", "measure_no", "implicit", (F.col("last") + 1).alias("elem_idx"), F.lit("note").alias("tag"), F.lit("1").alias("staff"), F.lit("1").alias("voice"), (F.col("full") - F.col("end")).cast("int").alias("duration"), F.lit(False).alias("is_chord"), F.lit(False).alias("is_grace"), F.lit(True).alias("is_rest"))
    return elements.unionByName(rest, allowMissingColumns=True)


def empty_staves(elements: DataFrame) -> DataFrame:
    """(part, bar, staff) without a note, though the part has that staff."""
    own = elements.where("tag = 'note'").select(*BAR, "staff").distinct()
    staves = own.groupBy("score_id", "part_id").agg(F.collect_set("staff").alias("all"))
    bars = elements.select(*BAR).distinct().join(staves, ["score_id", "part_id"])
    return bars.select(*BAR, F.explode("all").alias("staff")).join(own, [*BAR, "staff"], "left_anti")


def without_ghosts(elements: DataFrame, confidence: str, low: float = 0.35) -> DataFrame:
    """Voices whose pitched notes are all doubtful are dropped, a staff's only voice too; without_ghost_voices() has REP20's guards."""
    w = Window.partitionBy(*BAR, "staff", "voice")
    best = F.max(F.when(F.col("step").isNotNull(), F.coalesce(confidence, F.lit(1.0)))).over(w)
    return elements.withColumn("_best", best).where((F.col("tag") != "note") | F.col("_best").isNull() | (F.col("_best") >= low)).drop("_best")


def without_ghost_voices(elements: DataFrame, confidence: str, low: float = 0.35, fragment: float = 0.7) -> DataFrame:
    """REP20: a voice goes where its staff has another one, some voice of the staff fills the bar, this one doesn't, and all its
    pitched notes have a certainty below `low`. A single note that fills the bar goes if its certainty is below `fragment` and it lies
    from nine semitones under the lowest to the highest note with which the other voices that fill the bar begin. Bars with a grace
    note that no note of its voice follows stay. Time that a dropped voice took is skipped. A state machine per bar."""
    full = S.bar_length(F.col("beats"), F.col("beat_type"), F.col("divisions")).alias("full")
    own = timed(elements).where("tag in ('note', 'forward')")
    columns = [F.coalesce("staff", F.lit("1")).alias("staff"), F.coalesce("voice", F.lit("1")).alias("voice"), "elem_idx", "tag", "is_chord", "is_grace", "is_rest", "onset"]
    own = own.select(*BAR, *columns, F.coalesce("duration", F.lit(0)).alias("duration"), S.midi(F.col("step"), F.col("octave"), F.col("alter")).alias("midi"), F.col(confidence).cast("double").alias("sure"))
    own = own.join(state_at_bars(elements).select(*BAR, full), BAR)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        voices: dict[tuple, list] = {}
        graces: set[tuple] = set()
        gone = []
        pdf = pdf.sort_values("elem_idx")
        for r in pdf.itertuples():
            key = r.staff, r.voice
            if r.tag == "note" and r.is_grace:
                graces.add(key)
            elif r.is_chord:
                voices[key][-1][2].append(r)
            else:
                voice = voices.setdefault(key, [])
                voice.append((voice[-1][0] + voice[-1][1] if voice else r.onset, r.duration, [r] if r.tag == "note" else []))
                graces.discard(key)
        length = {k: sum(e[1] for e in v) for k, v in voices.items()}
        bar = pdf["full"].iloc[0]
        for staff in [] if graces else sorted({k[0] for k in voices}):
            keys = [k for k in voices if k[0] == staff]
            if len(keys) < 2 or all(length[k] != bar for k in keys):
                continue
            for k in keys:
                notes = [r for e in voices[k] for r in e[2]]
                pitched = [r for r in notes if not r.is_rest]
                if length[k] != bar:
                    if pitched and all(r.sure < low for r in pitched):
                        gone.append(k)
                elif len(notes) == len(pitched) == 1 and pitched[0].sure < fragment:
                    begin = [r.midi for j in keys if j != k and j not in gone and length[j] == bar for e in voices[j] if e[0] == 0 for r in e[2] if not r.is_rest]
                    if begin and min(begin) - 9 <= pitched[0].midi <= max(begin):
                        gone.append(k)
        return pd.DataFrame([(*pdf[BAR].iloc[0], *k) for k in gone], columns=[*BAR, "_s", "_v"])

    ghosts = own.groupBy(*BAR).applyInPandas(run, "score_id string, part_id string, measure_idx int, _s string, _v string").withColumn("_gone", F.lit(True))
    marked = elements.withColumn("_s", F.coalesce("staff", F.lit("1"))).withColumn("_v", F.coalesce("voice", F.lit("1"))).join(ghosts, [*BAR, "_s", "_v"], "left")
    gone = (F.col("tag") == "note") & F.coalesce("_gone", F.lit(False))
    marked = marked.withColumn("_gone", gone).where(~F.col("_gone") | ~(F.col("is_chord") | F.col("is_grace")))
    blank = {c: F.when(~F.col("_gone"), F.col(c)) for c in "step alter octave tie_start tie_stop note_type dots slur_start slur_stop tuplet_start tuplet_stop actual_notes normal_notes beam stem accidental".split() if c in elements.columns}
    blank |= {"tag": F.when(F.col("_gone"), "forward").otherwise(F.col("tag")), "is_rest": F.col("is_rest") & ~F.col("_gone")}
    return marked.withColumns(blank).select(elements.columns)


def kept_unisons(elements: DataFrame) -> DataFrame:
    """Of equal pitches at one place and voice the longest stays; whole notes stay beside it."""
    own = timed(elements)
    w = Window.partitionBy(*BAR, "staff", "voice", "onset", "step", "alter", "octave").orderBy(F.desc("duration"), "elem_idx")
    return own.withColumn("_r", F.row_number().over(w)).where((F.col("tag") != "note") | F.col("step").isNull() | F.col("is_grace") | (F.col("_r") == 1) | (F.col("note_type") == "whole")).drop("_r", "onset", "end")


def undotted(elements: DataFrame, wrong: DataFrame) -> DataFrame:
    """Notes in `wrong` (bar and elem_idx) lose their dot: two thirds of the length, if that is whole."""
    marked = elements.join(wrong.select(*BAR, "elem_idx", F.lit(True).alias("_w")), [*BAR, "elem_idx"], "left")
    cut = F.coalesce("_w", F.lit(False)) & (F.col("dots") > 0) & (F.col("duration") * 2 % 3 == 0)
    return marked.withColumn("duration", F.when(cut, (F.col("duration") * 2 / 3).cast("int")).otherwise(F.col("duration"))).withColumn("dots", F.when(cut, 0).otherwise(F.col("dots"))).drop("_w")


def closed_up(elements: DataFrame) -> DataFrame:
    """Onsets within a voice one after another from its first: the running sum of lengths before each chord."""
    w = Window.partitionBy(*BAR, "staff", "voice").orderBy("elem_idx")
    leader = F.when(F.col("is_chord") | F.col("is_grace"), 0).otherwise(F.col("duration"))
    own = timed(elements).where("tag = 'note'")
    start = F.min("onset").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.coalesce(F.sum(leader).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumn("_at", start + before)
    held = F.last(F.when(~F.col("is_chord"), F.col("_at")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("onset", held).withColumn("end", held + F.coalesce("duration", F.lit(0))).drop("_at")


def tuplet_faults(elements: DataFrame) -> DataFrame:
    """Tuplet marks that don't pair: a start while one is open, a stop without a start, a start that is never closed. A state machine per voice."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, opened = [], None
        pdf = pdf.sort_values(["measure_idx", "elem_idx"])
        bar = None
        for r in pdf.itertuples():
            if bar is not None and r.measure_idx != bar and opened is not None:
                out.append((*opened, "open"))
                opened = None
            bar = r.measure_idx
            if r.tuplet_start:
                if opened is not None:
                    out.append((*opened, "doubled"))
                opened = (r.score_id, r.part_id, r.measure_idx, r.elem_idx)
            if r.tuplet_stop:
                if opened is None:
                    out.append((r.score_id, r.part_id, r.measure_idx, r.elem_idx, "orphan"))
                opened = None
        if opened is not None:
            out.append((*opened, "open"))
        return pd.DataFrame(out, columns=["score_id", "part_id", "measure_idx", "elem_idx", "fault"])

    own = elements.where("tag = 'note'").select(*BAR, "elem_idx", "staff", "voice", "tuplet_start", "tuplet_stop")
    return own.groupBy("score_id", "part_id", "staff", "voice").applyInPandas(run, "score_id string, part_id string, measure_idx int, elem_idx int, fault string")


def triplet_candidates(elements: DataFrame) -> DataFrame:
    """Voices of overfull bars in which equal, plain notes in groups of three would make the bar add up exactly at two thirds of their
    length. The proof is arithmetic: the other notes plus two thirds of the groups is the bar, and a third of a group is whole."""
    state = state_at_bars(elements)
    own = elements.where((F.col("tag") == "note") & ~F.col("is_chord") & ~F.col("is_grace"))
    plain = (F.col("dots") == 0) & F.col("actual_notes").isNull() & F.col("beam").isNotNull()
    w = Window.partitionBy(*BAR, "staff", "voice").orderBy("elem_idx")
    new = F.coalesce((F.lag("duration").over(w) != F.col("duration")) | ~F.lag(plain).over(w) | ~plain | (F.lag("beam").over(w) == "end"), F.lit(True))
    own = own.withColumn("_g", F.sum(new.cast("int")).over(w)).withColumn("_plain", plain)
    groups = own.groupBy(*BAR, "staff", "voice", "_g").agg(F.count("*").alias("n"), F.sum("duration").alias("length"), F.min("_plain").alias("plain"), F.min("elem_idx").alias("first"))
    groups = groups.withColumn("third", F.when(F.col("plain") & (F.col("n") == 3), F.col("length")).otherwise(0))
    summed = groups.groupBy(*BAR, "staff", "voice").agg(F.sum("length").alias("length"), F.sum("third").alias("third"), F.array_sort(F.collect_list(F.when(F.col("third") > 0, F.col("first")))).alias("groups"))
    full = S.bar_length(F.col("beats"), F.col("beat_type"), F.col("divisions"))
    return summed.join(state, BAR).withColumn("full", full).where("length > full and third > 0 and third % 3 = 0 and length - cast(third / 3 as bigint) = full").select(*BAR, "staff", "voice", "length", "full", "groups")


# ---- reports


def summary(elements: DataFrame) -> DataFrame:
    """Per score: parts, bars, notes, rests, bars with tuplets, divisions in use."""
    note = (F.col("tag") == "note") & F.col("step").isNotNull()
    return elements.groupBy("score_id").agg(
        F.countDistinct("part_id").alias("parts"), F.countDistinct("measure_idx").alias("bars"), F.count_if(note).alias("notes"), F.count_if(F.col("is_rest")).alias("rests"),
        F.countDistinct(F.when(F.col("actual_notes").isNotNull(), F.struct("part_id", "measure_idx"))).alias("tuplet_bars"), F.array_sort(F.collect_set("divisions")).alias("divisions"),
    )


def doubtful(elements: DataFrame, confidence: str, low: float = 0.7) -> DataFrame:
    """Notes read with little certainty, with their beat; notes without a certainty are left alone."""
    state = state_at_bars(elements).select(*BAR, F.col("divisions").alias("_d"))
    own = timed(elements).join(state, BAR).where((F.col("tag") == "note") & (F.col(confidence) < low))
    return own.select(*BAR, "measure_no", "staff", (F.col("onset") / F.col("_d") + 1).alias("beat"), "step", "octave", F.col(confidence).alias("confidence"))


def proofread(found: DataFrame, repairs: DataFrame) -> DataFrame:
    """Issues of bars with what was repaired there: one card per bar and staff with its worst kind."""
    severity = F.when(F.col("status") == "over", 0).when(F.col("status") == "empty", 1).when(F.col("status") == "short", 2).otherwise(3)
    own = found.where("status <> 'ok'").select("score_id", "measure_idx", "staff", "status").unionByName(repairs.select("score_id", "measure_idx", "staff", F.lit("repaired").alias("status")))
    return own.groupBy("score_id", "measure_idx", "staff").agg(F.min_by("status", severity).alias("worst"), F.array_sort(F.collect_set("status")).alias("kinds"))


def length_report(elements: DataFrame) -> DataFrame:
    """The report variant: voices against the bar's length; gaps that are only skipped don't count."""
    state = state_at_bars(elements).select(*BAR, "divisions", "beats", "beat_type")
    own = bars_by_voice(elements).join(state, BAR)
    quarters: Column = F.col("length") / F.col("divisions")
    return own.select(*BAR, "staff", "voice", quarters.alias("quarters"), status(quarters, S.bar_length(F.col("beats"), F.col("beat_type"), F.lit(1), "float")).alias("status"))
