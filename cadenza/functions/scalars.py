"""Scalar expressions on pitches, bars and intervals; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semitones above C; note names; the order of sharps.
STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
SHARPS = "FCGDAEB"


def midi(step: Column, octave: Column, alter: Column) -> Column:
    """The MIDI number; a fractional alteration is cut towards zero, none counts as 0."""
    base = F.element_at(F.create_map(*(F.lit(x) for kv in STEPS.items() for x in kv)), step)
    return 12 * (octave + 1) + base + F.coalesce(alter.cast("double").cast("int"), F.lit(0))


def note_name(number: Column) -> Column:
    return F.concat(F.element_at(F.array(*map(F.lit, NAMES)), (F.pmod(number, F.lit(12)) + 1).cast("int")), (F.floor(number / 12) - 1).cast("string"))


def hertz(number: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), (number - 69) / 12)


def decibel(power: Column, floor: Column) -> Column:
    """20 log10 of a ratio; minus infinity for no power."""
    return F.when(power == 0, F.lit(float("-inf"))).otherwise(20 * F.log10(power / floor))


def key_alter(fifths: Column, step: Column) -> Column:
    """+1, -1 or 0: what a key signature does to a step."""
    sharp = F.instr(F.substring(F.lit(SHARPS), F.lit(1), F.greatest(fifths, F.lit(0))), step)
    flat = F.instr(F.substring(F.lit(SHARPS[::-1]), F.lit(1), F.greatest(-fifths, F.lit(0))), step)
    return F.when(sharp > 0, 1).when(flat > 0, -1).otherwise(0)


def diatonic(step: Column, octave: Column) -> Column:
    return octave * 7 + F.instr(F.lit("CDEFGAB"), step) - 1


def middle_line(sign: Column, octave_change: Column) -> Column:
    """The diatonic number of a clef's middle line: B4 for G, D3 for F, C4 for C; null for other signs."""
    return F.when(sign == "G", 34).when(sign == "F", 22).when(sign == "C", 28) + 7 * F.coalesce(octave_change, F.lit(0))


def bar_length(beats: Column, beat_type: Column, divisions: Column, variant: str = "floor") -> Column:
    """floor: whole divisions; float: quarters, exact; round: whole divisions, nearest."""
    if variant == "floor":
        return F.floor(beats * 4 * divisions / beat_type)
    if variant == "float":
        return beats * 4.0 / beat_type
    return F.round(beats * 4.0 * divisions / beat_type)


def dotted(quarters: Column, dots: Column, divisions: Column) -> Column:
    return quarters * (2 - F.pow(F.lit(0.5), dots)) * divisions


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.least(a1, b1) - F.greatest(a0, b0)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def least_common_multiple(values: Column) -> Column:
    """Of an array of positive whole numbers; Euclid's steps run in a bounded fold (a 64-bit pair needs at most 92). Divided as
    whole numbers, as doubles would be wrong beyond 2**53."""
    steps = F.sequence(F.lit(1), F.lit(92))

    def gcd(a: Column, b: Column) -> Column:
        return F.aggregate(steps, F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.greatest(s["b"], F.lit(1).cast("long"))).alias("b"))), lambda s: s["a"])

    return F.aggregate(values, F.lit(1).cast("long"), lambda done, x: F.call_function("div", done, gcd(done, x.cast("long"))) * x.cast("long"))


def shown_extras(extra: Column, expected: Column) -> Column:
    """Extra notes that are no overtone of an expected one."""
    overtones = F.array(*(F.lit(k) for k in (12, 19, 24, 28, 31, 34, 36)))
    return F.filter(extra, lambda x: ~F.exists(expected, lambda e: F.array_contains(overtones, F.abs(x - e))))
