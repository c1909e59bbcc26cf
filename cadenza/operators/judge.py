"""What was missing, extra or played instead."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.scalars import shown_extras

from .timeline import ordered


def substitutions(missing: list[int], extra: list[int], near: int = 2) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """(played, expected) pairs: within `near` steps first, then any; each extra takes the nearest note still missing, the first of equals."""
    missing, left, pairs = list(missing), list(extra), []
    for reach in (near, None):
        rest = []
        for e in left:
            fits = [m for m in missing if reach is None or abs(m - e) <= reach]
            if fits:
                m = min(fits, key=lambda x: abs(x - e))
                pairs.append((e, m))
                missing.remove(m)
            else:
                rest.append(e)
        left = rest
    return pairs, missing, left


def neighbours(keys: Sequence[str], order: Sequence[str | Column], notes: str) -> Column:
    """The notes of the rows just before and after: hands that aren't exactly together bleed into them."""
    w = ordered(keys, order)
    empty = F.array().cast("array<int>")
    return F.array_union(F.coalesce(F.lag(notes).over(w), empty), F.coalesce(F.lead(notes).over(w), empty))


def judged(sets: DataFrame, key: str, expected: str, heard: str, near: str | None = None) -> DataFrame:
    """key, missing, extra (without overtones of expected notes and the notes of the column `near`, if any), subs as text, status."""
    kind = sets.schema[key].dataType.simpleString()
    beyond = F.array_except(heard, expected) if near is None else F.array_except(F.array_except(heard, expected), F.coalesce(F.col(near), F.array().cast(sets.schema[near].dataType)))
    raw = sets.select(key, F.array_except(expected, heard).alias("missing"), shown_extras(beyond, F.col(expected)).alias("extra"))

    def paired(batches):
        for pdf in batches:
            rows = []
            for k, missing, extra in pdf.itertuples(index=False, name=None):
                subs, m, e = substitutions([int(x) for x in missing], [int(x) for x in extra])
                rows.append((k, ",".join(map(str, m)), ",".join(map(str, e)), ",".join(f"{a}>{b}" for a, b in subs), "ok" if not (m or e or subs) else "bad"))
            yield pd.DataFrame(rows, columns=[key, "missing", "extra", "subs", "status"])

    return raw.mapInPandas(paired, f"`{key}` {kind}, missing string, extra string, subs string, status string")


def present(prom: Column) -> Column:
    """A note is there if its first or third harmonic stands out, and two of the first four do (12 dB)."""
    loud = F.transform(prom, lambda p: (p > 12).cast("int"))
    of = F.aggregate(F.slice(loud, 1, 4), F.lit(0), lambda a, b: a + b)
    return ((F.element_at(loud, 1) == 1) | (F.element_at(loud, 3) == 1)) & (of >= 2)


def fresh(prom: Column, rise: Column) -> Column:
    """Struck at the onset: the first harmonic rose by 6 dB if it stands out (12 dB), else both the second and the third did."""
    first, second, third = (F.element_at(rise, k) for k in (1, 2, 3))
    return F.when(F.element_at(prom, 1) > 12, first).otherwise(F.least(second, third)) >= 6


def presence(prom: Column) -> Column:
    """How surely a note sounds: a third for each of the first four harmonics that stand out (12 dB), 1 at most, and half of that
    if neither the first nor the third does."""
    of = F.aggregate(F.slice(prom, 1, 4), F.lit(0.0), lambda a, p: a + (p > 12).cast("double"))
    return F.least(of / 3, F.lit(1.0)) * F.when((F.element_at(prom, 1) > 12) | (F.element_at(prom, 3) > 12), 1.0).otherwise(0.5)
