"""Page geometry: components and staves from pixels, and the joins between symbols, bars and staves. u is the distance of staff lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- pixels


def components(ink: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, area) of the 8-connected parts of a mask: runs of each row are joined to touching runs of the row above."""
    parent: list[int] = []
    boxes: list[list[int]] = []

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(ink.astype(np.int8)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row, [0]])))
        runs, k = [], 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            label = len(parent)
            parent.append(label)
            boxes.append([a, y, b, y + 1, b - a])
            while k and above[k - 1][1] >= a:
                k -= 1
            while k < len(above) and above[k][0] <= b:
                if above[k][1] >= a:
                    x, z = sorted((find(above[k][2]), find(label)))
                    if x != z:
                        parent[z] = x
                        p, q = boxes[x], boxes[z]
                        boxes[x] = [min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]), p[4] + q[4]]
                k += 1
            runs.append((a, b, label))
        above = runs
    return sorted((x0, y0, x1 - x0, y1 - y0, n) for k, (x0, y0, x1, y1, n) in enumerate(boxes) if find(k) == k)


def line_bands(ink: np.ndarray, share: float = 0.25) -> list[tuple[int, int]]:
    """Runs of rows that are black over a share of the width."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (ink.mean(axis=1) >= share).astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def staves(ink: np.ndarray, share: float = 0.25) -> list[tuple[float, float, int, int, float]]:
    """(top, bottom, left, right, u) of five evenly spaced lines each."""
    middle = [(a + b) / 2 for a, b in line_bands(ink, share)]
    out, k = [], 0
    while k + 5 <= len(middle):
        gaps = np.diff(middle[k : k + 5])
        if gaps.max() <= 1.35 * gaps.min() and gaps.min() >= 4:
            columns = np.flatnonzero(ink[int(middle[k]) : int(middle[k + 4]) + 1].any(axis=0))
            out.append((middle[k], middle[k + 4], int(columns[0]), int(columns[-1]), float(gaps.mean())))
            k += 5
        else:
            k += 1
    return out


def line_distance(ink: np.ndarray) -> int | None:
    """The most frequent gap of 5 to 60 pixels between the middles of rows that hold a horizontal line, over the whole page: a run of
    ink of a twelfth of the width, 20 pixels at least. The least of equals; halves round to even."""
    reach = max(20, ink.shape[1] // 12)
    held = np.zeros(ink.shape[0], bool)
    for y, row in enumerate(ink.astype(np.int8)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row, [0]])))
        held[y] = len(edge) > 0 and (edge[1::2] - edge[::2]).max() >= reach
    edge = np.flatnonzero(np.diff(np.concatenate([[0], held.astype(np.int8), [0]])))
    gaps = np.round(np.diff((edge[::2] + edge[1::2] - 1) / 2)).astype(np.int64)
    gaps = gaps[(gaps >= 5) & (gaps <= 60)]
    return int(np.bincount(gaps).argmax()) if len(gaps) else None


def skew(gray: np.ndarray, most: float = 1.5, step: float = 0.05) -> float:
    """The shear in degrees at which row sums are sharpest; the smallest of equals."""
    ink = (gray < 128).astype(np.float32)
    x = np.arange(ink.shape[1]) - ink.shape[1] / 2
    rows, columns = np.nonzero(ink)

    def sharp(angle: float) -> float:
        moved = np.rint(rows + x[columns] * np.tan(np.radians(angle))).astype(np.int64)
        profile = np.bincount(np.clip(moved, 0, ink.shape[0] - 1), minlength=ink.shape[0])
        return float((np.diff(profile) ** 2).sum())

    angles = np.arange(-most, most + step / 2, step)
    return float(min(angles, key=lambda a: (-sharp(a), abs(a))))


def page_components(pages: DataFrame, page: str, width: str, height: str, pixels: str) -> DataFrame:
    """page, x, y, w, h, area of the ink of binary pages (one byte a pixel, dark below 128)."""
    kind = pages.schema[page].dataType.simpleString()

    def found(batches):
        for pdf in batches:
            rows = [(p, *c) for p, w, h, raw in pdf.itertuples(index=False, name=None) for c in components(np.frombuffer(raw, np.uint8).reshape(h, w) < 128)]
            yield pd.DataFrame(rows, columns=["page", "x", "y", "w", "h", "area"])

    return pages.select(page, width, height, pixels).mapInPandas(found, f"page {kind}, x int, y int, w int, h int, area int")


# ---- relations


def bar_of_point(points: DataFrame, stacks: DataFrame, staff_rows: DataFrame) -> DataFrame:
    """Points (sheet, id, x, y) with the first bar (sheet, stack, left, right) that holds x and whose nearest staff (stack, part, staff,
    top, bottom, u) is less than 5u away; stacks in order, then distance, part and staff decide."""
    p, s, t = points.alias("p"), stacks.alias("s"), staff_rows.alias("t")
    held = p.join(s, (F.col("p.sheet") == F.col("s.sheet")) & F.col("p.x").between(F.col("s.left"), F.col("s.right")))
    near = held.join(t, (F.col("s.sheet") == F.col("t.sheet")) & (F.col("s.stack") == F.col("t.stack")))
    far = outside(F.col("p.y"), F.col("t.top"), F.col("t.bottom"))
    own = near.select("p.*", "s.stack", "t.part", "t.staff", far.alias("distance"), "t.u").where("distance < 5 * u")
    w = Window.partitionBy("sheet", "id").orderBy("stack", "distance", "part", "staff")
    return own.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "u")


def outside(y: Column, top: Column, bottom: Column) -> Column:
    """How far y is from an interval; 0 inside."""
    return F.greatest(F.lit(0.0), top - y, y - bottom)


def nearest_staff(points: DataFrame, staff_rows: DataFrame) -> DataFrame:
    """Points (page, id, y) with the staff nearest to them; the first of equals. A page holds few staves."""
    both = points.join(staff_rows, "page").withColumn("distance", outside(F.col("y"), F.col("top"), F.col("bottom")))
    return both.groupBy("page", "id").agg(F.min_by("staff", F.struct("distance", "staff")).alias("staff"), F.min("distance").alias("distance"))


def slot_of(points: DataFrame, slots: DataFrame) -> DataFrame:
    """Points (stack, id, x) with the time slot nearest in x; the first of equals."""
    both = points.join(slots.select("stack", F.col("x").alias("slot_x"), "slot"), "stack")
    return both.groupBy("stack", "id").agg(F.min_by("slot", F.struct(F.abs(F.col("x") - F.col("slot_x")), "slot")).alias("slot"))


def octave_shift(notes: DataFrame, lines: DataFrame) -> DataFrame:
    """Notes (sheet, staff, id, x) with the diatonic shift of the first octave line (sheet, staff, line, x0, x1, shift) over them, else 0."""
    both = notes.join(lines, ["sheet", "staff"], "left").withColumn("hit", F.col("x").between(F.col("x0"), F.col("x1")))
    return both.groupBy("sheet", "staff", "id").agg(F.coalesce(F.min_by("shift", F.when(F.col("hit"), F.col("line"))), F.lit(0)).alias("shift"))


def twins(lines: DataFrame, u: float) -> DataFrame:
    """Lines (page, id, x0, x1, cy) that have a parallel one nearer than 1.5u with more than half of their width beside them."""
    x, y = lines.alias("x"), lines.alias("y")
    beside = F.least("x.x1", "y.x1") - F.greatest("x.x0", "y.x0")
    hit = (F.col("x.page") == F.col("y.page")) & (F.col("x.id") != F.col("y.id")) & (F.abs(F.col("x.cy") - F.col("y.cy")) < 1.5 * u) & (beside > 0.5 * (F.col("x.x1") - F.col("x.x0")))
    return x.join(y, hit, "left_semi")


def uncrowded(glyphs: DataFrame, others: DataFrame, gap: float) -> DataFrame:
    """Glyphs (page, x, y, w, h) without another one within `gap` beside them at the same height."""
    a, b = glyphs.alias("a"), others.alias("b")
    close = (F.col("b.x") <= F.col("a.x") + F.col("a.w") + gap) & (F.col("b.x") + F.col("b.w") >= F.col("a.x") - gap)
    level = F.least(F.col("a.y") + F.col("a.h"), F.col("b.y") + F.col("b.h")) > F.greatest("a.y", "b.y")
    same = (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    return a.join(b, (F.col("a.page") == F.col("b.page")) & close & level & ~same, "left_anti")


def shaped(parts: DataFrame, kind: str, u: float) -> DataFrame:
    """Components by shape, in units of u."""
    w, h, fill = F.col("w") / u, F.col("h") / u, F.col("area") / (F.col("w") * F.col("h"))
    rules = {
        "digit": (h.between(0.9, 2.2)) & (w.between(0.3, 1.6)),
        "tenuto": (h < 0.4) & (w.between(0.8, 2.0)) & (fill > 0.7),
        "accent": (h.between(0.6, 1.4)) & (w.between(1.0, 2.2)) & (fill < 0.55),
        "dot": (h.between(0.2, 0.6)) & (w.between(0.2, 0.6)) & (fill > 0.55),
    }
    return parts.where(rules[kind])
