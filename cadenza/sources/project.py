"""Recogniser project files: a zip with one XML per sheet, as symbol nodes, typed edges and bar stacks."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHEET = re.compile(r"sheet#(\d+)/sheet#\1\.xml$")
NODES = "project string, sheet int, id string, kind string, x int, y int, w int, h int, grade double, pitch int, shape string"
EDGES = "project string, sheet int, source string, target string, relation string"
STACKS = "project string, sheet int, system int, stack int, left double, right double, special string, slots array<struct<x:double,num:int,den:int>>"


def sheets(data: bytes) -> list[tuple[int, ET.Element]]:
    """The sheets of a project in numeric order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found = sorted((int(m[1]), n) for n in z.namelist() if (m := SHEET.search(n)))
        return [(k, ET.fromstring(z.read(n))) for k, n in found]


def nodes(root: ET.Element) -> list[tuple]:
    """Everything with an id and bounds: (id, kind, x, y, w, h, grade, pitch, shape)."""
    out = []
    for e in root.iter():
        box = e.find("bounds")
        if e.get("id") and box is not None:
            x, y, w, h = (int(float(box.get(k, 0))) for k in "xywh")
            out.append((e.get("id"), e.tag, x, y, w, h, float(e.get("grade", 0)), int(e.get("pitch")) if e.get("pitch") else None, e.get("shape")))
    return out


def edges(root: ET.Element) -> list[tuple]:
    return [(r.get("source"), r.get("target"), next((c.tag for c in r), r.get("kind", ""))) for r in root.iter("relation")]


def stacks(root: ET.Element) -> list[tuple]:
    """(system, stack, left, right, special, slots): slot times are exact fractions of a whole note."""
    out = []
    for s, system in enumerate(root.iter("system")):
        for k, stack in enumerate(system.iter("stack")):
            slots = []
            for slot in stack.iter("slot"):
                num, _, den = (slot.get("time-offset") or "0").partition("/")
                slots.append((float(slot.get("x-offset", 0)) + float(stack.get("left", 0)), int(num), int(den or 1)))
            out.append((s, k, float(stack.get("left", 0)), float(stack.get("right", 0)), stack.get("special"), slots))
    return out


def _read(spark: SparkSession, path: str, rows_of, schema: str) -> DataFrame:
    names = [c.name for c in spark.createDataFrame([], schema).schema]

    def parsed(batches):
        for pdf in batches:
            rows = [(name.rsplit("/", 1)[-1], k, *r) for name, data in pdf.itertuples(index=False, name=None) for k, root in sheets(data) for r in rows_of(root)]
            yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.omr").load(path)
    return files.select("path", "content").mapInPandas(parsed, schema)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, nodes, NODES)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, edges, EDGES)


def read_stacks(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, lambda root: [(*r[:5], [{"x": x, "num": n, "den": d} for x, n, d in r[5]]) for r in stacks(root)], STACKS)


def clefs(node_rows: DataFrame, stack_rows: DataFrame) -> DataFrame:
    """Clefs with the bar that holds them: header in the first bar of a system, end beyond 85 % of a bar's width, mid otherwise."""
    at = F.col("c.x") + F.col("c.w") / 2
    c, s = node_rows.where("kind = 'clef'").alias("c"), stack_rows.alias("s")
    both = c.join(s, (F.col("c.project") == F.col("s.project")) & (F.col("c.sheet") == F.col("s.sheet")) & (at >= F.col("s.left")) & (at < F.col("s.right")))
    part = (at - F.col("s.left")) / (F.col("s.right") - F.col("s.left"))
    where = F.when(part >= 0.85, "end").when((F.col("s.stack") == 0) & (part < 0.25), "header").otherwise("mid")
    return both.select("c.project", "c.sheet", "s.system", "s.stack", "c.id", "c.shape", where.alias("place"))


def orphans(node_rows: DataFrame, edge_rows: DataFrame, voiced: str = "voice", least: float = 0.5) -> DataFrame:
    """Chords of some certainty that no voice holds."""
    held = edge_rows.where(F.col("relation") == voiced).select("project", "sheet", F.col("target").alias("id"))
    return node_rows.where((F.col("kind").isin("head-chord", "rest-chord")) & (F.col("grade") >= least)).join(held, ["project", "sheet", "id"], "left_anti")
