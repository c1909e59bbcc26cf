"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written

#: Up to so many edges one task joins by itself what takes rounds of shuffles otherwise.
FEW = 200_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _joined(batches):
    """node and component of a bounded number of edges."""
    above: dict = {}

    def top(x):
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            above.setdefault(u, u)
            above.setdefault(v, v)
            x, y = sorted((top(u), top(v)))
            above[y] = x
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.array(list(above), kind), pa.array([top(x) for x in above], kind)], ["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges (a, b) -> (node, component): the least node that links reach. Self-loops and repeats are allowed; no edges, no rows.

    Null ends have no edge. Up to FEW edges are joined by one task. Beyond, stars meet their centre by a join that the engine can split where a centre has very many neighbours; only a count and a
    checksum of the edges reach the driver."""
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    if now.count() <= FEW:
        kind = now.schema["u"].dataType.simpleString()
        return now.repartition(1).mapInArrow(_joined, f"node {kind}, component {kind}")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", F.col("u")).alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = written(small.select("e.*").where("u <> v").distinct(), "edges")
        new = _state(after)
        dropped(now)
        now = after
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
