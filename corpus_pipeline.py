"""The corpus pipeline: each stage works on what the one before it kept, as a written table, and its decisions take effect."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import byte_bpe, decontaminate, jaccard_join, secret_ledger, weak_toxicity
from cadenza.llm.shared import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_row(docs: DataFrame) -> DataFrame:
    """Each row with `row`, 63 bits of hash of its key and text: keys may be null or repeat, and stages decide about rows."""
    return docs.select(*COLUMNS, F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("row"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go, whatever their key."""
    rows = by_row(docs)
    scored = weak_toxicity.toxicity(rows, table(spark, sf_dir, "labels"), carried=("row",))
    rejected = written(scored.where("predicted = 1").select("row").distinct(), "rejected")
    return rows.join(rejected, "row", "left_anti").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least key of each group stays, null keys last; of rows of equal key and text, one."""
    rows = by_row(docs)
    found = written(jaccard_join.jaccard_components(rows, key="row").select("row", "component_id").distinct(), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    least = found.join(rows.select("doc_id", "row").distinct(), "row").groupBy("component_id").agg(F.min(place).alias("at"))
    kept = written(least.select("at.row"), "representatives")
    return rows.join(kept, "row", "left_semi").dropDuplicates(["row"]).select(COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of a benchmark item go."""
    rows = by_row(docs)
    found = decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), key="row")
    hit = written(found.where(F.size("spans") > 0).select("row").distinct(), "contaminated")
    return rows.join(hit, "row", "left_anti").select(COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are cut out of the texts; n_chars follows."""
    rows = by_row(docs)
    found, _, _ = secret_ledger.scan(rows, path="row")
    spans = found.where(F.size("spans") > 0).select("row", "spans").dropDuplicates(["row"])
    # spans may overlap: what is kept is between the furthest end so far and the next start
    cut = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("kept")),
        lambda done, s: F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.concat(done["kept"], F.when(s["start"] > done["at"], F.substring(F.col("text"), done["at"] + 1, s["start"] - done["at"])).otherwise("")).alias("kept"),
        ),
        lambda done: F.concat(done["kept"], F.substring(F.col("text"), done["at"] + 1, F.length("text"))),
    )
    joined = rows.join(spans.hint("shuffle_hash"), "row", "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut)
    return joined.withColumn("text", text).withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of what is left."""
    return byte_bpe.encode_column(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("secrets", secrets),
    ("byte_bpe", tokens),
]

#: Toxicity is a fitted model and ids are merges: SQL expresses neither. tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
