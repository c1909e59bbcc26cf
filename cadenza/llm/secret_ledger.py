"""Incremental blob ledger for secret scans, in DataFrame operations alone.

Every version of every path is content-addressed: its blob id is the SHA-256 of the text. The ledger holds the (blob, rule
version) pairs that were scanned and the findings; a scan reads only pairs that are not in it, one blob once however many
paths and versions hold it, and findings are joined back to all paths by blob id.

A rule's spans come from the pieces between its matches: `split` and `regexp_extract_all` run the same leftmost search, so
the lengths of pieces and matches sum up to the places. Code points are counted; ends are exclusive.

Cases: a null text is the empty blob; equal texts share one blob and one scan; null paths keep their rows; texts of any length
are scanned whole; an empty history gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written


@dataclass(frozen=True)
class Rule:
    """kind; pattern, searched leftmost without overlap; the group that is measured; the least code points of that group."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


#: Fixed values, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 32),
)
#: What the ledger looks for besides.
ADDED = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36}"),
)
RULES = BASE + ADDED
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _searched(rule: Rule) -> str:
    """The pattern with the least length built in where no shorter match can hide a longer one: a run of one class that is taken whole."""
    return {"access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}.get(rule.kind, rule.pattern) if rule in BASE else rule.pattern


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans in a text."""
    pattern = F.lit(_searched(rule))
    between, match = F.split(text, _searched(rule), -1), F.regexp_extract_all(text, pattern, F.lit(0))
    size = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else match
    place = F.aggregate(
        F.arrays_zip(F.transform(F.slice(between, 1, F.size(match)), F.length).alias("gap"), F.transform(match, F.length).alias("long"), F.transform(size, F.length).alias("size")),
        F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("spans")),
        lambda done, m: F.struct(
            (done["at"] + m["gap"] + m["long"]).alias("at"),
            F.when(
                m["size"] >= rule.least,
                F.concat(done["spans"], F.array(F.struct((done["at"] + m["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (done["at"] + m["gap"] + m["long"]).alias("end")))),
            )
            .otherwise(done["spans"])
            .alias("spans"),
        ),
        lambda done: done["spans"],
    )
    return F.when(text.rlike(_searched(rule)), place).otherwise(F.expr(f"cast(array() as {SPAN})"))


def scan(history: DataFrame, path: str = "path", text: str = "text", rules: tuple[Rule, ...] = RULES, scanned: DataFrame | None = None, findings: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """history: a row for each version of each path. scanned (blob, kind, version) and findings (blob, kind, version, spans): the ledger so far.

    Returns the versions with blob and spans (base and added rules, sorted), and the new ledger's two tables."""
    blobs = history.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    refs = written(blobs.select("path", "blob"), "blob_refs")
    spark = history.sparkSession
    rule_rows = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    if scanned is None:
        scanned = spark.createDataFrame([], "blob string, kind string, version int")
    if findings is None:
        findings = spark.createDataFrame([], f"blob string, kind string, version int, spans {SPAN}")
    # unseen pairs, as the kinds to scan for each blob
    done = scanned.join(F.broadcast(rule_rows), ["kind", "version"], "left_semi").groupBy("blob").agg(F.collect_set("kind").alias("done"))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    unseen = refs.groupBy("blob").agg(F.min("path").alias("path")).join(done, "blob", "left")
    unseen = unseen.select("path", "blob", F.when(F.col("done").isNull(), kinds).otherwise(F.array_except(kinds, "done")).alias("todo")).where(F.size("todo") > 0)
    # one path stands for each unseen blob; the key spreads copies, and where a path repeats a text its findings are equal
    own = unseen.select(F.col("path").alias("_path"), F.col("blob").alias("_blob"), "todo").hint("shuffle_hash")
    todo = blobs.join(own, F.col("path").eqNullSafe(F.col("_path")) & (F.col("blob") == F.col("_blob")))
    columns = [F.when(F.array_contains("todo", r.kind), spans_of(F.col("text"), r, k)).alias(r.kind) for k, r in enumerate(rules)]
    fresh = todo.select("blob", "todo", *columns)
    per_rule = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(r.kind).alias("spans")) for r in rules))
    fresh = written(fresh.select("blob", F.explode(F.filter(per_rule, lambda x: x["spans"].isNotNull())).alias("f")).select("blob", "f.*").dropDuplicates(["blob", "kind", "version"]), "fresh_findings")
    new_scanned = scanned.unionByName(fresh.select("blob", "kind", "version"))
    new_findings = findings.unionByName(fresh.where(F.size("spans") > 0))
    current = new_findings.join(F.broadcast(rule_rows), ["kind", "version"], "left_semi").groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    out = refs.join(current, "blob", "left").select("path", "blob", F.coalesce("spans", F.expr(f"cast(array() as {SPAN})")).alias("spans"))
    return out.withColumnRenamed("path", path), new_scanned, new_findings


def said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, path: str = "doc_id") -> DataFrame:
    """The digest columns of scan()."""
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in BASE]
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(path, *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
