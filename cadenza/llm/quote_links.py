"""Quotation linking: nested quotes are parsed, hashed, joined to the messages they come from, and left out of the conversation.

A line that begins with '>' marks (spaces between them allowed) is quoted as deep as it has marks. Neighbouring lines of one
depth are a passage. Passages are normalised (case-folded, white space collapsed) and hashed as a whole and line by line; the
same is done with what every message says itself. A quoted passage links to the latest earlier message of its conversation that
says it, else to the first message anywhere else that says it; a passage that nobody says as a whole links by its first line that
somebody says. A message's parent is what its shallowest linked passage of the own conversation links to.

Only hashes that are quoted somewhere take part in the join. The search for the latest earlier message is dealt out by
conversation, hash and block of turns, with block summaries in between, so that a line that fills a conversation doesn't fill a
task; elsewhere-links use one row for each hash, with its first
message and the first one of any other conversation. Roots are found by pointer jumping.

Cases: null and empty texts say and quote nothing; a line "X wrote:" before a quote belongs to the quote; empty quoted lines are
dropped; repeated rows of a turn are one message with all their passages, and each row is returned; null keys link to nothing;
quotes of later or unknown messages stay unlinked; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import texts, written

MARKS = re.compile(r"[ \t]*((?:>[ \t]*)+)")
WROTE = re.compile(r"(?:on\b.*|.{1,80})\b(?:wrote|writes|said|schrieb|escribió|a écrit)\s*:\s*$", re.IGNORECASE)
TURNS = 1024


def parse(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """What a message says itself, and its quoted passages as (depth, lines)."""
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    last = 0
    if ">" not in text:
        return text, quotes
    for line in text.split("\n"):
        m = MARKS.match(line)
        depth = m.group(1).count(">") if m else 0
        if depth:
            if not last and own and WROTE.match(own[-1]):
                own.pop()
            said = line[m.end() :].strip()
            if depth != last:
                quotes.append((depth, []))
            if said:
                quotes[-1][1].append(said)
        else:
            own.append(line)
        last = depth
    return "\n".join(own).strip("\n"), [q for q in quotes if q[1]]


def normalised(text: str) -> str:
    return " ".join(text.casefold().split())


def digest(text: str) -> bytes | None:
    said = normalised(text)
    return hashlib.blake2b(said.encode(), digest_size=16).digest() if said else None


def _own_hashes(own: str) -> set[bytes]:
    parts = [own, *re.split(r"\n[ \t]*\n", own), *own.split("\n")]
    return {d for p in parts if (d := digest(p))}


PARSED = "n_quotes long, clean string, says array<binary>, quotes array<struct<place:int,depth:int,line:int,hash:binary>>"


def parsed(messages: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """Each message with what it says and quotes. quotes: for each passage its own hash at line 0 and its lines' from 1 on."""
    kinds = {c: messages.schema[c].dataType.simpleString() for c in (conv, turn)}
    quote = pa.struct([("place", pa.int32()), ("depth", pa.int32()), ("line", pa.int32()), ("hash", pa.binary())])

    def read(batches):
        for batch in batches:
            count, clean, says, quotes = [], [], [], []
            for t in texts(batch.column(2)):
                own, found = parse(t)
                count.append(len(found))
                clean.append(own)
                says.append(sorted(_own_hashes(own)))
                quotes.append([{"place": p, "depth": d, "line": k, "hash": h} for p, (d, lines) in enumerate(found) for k, s in enumerate(["\n".join(lines), *lines]) if (h := digest(s))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(count, pa.int64()), pa.array(clean, pa.string()), pa.array(says, pa.list_(pa.binary())), pa.array(quotes, pa.list_(quote))],
                ["conv", "turn", "rest", "n_quotes", "clean", "says", "quotes"],
            )

    rest = F.col("role") if "role" in messages.columns else F.lit(None).cast("string")
    chosen = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(text).alias("text"), rest.cast("string").alias("rest"))
    return chosen.mapInArrow(read, f"conv {kinds[conv]}, turn {kinds[turn]}, rest string, {PARSED}")


def _links(own: DataFrame) -> DataFrame:
    """conv, turn, place, depth, to_conv, to_turn of the quoted passages that link."""
    quotes = own.where(F.size("quotes") > 0).select("conv", "turn", F.explode("quotes").alias("q")).select("conv", "turn", "q.*").distinct()
    wanted = quotes.select("hash").distinct()
    says = own.where(F.col("conv").isNotNull() & F.col("turn").isNotNull()).select("conv", "turn", F.explode("says").alias("hash")).join(wanted, "hash", "left_semi").distinct()
    says = written(says, "quoted_messages")
    block = F.floor(F.col("turn") / TURNS)
    # in the own conversation: the latest earlier turn of the block, else of the last block before
    both = says.select("conv", "hash", "turn", F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("int").alias("line")).unionByName(quotes.select("conv", "hash", "turn", "place", "depth", "line"))
    both = both.withColumn("block", block).withColumn("said", F.when(F.col("place").isNull(), F.col("turn")))
    within = Window.partitionBy("conv", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("said").over(within)).where(F.col("place").isNotNull())
    blocks = both.groupBy("conv", "hash", "block").agg(F.max("said").alias("last"))
    before = Window.partitionBy("conv", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("far", F.max("last").over(before)).select("conv", "hash", "block", "far")
    inside = near.join(blocks, ["conv", "hash", "block"]).withColumn("here", F.coalesce("near", "far"))
    # elsewhere: the first message of all, and the first of the other conversations for quotes in that one's own
    first = written(says.groupBy("hash").agg(F.min(F.struct("conv", "turn")).alias("first")), "first_messages")
    others = says.join(first, "hash").where(F.col("conv") != F.col("first.conv")).groupBy("hash").agg(F.min(F.struct("conv", "turn")).alias("other"))
    sayers = first.join(others, "hash", "left")
    found = inside.join(sayers, "hash", "left").withColumn("to", F.when(F.col("here").isNotNull(), F.struct(F.col("conv").alias("conv"), F.col("here").alias("turn"))).when(F.col("first.conv") != F.col("conv"), F.col("first")).when(F.col("conv").isNotNull(), F.col("other")))
    return found.where("to is not null").groupBy("conv", "turn", "place", "depth").agg(F.min(F.struct("line", F.col("to.conv").alias("c"), F.col("to.turn").alias("t"))).alias("best")).select("conv", "turn", "place", "depth", F.col("best.c").alias("to_conv"), F.col("best.t").alias("to_turn"))


def _roots(parents: DataFrame) -> DataFrame:
    """conv, turn -> root_turn and reply_depth of messages with a parent, by pointer jumping."""
    now = written(parents.select("conv", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("steps")), "pointers")
    while True:
        over = now.select("conv", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        joined = now.join(over, ["conv", "up"], "left")
        moved = written(joined.select("conv", "turn", F.coalesce("next", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")), "pointers")
        if moved.where("moved").isEmpty():
            return moved.select("conv", "turn", F.col("up").alias("root_turn"), F.col("steps").alias("reply_depth"))
        now = moved.drop("moved")


def linked_conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Every message without its quotes: conv, turn, role, n_quotes, n_linked, links (place, depth, to_conv, to_turn), parent_turn, root_turn,
    reply_depth and clean. Ordered by (root_turn, turn), a conversation reads in reply order."""
    own = written(parsed(messages, conv, turn, text), "parsed_messages")
    links = written(_links(own), "quote_links")
    per = links.groupBy("conv", "turn").agg(
        F.count("*").alias("n_linked"),
        F.array_sort(F.collect_list(F.struct("place", "depth", "to_conv", "to_turn"))).alias("links"),
        F.min(F.when(F.col("to_conv") == F.col("conv"), F.struct("depth", "place", "to_turn"))).alias("up"),
    )
    per = written(per.select("conv", "turn", "n_linked", "links", F.col("up.to_turn").alias("parent_turn")), "message_links")
    parents = per.where("parent_turn is not null")
    out = own.join(per, ["conv", "turn"], "left")
    if parents.isEmpty():
        out = out.withColumn("root_turn", F.col("turn")).withColumn("reply_depth", F.lit(0).cast("long"))
    else:
        out = out.join(_roots(parents), ["conv", "turn"], "left").withColumn("root_turn", F.coalesce("root_turn", "turn")).withColumn("reply_depth", F.coalesce("reply_depth", F.lit(0).cast("long")))
    none = F.array().cast(per.schema["links"].dataType)
    return out.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("rest").alias("role"), "n_quotes", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"),
        F.coalesce("links", none).alias("links"), "parent_turn", "root_turn", "reply_depth", "clean",
    )
