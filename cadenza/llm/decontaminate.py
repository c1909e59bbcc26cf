"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, at containment 1.

A window is `size` consecutive words of an item (all its words where it has fewer). The tokens of every window are ordered
by rarity (document frequency over the whole corpus, counted first). For containment 1 one prefix token is necessary: the
window's rarest. The join of a document with the windows goes over that token alone; the length bound (the window must fit)
and the positional bound (the document place less the token's place in the window is where the window must begin) leave one
start for each candidate, and the words there are compared with the window exactly.

Items are taken in blocks of at most `block_windows` windows, read one after another, so what is broadcast has a fixed bound
however many items there are; each block is held against all documents. There is no shuffle of documents.

Cases: null and empty texts have no words and no hits; items without words give no window; repeated items and windows count
for each item id; repeated documents get equal rows; words of any length; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import utf8, written

#: ASCII other than digits and letters separates words; A-Z is lower-cased. UTF-8 bytes above 127 belong to words.
FOLD = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _rows(column: pa.Array) -> Iterator[bytes]:
    data, at = utf8(column)
    raw = memoryview(data)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield bytes(raw[a:b])


def item_blocks(items: DataFrame, key: str, text: str, size: int, block_windows: int) -> Iterator[dict[tuple[bytes, ...], list]]:
    """Windows with the ids of their items, in blocks."""
    block: dict[tuple[bytes, ...], list] = defaultdict(list)
    count = 0
    for row in items.select(key, text).toLocalIterator(prefetchPartitions=True):
        own = words((row[1] or "").encode())
        for w in {tuple(own[k : k + size]) for k in range(max(1, len(own) - size + 1))} if own else ():
            block[w].append(row[0])
            count += 1
        if count >= block_windows:
            yield block
            block, count = defaultdict(list), 0
    if block:
        yield block


def _frequencies(docs: DataFrame, text: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the vocabulary stands."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches):
        total: Counter[bytes] = Counter()
        for batch in batches:
            for raw in _rows(batch.column(0)):
                total.update(known.value.intersection(words(raw)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    got = docs.select(text).mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row per word of a block at most
    return {bytes(r.word): r.n for r in got}


def _index(block: dict[tuple[bytes, ...], list], frequency: dict[bytes, int]) -> dict[bytes, list[tuple[int, int]]]:
    """For each prefix token the (place in the window, window length) pairs under which it is one. Windows with a word of no document are left out."""
    places: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
    for w in block:
        if all(x in frequency for x in w):
            n, _, k = min((frequency[x], x, k) for k, x in enumerate(w))
            places[w[k]].add((k, len(w)))
    return {w: sorted(x) for w, x in places.items()}


def _scan(docs: DataFrame, key: str, text: str, windows: dict, places: dict, only_hits: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((places, dict(windows)))
    kind = docs.schema[key].dataType.simpleString()

    def joined(batches):
        places, windows = shared.value
        known = frozenset(places)
        for batch in batches:
            out = []
            for doc, raw in zip(batch.column(0).to_pylist(), _rows(batch.column(1))):
                own = words(raw)
                spans: set[tuple[int, int]] = set()
                items: set = set()
                if not known.isdisjoint(own):
                    n = len(own)
                    for at, w in enumerate(own):
                        if w in known:
                            for k, length in places[w]:
                                low = at - k
                                if low >= 0 and low + length <= n and (found := windows.get(tuple(own[low : low + length]))):
                                    spans.add((low, low + length))
                                    items.update(found)
                if spans or not only_hits:
                    merged: list[list[int]] = []
                    for a, b in sorted(spans):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    out.append((doc, len(own), [{"start": a, "end": b} for a, b in merged], sorted(map(str, items))))
            columns = list(zip(*out)) if out else [[]] * 4
            kinds = [batch.schema.field(0).type, pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], [key, "n_words", "spans", "items"])

    return docs.select(key, text).mapInArrow(joined, f"`{key}` {kind}, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_windows: int = 200_000) -> DataFrame:
    """For every document: key, n_words, spans (word runs inside occurrences of windows, merged) and items (their ids as strings, sorted).

    Rows of equal key and text share what their blocks found, which is equal for them."""
    scans = []
    for block in item_blocks(items, item_key, item_text, size, block_windows):
        frequency = _frequencies(docs, text, frozenset(chain.from_iterable(block)))
        scans.append((dict(block), _index(block, frequency)))
        if len(scans) == 2:
            break
    else:
        return _scan(docs, key, text, *(scans[0] if scans else ({}, {})), only_hits=False)
    # more than one block: hits of each block go to a table, and meet by document afterwards
    hashed = docs.select(F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("hash")).alias("doc"), F.col(text).alias("text"))
    hits = None
    for block in item_blocks(items, item_key, item_text, size, block_windows):
        index = _index(block, _frequencies(docs, text, frozenset(chain.from_iterable(block))))
        found = written(_scan_pairs(hashed, dict(block), index), "decontamination_hits")
        hits = found if hits is None else hits.unionByName(found)
    gathered = hits.groupBy("id", "hash").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda done, x: F.when((F.size(done) > 0) & (x["start"] <= F.element_at(done, -1)["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x))),
    )
    counted = _scan(docs, key, text, {}, {}, only_hits=False).select(F.col(key), "n_words")
    keyed = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_hash"), text)
    counted = _scan(keyed.withColumn("_doc", F.to_json(F.struct("_id", "_hash"), {"ignoreNullFields": "false"})), "_doc", text, {}, {}, only_hits=False)
    shape = docs.select(F.struct(F.col(key).alias("_id"), F.xxhash64(text).alias("_hash"))).schema[0].dataType
    counted = counted.select(F.from_json("_doc", shape).alias("d"), "n_words").select("d._id", "d._hash", "n_words")
    both = counted.join(gathered.withColumn("spans", merged), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("hash")), "left")
    return both.select(F.col("_id").alias(key), "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def _scan_pairs(hashed: DataFrame, windows: dict, places: dict) -> DataFrame:
    """The hits of one block by (id, hash)."""
    shape = hashed.schema["doc"].dataType
    said = hashed.select(F.to_json("doc", {"ignoreNullFields": "false"}).alias("doc"), "text")
    found = _scan(said, "doc", "text", windows, places, only_hits=True)
    return found.select(F.from_json("doc", shape).alias("d"), "spans", "items").select("d.id", "d.hash", "spans", "items")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of contamination()."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(key, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def item_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
