"""Removal of repeated byte strings by external induced suffix sorting.

Which bytes lie in a string of `length` bytes that also starts elsewhere is decided in four steps.

 1. Every window of `length` bytes picks the least of its GRAM-byte hashes (leftmost of equals). Equal windows pick equal
    hashes, so windows that repeat meet under their pick. Neighbouring windows with one pick form a context: the bytes from
    the first window's start to the last one's end. About one context per length / 2 bytes leaves the scan, as two hashes.
 2. Picks that occur once are dropped. A context that occurs twice as it is, is repeated from end to end; copies, however
    many, meet in a count that is combined before it is shuffled.
 3. Picks with several different contexts need their text. One occurrence of each context is dealt out by its pick, and each
    shard is suffix-sorted by induced sorting: suffixes that begin a descent are named and sorted first (recursively through
    their names), and queues, one for each first symbol, carry the suffix places that they induce, first the L-types and then
    the S-types. Queues go to disk when a shard's memory is spent. Neighbours in the suffix order whose common prefix reaches
    `length` mark each other's window. A pick whose different contexts are longer together than a shard is not sorted: its
    windows are dealt out by exact keys. Equal windows have their pick at one offset, so all windows of a block of offsets
    share the bytes around the pick that the block has in common. Contexts that are equal over the whole span of a block
    repeat its windows; where only the common bytes are equal, the block's windows are counted one by one.
 4. Marks of a context hold for all its occurrences; marks of a document are merged and cut out of its bytes.

Cases: null and empty texts and those shorter than `length` keep all bytes; matches never cross documents; repeated rows
repeat each other; overlapping repeats count, as judged on the input; texts of any length are read whole; the key may be null
or repeat; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, mixed, slices, utf8, weights, written

GRAM = 64
PIECE = 1 << 22
SHARD = 1_500_000
BLOCKS = 16
TABLE = mixed(weights(256, 101))
STEP = weights(16, 103)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` bytes (shorter runs at the end are left out)."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, width, out, done = TABLE[data], 1, None, 0
    bit = 0
    while width <= size:
        if size & width:
            part = level[done : done + n]
            out = part.copy() if out is None else out * STEP[bit] + part
            done += width
        if 2 * width <= size:
            level = level[:-width] * STEP[bit + 1] + level[width:]
        width, bit = 2 * width, bit + 1
    return mixed(out)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values."""
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    square = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    square[: len(x)] = x
    square = square.reshape(rows, w)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def contexts(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For the texts data[at[k]:at[k + 1]]: row, pick hash, first and last window start (within the text), pick place less the first."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none, none, none
    out = []
    for low in range(0, len(data) - length + 1, PIECE):
        part = data[low : low + PIECE + length - 1]
        h = gram_hashes(part, GRAM)
        place = np.arange(len(h), dtype=np.uint64)
        pick = (_least((h & ~np.uint64((1 << 23) - 1)) | place, length - GRAM + 1) & np.uint64((1 << 23) - 1)).astype(np.int64)
        start = np.arange(len(pick)) + low
        row = np.searchsorted(at, start, "right") - 1
        keep = start + length <= at[row + 1]
        pick, start, row = pick[keep], start[keep], row[keep]
        if not len(pick):
            continue
        cut = np.flatnonzero((np.diff(pick) != 0) | (np.diff(row) != 0)) + 1
        first = np.concatenate([[0], cut])
        last = np.append(cut, len(pick)) - 1
        out.append((row[first], h[pick[first]], start[first] - at[row[first]], start[last] - at[row[first]], pick[first] + low - start[first]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none.astype(np.uint64), none, none, none)


class Queue:
    """Arrays in the order they came; on disk beyond the shared budget."""

    def __init__(self, owner: dict):
        self.owner, self.parts = owner, []

    def push(self, x: np.ndarray) -> None:
        if self.owner["held"] + x.nbytes > self.owner["budget"]:
            f = tempfile.TemporaryFile()  # the worker's own scratch; gone when closed
            np.save(f, x)
            self.parts.append(f)
        else:
            self.owner["held"] += x.nbytes
            self.parts.append(x)

    def all(self) -> np.ndarray:
        out = []
        for x in self.parts:
            if isinstance(x, np.ndarray):
                self.owner["held"] -= x.nbytes
                out.append(x)
            else:
                x.seek(0)
                out.append(np.load(x))
                x.close()
        self.parts = []
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _names(text: np.ndarray, stype: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each place to the next one (both ends included), by symbol and type."""
    symbol = 2 * text.astype(np.uint64) + stype + np.uint64(1)
    width = 4 if int(symbol.max()) < 1 << 16 else 2
    bits = 64 // width
    end = np.append(place[1:] + 1, len(text))
    padded = np.append(symbol, np.zeros(width, np.uint64))
    group = np.zeros(len(place), np.int64)
    todo, depth = np.arange(len(place)), 0
    while len(todo):
        key = np.zeros(len(todo), np.uint64)
        for k in range(width):
            at = place[todo] + depth + k
            inside = at < end[todo]
            key = (key << np.uint64(bits)) | np.where(inside, padded[np.minimum(at, len(text))], 0).astype(np.uint64)
        order = np.lexsort((key, group[todo]))
        g, k = group[todo][order], key[order]
        new_group = np.concatenate([[True], g[1:] != g[:-1]])
        fresh = new_group | np.concatenate([[True], k[1:] != k[:-1]])
        begin = np.maximum.accumulate(np.where(new_group, np.arange(len(g)), 0))
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(g)), 0))
        group[todo[order]] = g + head - begin
        depth += width
        size = np.diff(np.append(np.flatnonzero(fresh), len(g)))
        alone = np.repeat(size == 1, size)
        over = place[todo[order]] + depth >= end[todo[order]]
        todo = np.sort(todo[order][~(alone | over)])
    return np.unique(group, return_inverse=True)[1]


def _doubled(rank: np.ndarray) -> np.ndarray:
    """Suffix order of a string over a large alphabet, by rank doubling."""
    n, step = len(rank), 1
    rank = rank.astype(np.int64) + 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:]
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[1], (np.diff(key[order]) != 0).astype(np.int64)])
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(fresh)
        rank = new
        if rank[order[-1]] == n or step >= n:
            return order
        step *= 2


def suffix_order(text: np.ndarray, budget: int = 1 << 27, most_symbols: int = 4096) -> np.ndarray:
    """The suffix array of a string of symbols >= 0 by induced sorting; its end counts as less than any symbol."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    follower = np.append(text[1:].astype(np.int64), -1)
    differs = np.where(text != follower, np.arange(n), n)
    stype = (text < follower)[np.minimum.accumulate(differs[::-1])[::-1]]
    place = np.flatnonzero(stype[1:] & ~stype[:-1]) + 1
    if len(place) > 1:
        name = _names(text, stype, place)
        if name.max() + 1 == len(name):
            order = np.empty(len(name), np.int64)
            order[name] = np.arange(len(name))
        elif name.max() < most_symbols:
            order = suffix_order(name, budget, most_symbols)
        else:
            order = _doubled(name)
        place = place[order]
    owner = {"held": 0, "budget": budget}
    symbols = int(text.max()) + 1
    queue = [Queue(owner) for _ in range(symbols)]
    first = text[place]
    starts = np.searchsorted(first, np.arange(symbols + 1)) if len(place) else np.zeros(symbols + 1, np.int64)

    def induce(front: np.ndarray, kind: bool, skip: int) -> np.ndarray:
        """Push what the places of front induce; those whose symbol is `skip` are returned instead."""
        before = front[front > 0] - 1
        before = before[stype[before] == kind]
        symbol = text[before]
        own = symbol == skip
        same = before[own]
        if len(same) < len(before):
            before, symbol = before[~own], symbol[~own]
            order = np.argsort(symbol, kind="stable")
            before, symbol = before[order], symbol[order]
            cut = np.flatnonzero(np.diff(symbol)) + 1
            for part, c in zip(np.split(before, cut), symbol[np.concatenate([[0], cut])].tolist()):
                queue[c].push(part)
        return same

    queue[int(text[-1])].push(np.array([n - 1]))
    ltype = [Queue(owner) for _ in range(symbols)]
    for c in range(symbols):
        front = queue[c].all()
        while len(front):
            ltype[c].push(front)
            front = induce(front, False, c)
        if starts[c + 1] > starts[c]:
            induce(place[starts[c] : starts[c + 1]], False, -1)
    out = np.empty(n, np.int64)
    high = n
    for c in range(symbols - 1, -1, -1):
        front = queue[c].all()
        while len(front):
            out[high - len(front) : high] = front[::-1]
            high -= len(front)
            front = induce(front, True, c)
        own = ltype[c].all()
        out[high - len(own) : high] = own
        high -= len(own)
        induce(own[::-1], True, -1)
    return out


def repeated_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, whether the window at each place occurs at another place of the parts."""
    size = np.array([len(p) for p in parts], np.int64)
    at = np.concatenate([[0], np.cumsum(size + 1)])
    data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    text = data.astype(np.int16) + 1
    text[at[1:] - 1] = 0
    order = suffix_order(text)
    window = np.zeros(len(data), bool)
    for a, n in zip(at.tolist(), size.tolist()):
        window[a : a + max(0, n - length + 1)] = True
    h = np.zeros(len(data), np.uint64)
    got = gram_hashes(data, length)
    h[: len(got)] = got
    x, y = order[:-1], order[1:]
    equal = np.flatnonzero(window[x] & window[y] & (h[x] == h[y]))
    mark = np.zeros(len(data), bool)
    mark[x[equal]] = mark[y[equal]] = True
    return [mark[a : a + max(0, n - length + 1)] for a, n in zip(at.tolist(), size.tolist())]


def _digest(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)


def blocks(raw: bytes, length: int) -> list[tuple[int, int, int, int, int]]:
    """block, core, whole, low, high of a context: its windows from low to high have their pick at the offsets of one block. core is a
    hash of the bytes that all windows with such an offset hold, whole one of the windows' bytes and offsets."""
    most = length - GRAM
    width = -(-(most + 1) // BLOCKS)
    # as contexts() picks: the leftmost of the first window's least hashes
    pick = int((gram_hashes(np.frombuffer(raw, np.uint8)[:length], GRAM) >> np.uint64(23)).argmin())
    last = len(raw) - length
    out = []
    for block in range((pick - last) // width, pick // width + 1):
        least, greatest = block * width, min(block * width + width - 1, most)
        low, high = max(0, pick - greatest), min(last, pick - least)
        place = (pick - high).to_bytes(4, "big") + (pick - low).to_bytes(4, "big")
        out.append((block, _digest(raw[pick - least : pick - greatest + length]), _digest(place + raw[low : high + length]), low, high))
    return out


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _hot_marks(held: DataFrame, length: int) -> DataFrame:
    """pick, context, runs of the contexts (pick, context, raw) of hot picks. Rows that repeat a context don't count: what stands
    under two different contexts repeats."""

    def cored(batches):
        for batch in batches:
            rows = [(p, c, *b) for p, c, r in zip(*(batch.column(k).to_pylist() for k in range(3))) for b in blocks(r, length)]
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(v), pa.int64()) for v in columns], ["pick", "context", "block", "core", "whole", "low", "high"])

    keys = ["pick", "block", "core"]
    parts = written(held.mapInArrow(cored, "pick long, context long, block long, core long, whole long, low long, high long"), "hot_blocks")
    # tables, so that the joins have a shuffle on either side and a large group's rows can be split
    groups = parts.groupBy(*keys).agg(F.min("context").alias("a"), F.max("context").alias("b"), F.min("whole").alias("c"), F.max("whole").alias("d"))
    groups = written(groups.where("a <> b").select(*keys, (F.col("c") == F.col("d")).alias("equal")), "hot_groups")
    shared = written(parts.join(groups, keys).select("pick", "context", "low", "high", "equal"), "hot_shared")
    dropped(parts)
    lists = shared.where("not equal").groupBy("pick", "context").agg(F.collect_set(F.struct("low", "high")).alias("wanted"))

    def windowed(batches):
        for batch in batches:
            pick, context, place, offset, said = [], [], [], [], []
            for p, c, raw, own in zip(*(batch.column(k).to_pylist() for k in range(4))):
                data = np.frombuffer(raw, np.uint8)
                at = int((gram_hashes(data[:length], GRAM) >> np.uint64(23)).argmin())
                h = gram_hashes(data, length).view(np.int64).tolist()
                for w in own:
                    for k in range(w["low"], w["high"] + 1):
                        pick.append(p)
                        context.append(c)
                        place.append(k)
                        offset.append(at - k)
                        said.append(h[k])
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (pick, context, place, offset, said)], ["pick", "context", "low", "offset", "window"])

    texts = held.join(lists.hint("shuffle_hash"), ["pick", "context"]).select("pick", "context", "raw", "wanted")
    single = written(texts.mapInArrow(windowed, "pick long, context long, low long, offset long, window long"), "hot_windows")
    keys = ["pick", "offset", "window"]
    again = single.groupBy(*keys).agg(F.min("context").alias("a"), F.max("context").alias("b")).where("a <> b").select(*keys)
    again = single.join(written(again, "hot_repeats"), keys, "left_semi").select("pick", "context", "low", F.col("low").alias("high"))
    every = shared.where("equal").select("pick", "context", "low", "high").unionByName(again)
    lists = every.groupBy("pick", "context").agg(F.collect_set(F.struct("low", "high")).alias("runs"))

    def joined(batches):
        for batch in batches:
            runs = [[{"low": a, "high": b} for a, b in _merged([(w["low"], w["high"]) for w in own])] for own in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))], ["pick", "context", "runs"])

    return lists.mapInArrow(joined, "pick long, context long, runs array<struct<low:bigint,high:bigint>>")


def _runs(mark: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))


def marks(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, hash (of its text), from_window and to_window: runs of windows that start elsewhere too."""
    keyed = _keyed(docs, key, text)
    kind = keyed.schema["doc"].dataType.simpleString()

    def scanned(batches):
        for batch in batches:
            doc, own = batch.column(0), batch.column(1)
            for low, data, at in slices(batch.column(2)):
                row, pick, first, last, offset = contexts(data, at, length)
                begin = (at[row] + first).tolist() if len(row) else []
                end = (at[row] + last + length).tolist() if len(row) else []
                raw = memoryview(np.ascontiguousarray(data))
                said = [hashlib.blake2b(raw[a:b], digest_size=8, key=o.to_bytes(2, "big")).digest() for a, b, o in zip(begin, end, offset.tolist())]
                take = pa.array(row + low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pick.view(np.int64)), pa.array(np.frombuffer(b"".join(said), np.int64)), doc.take(take), own.take(take), pa.array(first), pa.array(last)],
                    ["pick", "context", "doc", "hash", "first", "last"],
                )

    found = written(keyed.mapInArrow(scanned, f"pick long, context long, doc {kind}, hash long, first long, last long"), "contexts")
    # a table, so that the join has a shuffle on either side and a hot pick's rows can be split
    often = written(found.groupBy("pick").agg(F.count("*").alias("n")).where("n > 1").select("pick"), "picks")
    repeated = written(found.join(often, "pick", "left_semi"), "repeated_picks")
    dropped(found)
    stats = written(repeated.groupBy("pick", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc", "hash", "first", "last")).alias("at")), "context_counts")
    size = F.sum(F.col("at.last") - F.col("at.first") + length + 1)
    several = written(stats.groupBy("pick").agg(F.count("*").alias("k"), (size > SHARD).alias("hot")).where("k > 1").select("pick", "hot"), "several_picks")
    hot = not several.where("hot").isEmpty()
    wanted = stats.join(several, "pick").select("pick", "context", "hot", "at.*")
    lists = wanted.groupBy("doc", "hash").agg(F.collect_list(F.struct("pick", "context", "hot", "first", "last")).alias("wanted"))

    def cut(batches):
        for batch in batches:
            data, at = utf8(batch.column(0))
            pick, context, own_hot, raw = [], [], [], []
            for low, high, own in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(1).to_pylist()):
                for w in own:
                    pick.append(w["pick"])
                    context.append(w["context"])
                    own_hot.append(w["hot"])
                    raw.append(data[low + w["first"] : low + w["last"] + length].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(pick, pa.int64()), pa.array(context, pa.int64()), pa.array(own_hot, pa.bool_()), pa.array(raw, pa.binary())], ["pick", "context", "hot", "raw"])

    x, y = keyed.alias("x"), lists.hint("shuffle_hash").alias("y")
    held = x.join(y, F.col("x.doc").eqNullSafe(F.col("y.doc")) & (F.col("x.hash") == F.col("y.hash"))).select("x.text", "y.wanted")
    held = held.mapInArrow(cut, "pick long, context long, hot boolean, raw binary")
    if hot:
        held = written(held, "context_texts")
    cold = held.where("not hot").select("pick", "context", "raw").repartition("pick").sortWithinPartitions("pick", "context")

    def sorted_shards(batches):
        def said(rows):
            rows = [r for k, r in enumerate(rows) if not k or r[:2] != rows[k - 1][:2]]  # a repeated row sends its contexts again
            out = [(p, c, a, b) for (p, c, _), m in zip(rows, repeated_windows([r[2] for r in rows], length)) for a, b in _runs(m)] if rows else []
            columns = list(zip(*out)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(v), pa.int64()) for v in columns], ["pick", "context", "low", "high"])

        rows, size = [], 0
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if size >= SHARD and r[0] != rows[-1][0]:
                    yield said(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[2]) + 1
        yield said(rows)

    parts = cold.mapInArrow(sorted_shards, "pick long, context long, low long, high long")
    parts = written(parts.groupBy("pick", "context").agg(F.collect_list(F.struct("low", "high")).alias("runs")), "context_marks")
    if hot:
        parts = parts.unionByName(written(_hot_marks(held.where("hot").select("pick", "context", "raw"), length), "hot_marks"))
    whole = stats.where("n > 1").select("pick", "context", F.array(F.struct(F.lit(0).cast("long").alias("low"), F.lit(1 << 40).cast("long").alias("high"))).alias("runs"))
    rest = parts.join(whole, ["pick", "context"], "left_anti")
    known = whole.unionByName(rest)
    return repeated.join(known, ["pick", "context"]).select("doc", "hash", F.explode("runs").alias("r"), "first", "last").select("doc", "hash", (F.col("first") + F.col("r.low")).alias("from_window"), F.least(F.col("last"), F.col("first") + F.col("r.high")).alias("to_window"))


def deduplicated(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text", keep_bytes: bool = True) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row and, if asked for, kept (the remaining bytes)."""
    keyed = _keyed(docs, key, text)
    kind = keyed.schema["doc"].dataType.simpleString()
    # pre-aggregated: one list for each distinct document
    lists = marks(docs, length, key, text).groupBy("doc", "hash").agg(F.collect_set(F.struct("from_window", "to_window")).alias("marks"))
    x, y = keyed.alias("x"), lists.hint("shuffle_hash").alias("y")
    held = x.join(y, F.col("x.doc").eqNullSafe(F.col("y.doc")) & (F.col("x.hash") == F.col("y.hash")), "left").select("x.doc", "x.text", F.transform("y.marks", lambda m: m["from_window"]).alias("a"), F.transform("y.marks", lambda m: m["to_window"]).alias("b"))

    def cut(batches):
        for batch in batches:
            data, at = utf8(batch.column(1))
            out = []
            for low, high, first, last in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                spans: list[list[int]] = []
                for a, b in sorted(zip(first or (), last or ())):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b + length)
                    else:
                        spans.append([a, b + length])
                kept, place = [], 0
                for a, b in spans:
                    kept.append(data[low + place : low + a].tobytes())
                    place = b
                kept.append(data[low + place : high].tobytes())
                left = b"".join(kept)
                out.append((high - low, high - low - len(left), len(spans), hashlib.sha256(left).hexdigest()) + (left,) * keep_bytes)
            columns = list(zip(*out)) if out else [[]] * (4 + keep_bytes)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, kinds))], names)

    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes
    return held.mapInArrow(cut, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
