"""N-gram Jaccard self-join, size-aware: subsets of small sets, inverted lists of large ones; exact links, by components.

A document's set holds the 64-bit hashes of its distinct word shingles. Two sets r, s with |r| <= |s| can link only if
8 |s| <= 10 |r| and they share at least ceil(4 (|r| + |s|) / 9) elements (for 0.8).

 1. Equal sets are one class, which knows its least key and how many rows it has.
 2. Every element is counted over all rows. Rows are taken in chunks; a chunk sends each of its elements once (repeats as a
    number) to the bucket of its hash, packed, and gets the counts of those that occur elsewhere too. An element that occurs
    as often as its class has rows is the class's own: no other class has it.
 3. The order of elements: those of one class only first, then by count, then by hash. Sets that link share one of their first
    floor(0.2 |s|) + 1 elements in this (in any) order. Most sets are done here: those elements are all their own.
 4. Small sets (size at most the boundary) are found through subsets of the sizes that a link with another small set would
    need; two small sets that link have such a subset in common. Larger sets are found through inverted lists over the
    elements of step 3. The boundary is where, by the sizes of the sets and the measured lengths of their lists, subsets stop
    being cheaper than lists.
 5. Components first: in rounds, each set is checked exactly against the leader (another one each round) of one of its lists,
    where their components differ, and links join components. When few pairs of different components are left in the lists,
    or a round joins little, all those pairs are checked, outsiders against each list's main component and each other. A
    skipped pair lies in one component already, so no component loses a link, and a group of n near copies costs about n
    checks and not n squared.

Every step deals rows by hash of keys that are combined before (a hot element is one entry of each chunk), or by joins of plain
shuffles, which the engine can split. Broadcast are only keys and pairs whose number is checked against FEW.

Cases: null and empty texts and texts without words have an empty set, and are linked with nothing; fewer words than a
shingle are one shingle; repeated rows are copies of one class; keys may be null (the least key of a component is that of its
rows with a key, null where none has one), may repeat, and be of any type that has an order; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import combinations, count
from math import ceil, comb, log, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import batches_of, byte_classes, collected, dropped, lean, mixed, shingle_hashes, slices, weights, written

#: White space separates words; A-Z is lower-cased.
CLASSES = byte_classes(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Elements of a chunk, and of a bucket on average.
CHUNK, BUCKET = 1 << 20, 1 << 19
#: Rows of a chunk: their numbers in it take two bytes.
MOST_ROWS = 65_000
#: A set of more elements has a million and more of the subsets that a link needs, so no boundary can lie beyond.
WHOLE = 32
#: The bound of what is broadcast, in rows of at most 40 bytes.
FEW = 500_000
#: Groups of the sets that are checked against one copy of their partner's set, and pairs for each further group.
PARTS, MEMBERS = 16, 4096
#: The bound of what is broadcast with sketches (160 bytes each).
FEW_SKETCHES = 65_536
#: Leaders that a set is checked against in a round, and how many times more leaders a list has in the next round.
LIKELY, GROWTH = 4, 16
#: 64-bit words of a set's sketch.
WORDS = 16


def least_overlap(m: int, n: int, percent: int) -> int:
    return -(-percent * (m + n) // (100 + percent))


def subset_sizes(n: int, boundary: int, percent: int) -> list[int]:
    """The sizes of the common subsets that a set of n needs for any partner of at most `boundary` elements."""
    fits = (m for m in range(1, boundary + 1) if 100 * min(m, n) >= percent * max(m, n))
    return sorted({o for m in fits if (o := least_overlap(m, n, percent)) <= min(m, n)})


def prefix_size(n, percent: int):
    """How many first elements a link can't do without."""
    return n - -(-percent * n // 100) + 1


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """values[cuts[k]:cuts[k + 1]] as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


#: What a chunk sends: rows of a bucket (ids that occur once in the chunk with the row's number, others with how often), and one row of itself.
BUCKET_ROW = ["bucket int", "chunk long", "low binary", "row binary", "many binary", "times binary"]
CHUNK_ROW = ["parts int", "n binary", "class binary", "many_id binary", "many_row binary", "whole binary"]


def _dealt(docs: DataFrame, key: str, text: str, size: int, bits: int) -> DataFrame:
    kind = docs.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.list_(to_arrow_type(kind))
    names = [x.split()[0] for x in [*BUCKET_ROW, *CHUNK_ROW]] + ["keys"]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.int32(), *[pa.binary()] * 5, arrow]

    def row(**given):
        n = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([given[x] if x in given else pa.nulls(n, t) for x, t in zip(names, kinds)], names)

    def dealt(batches):
        from pyspark import TaskContext

        chunk, keys, sets, total = TaskContext.get().partitionId() << 24, [], [], 0

        def sent():
            n = np.array([len(s) for s in sets], np.int32)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            times = Counter(digest)
            first = {d: k for k, d in reversed(list(enumerate(digest)))}
            own = [k for k, d in enumerate(digest) if first[d] == k and len(sets[k])]
            ids = np.concatenate([sets[k] for k in own] or [np.zeros(0, np.uint64)]) >> np.uint64(32 - bits)
            rows = np.repeat(np.array(own, np.uint16), n[own])
            weight = np.repeat(np.array([times[digest[k]] for k in own], np.int64), n[own])
            order = np.argsort(ids)
            ids, rows, weight = ids[order], rows[order], weight[order]
            begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
            count = np.add.reduceat(weight, begin) if len(begin) else weight
            one = count == 1
            several = np.repeat(~one, np.diff(np.append(begin, len(ids))))
            edges = np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32)
            x, y = ids[begin[one]], ids[begin[~one]]
            cut_x, cut_y = np.searchsorted(x, edges), np.searchsorted(y, edges)
            full = np.flatnonzero((np.diff(cut_x) > 0) | (np.diff(cut_y) > 0))

            def packed(values, cuts):
                return _packed(values, np.append(cuts[full], cuts[-1]))

            yield row(bucket=pa.array(full, pa.int32()), chunk=pa.array(np.full(len(full), chunk)), low=packed(x.astype("<u4"), cut_x), row=packed(rows[begin[one]].astype("<u2"), cut_x), many=packed(y.astype("<u4"), cut_y), times=packed(count[~one].astype("<u4"), cut_y))
            small = [sets[k].astype("<u8").tobytes() for k in range(len(sets)) if 0 < len(sets[k]) <= WHOLE]
            said = {"n": n.astype("<i4").tobytes(), "class": b"".join(digest), "many_id": ids[several].astype("<u8").tobytes(), "many_row": rows[several].astype("<u2").tobytes(), "whole": b"".join(small)}
            yield row(bucket=pa.array([chunk % (1 << bits)], pa.int32()), chunk=pa.array([chunk]), parts=pa.array([len(full)], pa.int32()), keys=pa.array([keys], arrow), **{k: pa.array([v], pa.binary()) for k, v in said.items()})

        for batch in batches:
            its = batch.column(0).to_pylist()
            for low, data, at in slices(batch.column(1)):
                for k, own in enumerate(shingle_hashes(data, at, CLASSES, size), low):
                    keys.append(its[k])
                    sets.append(own)
                    total += len(own)
                    if total >= CHUNK or len(sets) >= MOST_ROWS:
                        yield from sent()
                        chunk, keys, sets, total = chunk + 1, [], [], 0
        if sets:
            yield from sent()

    said = ", ".join([*BUCKET_ROW, *CHUNK_ROW, f"keys array<{kind.simpleString()}>"])
    return docs.select(key, text).mapInArrow(lean(dealt), said)


def _answered(sent: DataFrame, keys: str) -> DataFrame:
    """For each row of a bucket: the ids that occur more than once, with how often. Rows of chunks go through, with bucket -1."""
    own = ["parts int", "n binary", "class binary", "many_id binary", "many_row binary", "whole binary"]
    names = ["bucket", "chunk", "low", "row", "count", "many_count"]

    def answered(batches):
        held, bucket = [], None

        def said():
            single = [np.frombuffer(r["low"], "<u4") for r in held]
            many = [np.frombuffer(r["many"], "<u4") for r in held]
            low = np.concatenate([*single, *many])
            times = np.concatenate([np.ones(sum(map(len, single)), np.int64), *(np.frombuffer(r["times"], "<u4").astype(np.int64) for r in held)])
            order = np.argsort(low)
            begin = np.flatnonzero(np.concatenate([[True], np.diff(low[order]) != 0]))
            total = np.add.reduceat(times[order], begin)
            count = np.empty(len(low), np.int64)
            count[order] = np.repeat(total, np.diff(np.append(begin, len(low))))
            place, columns = 0, [[], [], [], []]
            above = sum(map(len, single))
            for r, x, y in zip(held, single, many):
                its = count[place : place + len(x)]
                place += len(x)
                keep = its > 1
                values = (x[keep], np.frombuffer(r["row"], "<u2")[keep], its[keep].astype("<u4"), count[above : above + len(y)].astype("<u4"))
                above += len(y)
                for c, v in zip(columns, values):
                    c.append(v.tobytes())
            given = [pa.array([bucket] * len(held), pa.int32()), pa.array([r["chunk"] for r in held], pa.int64()), *(pa.array(c, pa.binary()) for c in columns)]
            n = len(held)
            return pa.RecordBatch.from_arrays([*given, *(pa.nulls(n, t) for t in rest_kinds)], [*names, *rest])

        rest, rest_kinds = [], []
        for batch in batches:
            rest = batch.schema.names[6:]
            rest_kinds = [batch.schema.field(x).type for x in rest]
            through = batch.column("parts").is_valid()
            if through.true_count:
                some = batch.filter(through)
                n = some.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([-1] * n, pa.int32()), some.column("chunk"), *[pa.nulls(n, pa.binary())] * 4, *(some.column(x) for x in rest)], [*names, *rest])
            some = batch.filter(pc.invert(through)).select(["bucket", "chunk", "low", "row", "many", "times"])
            for k in range(some.num_rows):
                r = {x: some.column(x)[k].as_py() for x in some.schema.names}
                if r["bucket"] != bucket:
                    if held:
                        yield said()
                    held, bucket = [], r["bucket"]
                held.append(r)
        if held:
            yield said()

    said = ", ".join(["bucket int", "chunk long", "low binary", "row binary", "count binary", "many_count binary", *own, f"keys {keys}"])
    return sent.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(lean(answered), said)


def _described(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """doc (the key), n, class; for the first row of its class in a chunk, `shared`, where a link is possible: the ids that occur more
    than once with their counts, in order; `whole`: the elements of small sets."""
    length = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = max(8, ceil(log2(max(1, length / 6 / BUCKET))))
    kind = docs.schema[key].dataType.simpleString()
    answers = _answered(_dealt(docs, key, text, size, bits), f"array<{kind}>")

    def finished(batches):
        at, parts = None, []

        def said():
            if any(p["chunk"] != at["chunk"] for p in parts) or len(parts) != at["parts"]:
                raise ValueError("a chunk's answers are not complete: its input came in another order when it was read again")
            n, raw = np.frombuffer(at["n"], "<i4").astype(np.int64), at["class"]
            digest = [raw[k : k + 16] for k in range(0, len(raw), 16)]
            many, many_row = np.frombuffer(at["many_id"], "<u8"), np.frombuffer(at["many_row"], "<u2")
            ids = [many, *((np.frombuffer(p["low"], "<u4").astype(np.uint64) | (np.uint64(p["bucket"]) << np.uint64(32))) for p in parts)]
            rows = [many_row, *(np.frombuffer(p["row"], "<u2") for p in parts)]
            own = np.concatenate([np.frombuffer(p["many_count"], "<u4") for p in parts] or [np.zeros(0, np.uint32)])
            counts = [own[np.searchsorted(np.unique(many), many)], *(np.frombuffer(p["count"], "<u4") for p in parts)]
            ids, rows, counts = np.concatenate(ids), np.concatenate(rows), np.concatenate(counts)
            order = np.lexsort((ids, counts, rows))
            ids, rows, counts = ids[order], rows[order], counts[order]
            shared = np.bincount(rows, minlength=len(n))
            is_open = (shared > 0) & (n - shared < prefix_size(n, percent))
            keep = is_open[rows]
            end = np.concatenate([[0], np.cumsum(np.where(is_open, shared, 0))]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(counts[keep].astype(np.int64)), pa.array(ids[keep].view(np.int64))], ["count", "id"])
            small = (n > 0) & (n <= WHOLE)
            whole_end = np.concatenate([[0], np.cumsum(np.where(small, n, 0))]).astype(np.int32)
            whole = pa.ListArray.from_arrays(pa.array(whole_end), pa.array(np.frombuffer(at["whole"], "<i8")), mask=pa.array(~small))
            return pa.RecordBatch.from_arrays([pa.array(at["keys"], key_type), pa.array(n), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(end), pairs, mask=pa.array(~is_open)), whole], ["doc", "n", "class", "shared", "whole"])

        key_type = None
        for batch in batches:
            key_type = batch.schema.field("keys").type.value_type
            for k in range(batch.num_rows):
                r = {x: batch.column(x)[k].as_py() for x in batch.schema.names}
                if r["bucket"] < 0:
                    if at is not None:
                        yield said()
                    at, parts = r, []
                else:
                    parts.append(r)
        if at is not None:
            yield said()

    dealt = answers.repartition("chunk").sortWithinPartitions("chunk", "bucket")
    return written(dealt.mapInArrow(lean(finished), f"doc {kind}, n long, class binary, shared array<struct<count:bigint,id:bigint>>, whole array<bigint>"), "described")


def boundary(sets: dict[int, int], list_cost: dict[int, float], percent: int) -> int:
    """The size up to which subsets cost less than lists. sets: how many sets there are of each size up to WHOLE; list_cost: the rows that
    sets of a size meet in their lists."""

    def cost(x: int) -> float:
        total = 0.0
        for n, k in sets.items():
            if n <= x:
                total += k * sum(comb(n, o) for o in subset_sizes(n, x, percent))
            if n * 100 > x * percent:
                total += list_cost.get(n, 0)
        return total

    return min(range(WHOLE + 1), key=lambda x: (cost(x), x))


def _subset_keys(small: DataFrame, most: int, percent: int) -> DataFrame:
    """element (a subset's hash), n, class and place -1 of small sets."""

    def keyed(batches):
        for batch in batches:
            element, rows = [], []
            for k, (n, own) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                own = np.sort(np.array(own, np.int64).view(np.uint64))
                for o in subset_sizes(n, most, percent):
                    every = np.array(list(combinations(own.tolist(), o)), np.uint64)
                    element.append(mixed((every * weights(o, 71)).sum(axis=1, dtype=np.uint64) + np.uint64(o)).view(np.int64))
                    rows += [k] * len(every)
            take = pa.array(rows, pa.int64())
            element = np.concatenate(element) if element else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(element), batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(rows), -1))], ["element", "n", "class", "place"])

    return small.select("n", "class", "whole").mapInArrow(lean(keyed), "element long, n long, class binary, place long")


def may_link(na: Column, xa: Column, nb: Column, xb: Column, percent: int) -> Column:
    """Whether sets may link whose first common element stands at these places (from 0; -1 where subsets met): what can be common is that
    element and what follows it in either order. A pair that links passes at its first common element, so failing at others loses nothing."""
    sizes = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return sizes & ((xa < 0) | ((100 + percent) * F.least(na - xa, nb - xb) >= percent * (na + nb)))


def _few(df: DataFrame) -> DataFrame:
    """A written table, broadcast where it has at most FEW rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """class, n, elements (raw) and sketch of the wanted classes (class, doc), from each text of a wanted key whose set is of the class, once.
    A sketch has a bit for each value that an element's hash may have modulo its length."""
    keys = wanted.select(F.col("doc").alias("its")).distinct()
    own = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).join(_few(keys), F.col("doc").eqNullSafe(F.col("its")), "left_semi")

    def sent(batches):
        for batch in batches:
            for _, data, at in slices(batch.column(0), 1 << 19):
                sets = [s for s in shingle_hashes(data, at, CLASSES, size) if len(s)]
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                bit = np.zeros((len(sets), 64 * WORDS), np.uint8)
                for k, s in enumerate(sets):
                    bit[k, s % np.uint64(64 * WORDS)] = 1
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * WORDS), pa.array(np.packbits(bit).view(np.int64)))
                columns = [pa.array(digest, pa.binary()), pa.array(list(map(len, sets)), pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()), sketch]
                yield pa.RecordBatch.from_arrays(columns, ["class", "n", "raw", "sketch"])

    made = own.select("text").mapInArrow(lean(sent), "class binary, n long, raw binary, sketch array<long>")
    return written(made.join(_few(wanted.select("class")), "class", "left_semi").dropDuplicates(["class"]), "sets")


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may link by their sketches, with the bound (in percent). Each bit that only one of both has stands for an
    element that the other one lacks, so what is common is at most the rest."""
    few = sets.count() <= FEW_SKETCHES
    own = [sets.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab"]
    own = [F.broadcast(x) if few else x for x in own]
    both = pairs.join(own[0], "a").join(own[1], "b")
    lacks = [sum(F.bit_count(F.col(x)[k].bitwiseAND(F.bitwise_not(F.col(y)[k]))) for k in range(WORDS)) for x, y in (("sa", "sb"), ("sb", "sa"))]
    both = both.withColumn("common", F.least(F.col("na") - lacks[0], F.col("nb") - lacks[1])).where((100 + percent) * F.col("common") >= percent * (F.col("na") + F.col("nb")))
    return both.select("a", "b", (100 * F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("most"))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: b's sets go to groups of their a, with one copy of a's set for each group. There are more groups for an
    a where there are more pairs, so that one that very many are checked against fills no task."""
    many = pairs.count()
    grouped = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(PARTS + many // MEMBERS)).alias("part"), "b")
    role = grouped.unionByName(grouped.select("a", "part", F.lit(None).cast("binary").alias("b")).distinct())
    roles = role.withColumn("class", F.coalesce("b", "a"))
    moved = sets.select("class", "raw").join(F.broadcast(roles) if 2 * many <= FEW else roles, "class").select("a", "part", "b", "raw")

    def held(batches):
        at, its = None, None
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                a, part, b, raw = (batch.column(c)[k].as_py() for c in range(4))
                own = np.frombuffer(raw, "<u8")
                if b is None:
                    at, its = (a, part), own
                    continue
                if at != (a, part):
                    raise ValueError("a set that others are to be checked against is missing")
                common = len(np.intersect1d(its, own, assume_unique=True))
                if 100 * common >= percent * (len(its) + len(own) - common):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    moved = moved.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return written(moved.mapInArrow(lean(held), "a binary, b binary"), "links")


def _merged(found: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """class and component after more links, and how many components have joined others: only links between components are followed."""
    known = _few(found)
    ends = links.join(known.select(F.col("class").alias("a"), F.col("component").alias("x")), "a").join(known.select(F.col("class").alias("b"), F.col("component").alias("y")), "b")
    up = connected_components(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    up = written(up.where("node <> component").select(F.col("node").alias("component"), F.col("component").alias("up")), "joined")
    return written(found.join(_few(up), "component", "left").select("class", F.coalesce("up", "component").alias("component")), "components"), up.count()


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles and component_id (the least key that links of at least percent / 100 reach) of every row."""
    with batches_of(docs.sparkSession, 2000):
        described = _described(docs, key, text, size, percent)
    collected(docs.sparkSession)
    grouped = described.where("n > 0").groupBy("class").agg(F.min("doc").alias("doc"), F.count("*").alias("rows"), F.max("n").alias("n"), F.first("shared", True).alias("shared"), F.first("whole", True).alias("whole"))
    grouped = grouped.withColumn("shared", F.filter("shared", lambda x: x["count"] > F.col("rows"))).withColumn("own", F.col("n") - F.size("shared"))
    need = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    classes = written(grouped.withColumn("shared", F.slice("shared", 1, F.greatest(F.lit(0), need - F.col("own")).cast("int"))), "classes")
    entries = classes.select("class", "n", "own", F.posexplode("shared").alias("k", "x")).select(F.col("x.id").alias("element"), "n", "class", (F.col("own") + F.col("k")).alias("place"))
    held = written(entries, "entries")

    def several(entries: DataFrame) -> DataFrame:
        """The entries whose list holds at least two sets, with its length."""
        lists = written(entries.groupBy("element").agg(F.count("*").alias("length")).where("length > 1"), "lists")
        return entries.join(lists, "element")

    lists = written(several(held), "entries")
    small = classes.where(F.col("n") <= WHOLE)
    cost = {r.n: r.c for r in lists.where(F.col("n") <= WHOLE).groupBy("n").agg(F.sum("length").alias("c")).collect()}
    most = boundary({r.n: r.c for r in small.groupBy("n").agg(F.count("*").alias("c")).collect()}, cost, percent)
    if most:
        subsets = several(_subset_keys(small.where(F.col("n") <= most), most, percent))
        lists = written(lists.where(F.col("n") * 100 > most * percent).unionByName(subsets), "entries")
    dropped(held)
    first = written(lists.select("class").distinct(), "open_classes")
    wanted = written(classes.select("class", "doc").join(first, "class", "left_semi"), "wanted")
    found = wanted.select("class", F.col("class").alias("component"))
    if not wanted.isEmpty():
        with batches_of(docs.sparkSession, 2000):
            sets = _sets(docs, wanted, key, text, size)
        found = _components(lists, written(found, "components"), sets, percent)
    least = classes.select("class", "doc").join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = written(least, "class_components")
    ids = written(least.groupBy("component").agg(F.min("doc").alias("component_id")), "component_ids")
    labels = written(least.join(ids, "component").select("class", "component_id"), "labels")
    out = described.select("doc", "n", "class").join(labels, "class", "left")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))


def _components(lists: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """class and component of all sets of the lists."""
    longest = lists.agg(F.max("length")).first()[0]
    lists, poor = lists.drop("length"), False
    for k in count():
        now = lists.join(_few(found), "class").select("element", "n", "class", "place", "component")
        main = now.groupBy("element", "component").agg(F.count("*").alias("c")).groupBy("element").agg(F.max(F.struct("c", "component")).alias("main"), F.count("*").alias("k"))
        # lists of one component are done for good
        lists = written(now.join(main.where("k > 1").select("element", F.col("main.component").alias("main")), "element"), "mixed_lists")
        if not lists.count():
            return found
        outside = lists.where("component <> main")
        if poor or GROWTH**k > longest:
            return _merged(found, _linked(_crossing(lists, outside, sets, percent), sets, percent))[0]
        pairs = _to_leaders(lists, outside, sets, k, GROWTH**k, percent)
        found, joined = _merged(found, _linked(pairs, sets, percent))
        poor = 20 * LIKELY * joined < pairs.count()
        lists = lists.select("element", "n", "class", "place")
        collected(found.sparkSession)


def _to_leaders(lists: DataFrame, outside: DataFrame, sets: DataFrame, k: int, leaders: int, percent: int) -> DataFrame:
    """For each outsider the likeliest LIKELY of its lists' leaders in other components. A list has up to `leaders` of them for each band of
    sizes, others in each round; bands move, so that no group of near copies is cut by them again and again."""
    band = F.floor(F.log(F.col("n").cast("double")) / log(100 / percent) + k * 0.382)
    prior = F.xxhash64("class", F.lit(k))
    lead = lists.groupBy("element", band.alias("band"), F.pmod(prior, F.lit(leaders)).alias("part")).agg(F.min(F.struct(prior.alias("prior"), "class", "n", "place", "component")).alias("lead"))
    met = outside.withColumn("band", band).join(lead, ["element", "band"]).where(F.col("component") != F.col("lead.component"))
    met = met.where(may_link(F.col("n"), F.col("place"), F.col("lead.n"), F.col("lead.place"), percent))
    pairs = written(met.select(F.col("lead.class").alias("a"), F.col("class").alias("b")).distinct(), "met")
    best = _likely(pairs, sets, percent).groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("most", "a")), False), 1, LIKELY).alias("best"))
    return written(best.select(F.explode("best.a").alias("a"), "b"), "pairs")


def _crossing(lists: DataFrame, outside: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of one list and different components that the bounds allow: outsiders against the main component and each other."""
    x, y = outside.alias("x"), lists.alias("y")
    fits = (F.col("x.element") == F.col("y.element")) & (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.class") < F.col("y.class")))
    fits &= may_link(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place"), percent)
    pairs = x.join(y, fits).select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b"))
    pairs = written(pairs.distinct(), "crossing")
    return written(_likely(pairs, sets, percent).select("a", "b"), "pairs")
