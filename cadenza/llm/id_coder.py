"""Token ids in context-mixing range-coded blocks.

A file is a Parquet file of segment rows. A segment holds whole documents in ascending key order: their keys and token counts,
and the ids (two bytes each, uncoded) in blocks of BLOCK ids. Each block starts from fresh models, and has its own byte range
and a CRC-32 of its bytes and one of its ids, so that a block is read, checked and retried by itself, with the segment's counts.

A block's ids are predicted by the ids that followed the last two ids (order 2) and the last one (order 1) before, and by the
segment's most frequent id where neither was seen (order 0). The likelier one is the prediction; whether it is right is coded
with a probability that mixes what both orders' counts have meant so far, with weights that move to the better one. Ids that
were not predicted are coded by their share of the segment's ids (order 0), whose counts stand before the blocks. A carry-less
range coder of 64 bits writes 32-bit words. All arithmetic is on integers, so any machine decodes what another has written.

All blocks of a segment are coded in lock-step: a lane is a block, a step is an id, and both orders go through one array.

Cases: a null or empty text is the end id alone; special strings become their ids, as the library does it by default; repeated
keys stand next to each other; null keys come first; texts of any length stay whole (a longer one makes a longer segment); an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import texts, written

BLOCK, SEGMENT = 2048, 1 << 23
SLOT_BITS = 9
SLOTS = 1 << SLOT_BITS
ONE, EDGE = 1 << 15, 48  # the total of a flag's probabilities, and the least one
SHARES = 18  # bits of the total of all shares of ids
WORD = np.uint64(32)
MASK = np.uint64((1 << 32) - 1)
#: What a count becomes, by itself, if its id was wrong (0 to 7) or right (8 to 15); a wrong id that was right once at most is replaced.
STEP = np.array([0, 0, *((k >> 1) - k for k in range(2, 8)), *(1,) * 7, 0], np.int32)


class Shares:
    """Order 0: each id's share of a segment, of 2 ** SHARES in all; without counts all ids below 65536 have the same."""

    def __init__(self, ids: np.ndarray, share: np.ndarray):
        self.ids, self.share = ids, share
        self.size, self.begin = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
        self.size[ids] = share
        self.begin[ids] = np.cumsum(share) - share
        self.owner = np.repeat(ids.astype(np.uint16), share)
        self.top = int(ids[np.argmax(share)])

    @classmethod
    def counted(cls, stream: np.ndarray) -> Shares:
        count = np.bincount(stream, minlength=1)
        ids = np.flatnonzero(count)
        count = count[ids]
        share = 1 + count * ((1 << SHARES) - len(ids)) // max(1, int(count.sum()))
        share[np.argmax(share)] += (1 << SHARES) - int(share.sum())
        return cls(ids, share)

    @classmethod
    def equal(cls) -> Shares:
        return cls(np.arange(1 << 16), np.full(1 << 16, 1 << SHARES - 16))

    def stored(self) -> bytes:
        return zlib.compress(np.diff(self.ids, prepend=0).astype("<u2").tobytes() + self.share.astype("<u4").tobytes(), 3)

    @classmethod
    def restored(cls, data: bytes) -> Shares:
        data = zlib.decompress(data)
        n = len(data) // 6
        return cls(np.cumsum(np.frombuffer(data, "<u2", n), dtype=np.int64), np.frombuffer(data, "<u4", n, 2 * n).astype(np.int64))


class Models:
    """The models of n blocks, side by side; order 1 in the first row, order 2 in the second."""

    def __init__(self, n: int, top: int):
        self.lane = np.arange(2 * n).reshape(2, n) * SLOTS
        self.table = np.full(2 * n * SLOTS, top << 3, np.int32)  # an id and its count of 3 bits
        self.seen = np.arange(2 * n).reshape(2, n) * 16
        self.chance = np.full(2 * n * 16, ONE // 2, np.int32)
        self.chance[::16] = self.chance[8::16] = ONE // 16
        self.weight = np.full(n, 128, np.int32)
        self.hashed = np.zeros((2, n), np.uint16)
        self.last = np.zeros(n, np.uint16)

    def predict(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The predicted id of the first k lanes and its probability."""
        self.at = at = self.lane[:, :k] + (self.hashed[:, :k] >> 16 - SLOT_BITS)
        self.found = found = self.table.take(at)
        self.ids = ids = found >> 3
        self.count = count = found & 7
        guess = ids[0].copy()
        np.copyto(guess, ids[1], where=count[1] > 0)
        s = (ids == guess).astype(np.int32)
        s <<= 3
        s += count
        self.s = s = s + self.seen[:, :k]
        self.q = q = self.chance.take(s)
        p = q[1] - q[0]
        p *= self.weight[:k]
        p >>= 8
        p += q[0]
        return guess, p

    def learn(self, k: int, hit: np.ndarray, actual: np.ndarray) -> None:
        q = self.q
        w = self.weight[:k]
        to = (q[1] > q[0]) == hit
        to = to.astype(np.int32)
        to <<= 8
        to -= w
        to >>= 5
        w += to
        d = hit * np.int32(ONE - 2 * EDGE)
        d += EDGE
        d = d - q
        d >>= 4
        d += q
        self.chance[self.s] = d
        right = self.ids == actual
        step = right.astype(np.int32)
        step <<= 3
        step += self.count
        new = STEP.take(step)
        new += self.found
        fresh = actual << 3
        fresh += 1
        np.copyto(new, fresh, where=(step < 2))
        self.table[self.at] = new
        h, last = self.hashed[:, :k], self.last[:k]
        np.multiply(last, np.uint16(0x85EB), out=h[1])
        last[:] = actual
        np.multiply(last, np.uint16(0x9E37), out=h[0])
        h[1] += h[0]


def _cut(lo: np.ndarray, sp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of less than 32 bits, cut where their first words differ and moved up by a word."""
    differ = ((lo ^ (lo + sp - np.uint64(1))) >> WORD) != 0
    return lo << WORD, np.where(differ, MASK + np.uint64(1) - (lo & MASK), sp) << WORD


def _lanes(length: np.ndarray) -> list[int]:
    """How many blocks, the longest first, have an id at each step."""
    return np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right").tolist()


def encode_blocks(blocks: list[np.ndarray], shares: Shares | None = None) -> list[bytes]:
    """Blocks of ids below 65536, the longest first, as independent byte strings."""
    n = len(blocks)
    if not n:
        return []
    shares = shares or Shares.equal()
    length = np.array([len(b) for b in blocks])
    even = int((length == length[0]).sum())
    grid = np.zeros((int(length[0]), n), np.int32)
    grid[:, :even] = np.concatenate(blocks[:even]).reshape(even, -1).T
    for j in range(even, n):
        grid[: length[j], j] = blocks[j]
    m = Models(n, shares.top)
    low, span = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    lanes, words = [], []
    for step, k in enumerate(_lanes(length)):
        actual = grid[step, :k]
        guess, p = m.predict(k)
        hit = guess == actual
        lo, sp = low[:k], span[:k]
        bound = sp >> np.uint64(15)
        bound *= p.astype(np.uint64)
        part = sp - bound
        part >>= np.uint64(SHARES)
        begin = shares.begin.take(actual)
        begin *= part
        begin += bound
        begin[hit] = 0
        lo += begin
        part *= shares.size.take(actual)
        np.copyto(part, bound, where=hit)
        sp[:] = part
        at = np.flatnonzero(part <= MASK)
        if len(at):
            a = lo.take(at)
            lanes.append(at)
            words.append((a >> WORD).astype("<u4"))
            lo[at], sp[at] = _cut(a, part.take(at))
        m.learn(k, hit, actual)
    every = np.arange(n)
    lane = np.concatenate([*lanes, every, every]).astype(np.uint16 if n <= 1 << 16 else np.int64)
    word = np.concatenate([*words, (low >> WORD).astype("<u4"), (low & MASK).astype("<u4")])
    data, end = word[np.argsort(lane, kind="stable")].tobytes(), np.cumsum(np.bincount(lane, minlength=n)) * 4
    return [data[a:b] for a, b in zip([0, *end[:-1].tolist()], end.tolist())]


def decode_blocks(parts: list[bytes], length: list[int], shares: Shares | None = None) -> list[np.ndarray]:
    """What encode_blocks() was given; length: ids of each block, the longest first."""
    n = len(parts)
    if not n:
        return []
    shares = shares or Shares.equal()
    grid = np.zeros((length[0], n), np.int32)
    width = np.array([len(p) // 4 + 2 for p in parts])
    end = np.cumsum(width)
    place = end - width
    words = np.zeros(int(end[-1]), np.uint64)
    for p, at in zip(parts, place.tolist()):
        words[at : at + len(p) // 4] = np.frombuffer(p, "<u4", len(p) // 4)
    m = Models(n, shares.top)
    low, span = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    code = (words[place] << WORD) | words[place + 1]  # less low
    place += 2
    end -= 1
    for step, k in enumerate(_lanes(np.array(length))):
        guess, p = m.predict(k)
        lo, sp, x = low[:k], span[:k], code[:k]
        bound = sp >> np.uint64(15)
        bound *= p.astype(np.uint64)
        hit = x < bound
        actual = guess
        miss = np.flatnonzero(~hit)
        cut = bound.take(miss)
        part = sp.take(miss)
        part -= cut
        part >>= np.uint64(SHARES)
        rest = x.take(miss)
        own = shares.owner.take(((rest - cut) // part).view(np.int64), mode="clip").astype(np.int64)
        cut += shares.begin.take(own) * part
        part *= shares.size.take(own)
        actual[miss] = own
        lo[miss] += cut
        x[miss] = rest - cut
        bound[miss] = part
        sp[:] = bound
        at = np.flatnonzero(bound <= MASK)
        if len(at):
            to = place.take(at)
            x[at] = (x.take(at) << WORD) | words.take(np.minimum(to, end.take(at)))
            place[at] = to + 1
            lo[at], sp[at] = _cut(lo.take(at), bound.take(at))
        grid[step, :k] = actual
        m.learn(k, hit, actual)
    return [grid[:c, j] for j, c in enumerate(length)]


class Encoder:
    """Ids of whole texts as the tokenizer file gives them. Pre-tokens of texts without special strings are looked up in a bounded cache,
    which keeps a pre-token's ids as bytes of 32-bit numbers; the library's model gives those that are not there."""

    CACHE = 500_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            said = json.load(f)
        pre, model = said.get("pre_tokenizer") or {}, said["model"]
        # cutting at pre-tokens is the library's own rule for this kind; anything else is encoded text by text
        self.cut = None
        if said.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout"):
            import public_tokenizers

            from .byte_bpe import splitter

            self.cut, self.model = splitter(public_tokenizers.PATTERN), self.library.model
        special = [re.escape(x["content"]) for x in said.get("added_tokens", [])]
        self.special = re.compile("|".join(special)).search if special else lambda t: None
        # a byte-level model's letter for each byte: printable ones stand for themselves
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        self.letters = {k: k if k in shown else next(hidden) for k in range(256)}
        self.old: dict[str, bytes] = {}
        self._renew()

    def _renew(self) -> None:
        from .byte_bpe import _Pieces

        self.young = _Pieces()
        self.young.code = self._piece

    def _piece(self, part: str) -> bytes:
        found = self.old.get(part)
        if found is None:
            plain = part.isascii() and part.isprintable()
            shown = part.replace(" ", "\u0120") if plain else part.encode().decode("latin-1").translate(self.letters)
            found = array("i", [x.id for x in self.model.tokenize(shown)]).tobytes()
        if len(part) <= 200:
            if len(self.young) >= self.CACHE // 2:
                self.old = self.young
                self._renew()
            self.young[part] = found
        return found

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if self.cut is None or self.special(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
        return np.frombuffer(b"".join(map(self.young.__getitem__, self.cut(text))), np.int32)

    def encode(self, some: list[str]) -> list[list[int]]:
        return [self.ids(t).tolist() for t in some]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _segment(ids: list[np.ndarray]) -> dict:
    stream = np.concatenate(ids)
    if len(stream) and not 0 <= int(stream.min()) <= int(stream.max()) < 1 << 16:
        raise ValueError(f"ids are coded in 16 bits; there is one from {stream.min()} to {stream.max()}")
    blocks = [stream[k : k + BLOCK] for k in range(0, len(stream), BLOCK)]
    shares = Shares.counted(stream)
    coded = encode_blocks(blocks, shares)
    stored = shares.stored()
    return {
        "n_tokens": [len(x) for x in ids],
        "block_bytes": [len(c) for c in coded],
        "block_crc": [zlib.crc32(c) for c in coded],
        "ids_crc": [zlib.crc32(b.astype("<u2").tobytes()) for b in blocks],
        "data": b"".join(coded),
        "shares": stored,
        "shares_crc": zlib.crc32(stored),
    }


FIELDS = ["n_tokens array<long>", "block_bytes array<long>", "block_crc array<long>", "ids_crc array<long>", "data binary", "shares binary", "shares_crc long"]


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The segments of all documents, written to the shared folder: part, base (ids before the segment in its part), keys and FIELDS."""
    kind = docs.schema[key].dataType
    parts = docs.select(key, text).repartitionByRange(F.col(key), F.xxhash64(text)).sortWithinPartitions(F.col(key), F.xxhash64(text))

    def coded(batches):
        from pyspark import TaskContext

        part, base, keys, ids, held = TaskContext.get().partitionId(), 0, [], [], 0
        own, end = encoder(tokenizer), np.array([end_id], np.int32)

        def row():
            s = _segment(ids)
            values = [part, base, keys, *s.values()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, arrow)], names)

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                for k, t in zip(some.column(0).to_pylist(), texts(some.column(1))):
                    keys.append(k)
                    ids.append(np.concatenate((own.ids(t), end)))
                    held += len(ids[-1])
                    if held >= SEGMENT:
                        yield row()
                        base, keys, ids, held = base + held, [], [], 0
        if ids:
            yield row()

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("base", T.LongType()), T.StructField("keys", T.ArrayType(kind))])
    said = ", ".join([f"part int, base long, keys array<{kind.simpleString()}>", *FIELDS])
    from pyspark.sql.pandas.types import to_arrow_type

    long = pa.list_(pa.int64())
    arrow = [pa.int32(), pa.int64(), to_arrow_type(schema["keys"].dataType), long, long, long, long, pa.binary(), pa.binary(), pa.int64()]
    names = ["part", "base", "keys", *(f.split()[0] for f in FIELDS)]
    return written(parts.mapInArrow(coded, said), "id_segments")


def read_ids(segments: DataFrame, key: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """key, start, n_tokens, ids_crc32 and, if kept, ids of each document, decoded from its segment and checked."""
    kind = segments.schema["keys"].dataType.elementType.simpleString()
    # ids before each part: one number for each part of the range partitioning reaches the driver
    total = segments.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")).orderBy("part").collect()
    before, done = {}, 0
    for r in total:
        before[r.part] = done
        done += r.n

    def decoded(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                part, base, keys, n_tokens, size, crc, ids_crc, data, shares, shares_crc = (batch.column(k)[j].as_py() for k in range(10))
                at = np.concatenate([[0], np.cumsum(size)])
                blocks = [data[a:b] for a, b in zip(at[:-1], at[1:])]
                if [zlib.crc32(b) for b in blocks] != crc:
                    raise ValueError("a block's bytes differ from its checksum")
                if zlib.crc32(shares) != shares_crc:
                    raise ValueError("a segment's shares differ from their checksum")
                count = sum(n_tokens)
                got = decode_blocks(blocks, [min(BLOCK, count - k) for k in range(0, count, BLOCK)], Shares.restored(shares))
                if [zlib.crc32(b.astype("<u2").tobytes()) for b in got] != ids_crc:
                    raise ValueError("a block's ids differ from their checksum")
                stream = np.concatenate(got).astype("<u4")
                end = np.cumsum(n_tokens)
                start = end - n_tokens
                columns = [pa.array(keys, batch.schema.field(2).type.value_type), pa.array(start + base + before[part], pa.int64()), pa.array(n_tokens, pa.int64())]
                columns.append(pa.array([zlib.crc32(stream[a:b].tobytes()) for a, b in zip(start.tolist(), end.tolist())], pa.int64()))
                names = [key, "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]), pa.int32()), pa.array(stream.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return segments.mapInArrow(decoded, f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids)
