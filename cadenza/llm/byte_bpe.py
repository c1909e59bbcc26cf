"""Byte-level byte-pair encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes stand in a doubly linked list. The queue has a bucket per merge rank with the places whose pair has
that rank, and two levels of bitmaps over the ranks: find-first-set in the upper word and then in one lower word gives the
next rank. Within a rank the leftmost place goes first. A merge leaves stale places in the buckets of its old neighbours;
they are skipped when they come up. Each place is entered at most three times, so a pre-token of n bytes takes
O(n log n) at the most, however long it is.

Cases: null and empty texts have no ids and decode to no bytes; special strings are ordinary text; every byte has an id,
so no text fails; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from collections.abc import Sequence
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import lean, texts

#: Entries of the two generations of a worker's cache together.
CACHE = 400_000
#: Rows that are coded at a time.
FEW = 500
#: Ids that are decoded at a time.
DECODED = 1 << 18
WORD = 256
BIT = [1 << k for k in range(4096)]  # words of up to 1,048,576 ranks


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_piece(piece: bytes, ranks: dict[bytes, int], low: list[int]) -> list[int]:
    """The ids of one pre-token. low: the lower words of the bitmap, one for each WORD ranks, all zero; they are so again at the end."""
    get = ranks.get
    if (whole := get(piece)) is not None:
        return [whole]
    n = len(piece)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    # the queue: for each rank its place, or a heap of places; bitmaps of ranks by word; a bitmap of words
    bucket: dict[int, int | list[int]] = {}
    held, bit_of = bucket.get, BIT
    top = 0
    # by place, the rank of the pair that begins there; None: no such merge, or the place is gone
    now = [get(piece[k : k + 2]) for k in range(n - 1)]
    for k, r in enumerate(now):
        if r is not None:
            if (own := held(r)) is None:
                bucket[r] = k
                w = r >> 8
                low[w] |= bit_of[r & 255]
                top |= bit_of[w]
            elif own.__class__ is int:
                bucket[r] = [own, k]
            else:
                own.append(k)
    now += (None, None)
    while top:
        w = (top & -top).bit_length() - 1
        bits = low[w]
        bit = bits & -bits
        rank = (w << 8) + bit.bit_length() - 1
        k = bucket[rank]
        if k.__class__ is not int:
            own = k
            k = heappop(own)
            if len(own) == 1:
                bucket[rank] = own[0]
        else:
            del bucket[rank]
            low[w] = bits = bits ^ bit
            if not bits:
                top ^= bit_of[w]
        if now[k] != rank:
            continue  # stale
        gone = after[k]
        now[gone] = None
        nxt = after[k] = after[gone]
        before[nxt] = k
        r = now[k] = get(piece[k : after[nxt]]) if nxt < n else None
        if r is not None:
            if (own := held(r)) is None:
                bucket[r] = k
                w = r >> 8
                low[w] |= bit_of[r & 255]
                top |= bit_of[w]
            elif own.__class__ is int:
                bucket[r] = [own, k] if own < k else [k, own]
            else:
                heappush(own, k)
        if k:
            b = before[k]
            r = now[b] = get(piece[b:nxt])
            if r is not None:
                if (own := held(r)) is None:
                    bucket[r] = b
                    w = r >> 8
                    low[w] |= bit_of[r & 255]
                    top |= bit_of[w]
                elif own.__class__ is int:
                    bucket[r] = [own, b] if own < b else [b, own]
                else:
                    heappush(own, b)
    out, k = [], 0
    while k < n:
        out.append(ranks[piece[k : (k := after[k])]])
    return out


def _odd_numbers() -> str:
    """Characters of the basic plane that Python's \\w takes for letters and the pattern for numbers."""
    return "".join(c for c in map(chr, range(0xFFFF)) if unicodedata.category(c) in ("Nl", "No"))


def _ranges(pattern: str) -> str:
    """A class of the characters below 65536 that a pattern of one character matches, as ranges."""
    own = np.array([m.start() for m in re.finditer(pattern, "".join(map(chr, range(1 << 16))))])
    cut = np.flatnonzero(np.diff(own) != 1)
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(own[np.append(0, cut + 1)].tolist(), own[np.append(cut, len(own) - 1)].tolist())) + "]"


def splitter(pattern: str):
    """A function from a text to its pre-tokens."""
    import regex

    full = regex.compile(pattern).findall
    if pattern != r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""":
        return full
    # the same classes in the standard module, which has no \p: equal but for numbers that aren't decimal digits, and control characters
    # (classes as plain ranges, which it looks up faster; what begins a contraction begins no run of letters or digits)
    letter, digit, mark, space = (_ranges(x) for x in (r"[^\W\d_]", r"\d", r"[^\s\w]|_", r"\s"))
    fast = re.compile(rf" ?{letter}+| ?{digit}+|'(?:s|t|re|ve|m|ll|d)| ?{mark}+|{space}+(?!\S)|{space}+").findall
    odd, astral = re.compile(f"[{_odd_numbers()}]").search, re.compile("[\U00010000-\U0010ffff]").search

    def split(text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f") or not text.isascii() and (odd(text) or astral(text)):
            return full(text)
        return fast(text)

    return split


class _Pieces(dict):
    """Coded pre-tokens; looking up one that is not there codes it."""

    __slots__ = ("code",)

    def __missing__(self, part: str) -> bytes:
        return self.code(part)


class Codec:
    """Encodes and decodes with one rank file; the pattern is that of the rank files' library. A pre-token's ids are kept as bytes of
    32-bit numbers, so that a text's are joined without a Python number for each."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.split = splitter(pattern)
        # the bytes of all ids one after another, where each begins and how long it is
        known = sorted((v, k) for k, v in self.ranks.items())
        self.vocabulary = np.frombuffer(b"".join(k for _, k in known), np.uint8)
        self.size = np.full(known[-1][0] + 1, -1, np.int32)
        self.size[[v for v, _ in known]] = [len(k) for _, k in known]
        self.begin = (np.cumsum(np.maximum(self.size, 0)) - np.maximum(self.size, 0)).astype(np.int32)
        self.low = [0] * (known[-1][0] // WORD + 1)
        self.name = list(map(str, range(len(self.size))))
        self.old: dict[str, bytes] = {}
        self.renew()

    def renew(self) -> None:
        self.young = _Pieces()
        self.young.code = self.piece

    def piece(self, part: str) -> bytes:
        # a list of lookups may outlive its generation, so the present one is asked again
        found = self.young.get(part) or self.old.get(part)
        if found is None:
            ids = encode_piece(part.encode(), self.ranks, self.low)
            found = struct.pack(f"<{len(ids)}i", *ids)
        if len(part) <= 200:
            if len(self.young) >= CACHE // 2:
                self.old = self.young
                self.renew()
            self.young[part] = found
        return found

    def packed(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.young.__getitem__, self.split(text))), "<i4")

    def encode(self, text: str) -> list[int]:
        return self.packed(text).tolist()

    def decimal(self, ids: np.ndarray) -> str:
        return ",".join(map(self.name.__getitem__, ids.tolist()))

    def decode(self, ids: Sequence[int] | np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int32)
        if len(ids) and not (0 <= int(ids.min()) and int(ids.max()) < len(self.size) and int(self.size[ids].min()) > 0):
            raise ValueError("an id stands for no bytes")
        out = []
        for low in range(0, len(ids), DECODED):
            own = ids[low : low + DECODED]
            size = self.size[own]
            end = np.cumsum(size)
            at = np.repeat(self.begin[own] - (end - size), size)
            at += np.arange(len(at))
            out.append(self.vocabulary[at].tobytes())
        return b"".join(out)


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode_column(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """key, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the bytes that the ids decode to) and, if kept, ids."""
    kind = docs.schema[key].dataType.simpleString()

    def coded(batches):
        own = codec(ranks, pattern)
        # a few rows at a time, as their ids are held until they are an Arrow column
        for batch in (whole.slice(k, FEW) for whole in batches for k in range(0, whole.num_rows, FEW)):
            count, said, back, kept = [], [], [], []
            for t in texts(batch.column(1)):
                ids = own.packed(t)
                count.append(len(ids))
                said.append(hashlib.sha256(own.decimal(ids).encode()).hexdigest())
                back.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                ends = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(kept))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(key, text).mapInArrow(lean(coded), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
