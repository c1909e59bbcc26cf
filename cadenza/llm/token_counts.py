"""Token counts by heap-and-linked-list byte-pair merging.

A text's symbols stand in a doubly linked list; a heap holds adjacent pairs that form a piece, lowest rank (highest score)
first and leftmost among equals. Popping a live pair joins it and pushes its new neighbours. The count is the initial
symbols less the merges: no identifiers are made. A symbol that is no piece counts as its UTF-8 bytes (byte fallback).

A merge never reaches over a place where no piece of the vocabulary has those two characters side by side, so a text is
cut there first (before word starts and around line feeds) and counts of cut pieces are kept in a bounded cache.

Cases: null and empty texts have 0 bytes and 0 tokens; special strings inside texts are ordinary characters; texts of any
length are counted whole; extra columns are not read.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import texts

SPACE = "▁"
#: Entries of the two generations of a worker's cache together.
CACHE = 500_000


def merges(symbols: str, score) -> int:
    """How many merges the symbols take; score(piece) is a rank, None for no piece."""
    n = len(symbols)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    # by place, the rank of the pair that begins there; None: no such piece, or the place is gone
    now = [score(symbols[k : k + 2]) for k in range(n - 1)] + [None, None]
    heap = [(r, k) for k, r in enumerate(now) if r is not None]
    heapify(heap)
    done = 0
    while heap:
        rank, k = heappop(heap)
        if now[k] != rank:
            continue
        done += 1
        gone = after[k]
        now[gone] = None
        nxt = after[k] = after[gone]
        before[nxt] = k
        r = now[k] = score(symbols[k : after[nxt]]) if nxt < n else None
        if r is not None:
            heappush(heap, (r, k))
        if k:
            b = before[k]
            r = now[b] = score(symbols[b:nxt])
            if r is not None:
                heappush(heap, (r, b))
    return done


class Counter:
    """Counts tokens as the library for a byte-pair `.model` file does, with a dummy prefix and byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece has a word start inside: texts can't be cut at word starts")
        self.alone = not any("\n" in p and len(p) > 1 for p in self.rank)
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        self.spaced_old: dict[str, int] = {}
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def measured(self, part: str) -> int:
        """Initial symbols, with the bytes of those that are no piece, less the merges."""
        return len(part) + sum(len(c.encode()) - 1 for c in part if c not in self.rank) - merges(part, self.rank.get)

    def piece(self, part: str) -> int:
        found = self.young.get(part)
        if found is None:
            found = self.old.get(part)
            if found is None:
                found = self.measured(part)
            if len(part) <= 200:
                if len(self.young) >= CACHE // 2:
                    self.old, self.young = self.young, {}
                self.young[part] = found
        return found

    def after_space(self, part: str) -> int:
        if (found := self.spaced_old.get(part)) is None:
            found = self.measured(SPACE + part)
        if len(part) <= 200:
            if len(self.spaced) >= CACHE // 2:
                self.spaced_old = self.spaced.copy()
                self.spaced.clear()
            self.spaced[part] = found
        return found

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.alone:
            return sum(map(self.piece, self.cut.findall(SPACE + text.replace(" ", SPACE))))
        total, piece = text.count("\n"), self.piece
        if SPACE in text or "  " in text or text[0] == " ":
            for line in (SPACE + text.replace(" ", SPACE)).split("\n"):
                total += sum(map(piece, self.cut.findall(line)))
            return total
        # single spaces: a part is what follows a space, up to a space or a line feed; its key keeps the space
        for line in (" " + text).split("\n"):
            parts = line.split(" ")
            if parts[0]:
                total += piece(parts[0])
            known = list(map(self.spaced.get, parts[1:]))
            if None in known:
                for k, found in enumerate(known):
                    if found is None:
                        known[k] = self.after_space(parts[k + 1])
            total += sum(known)
        return total


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, model: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (n_tokens > limit) of every text; model: the path of a `.model` file on every worker."""
    kind = docs.schema[key].dataType.simpleString()

    def counted(batches):
        count = counter(model).count
        for batch in batches:
            rows = texts(batch.column(1))
            tokens = [count(t) for t in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in rows], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(key, text).mapInArrow(counted, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
