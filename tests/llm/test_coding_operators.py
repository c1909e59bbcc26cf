"""Token counts, byte BPE, id blocks and FLAC columns: against the libraries, and round trips."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cadenza.llm import byte_bpe, id_coder, media_columns, token_counts

from .conftest import frame

MODEL, RANKS, IDS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
ALPHABET = "ab '\n\t\r\x00\x1c\x1f▁ éßñ²½Ⅷ１中文😀́​<s>|_12sdlTHE\xa0  日"


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.load_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=80))
def test_counts_equal_the_library(pieces, text):
    assert token_counts.counter(MODEL).count(text) == len(pieces.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=80))
def test_byte_bpe_equals_the_library(library, text):
    own = byte_bpe.codec(RANKS, P.PATTERN)
    ids = own.encode(text)
    assert ids == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_long_pieces(library, pieces):
    own = byte_bpe.codec(RANKS, P.PATTERN)
    for text in ("a" * 5000, "aaab" * 2000, " " * 3000, "\n" * 500 + "x", "thethe" * 1500):
        assert own.encode(text) == library.encode_ordinary(text)
        assert token_counts.counter(MODEL).count(text) == len(pieces.encode(text))


def test_caches_stay_bounded(monkeypatch, library, pieces):
    monkeypatch.setattr(byte_bpe, "CACHE", 8)
    monkeypatch.setattr(token_counts, "CACHE", 8)
    own, counter = byte_bpe.Codec(RANKS, P.PATTERN), token_counts.Counter(MODEL)
    for k in range(60):
        text = f"word{k} other{k % 7} thing"
        assert own.encode(text) == library.encode_ordinary(text)
        assert counter.count(text) == len(pieces.encode(text))
    assert len(own.young) + len(own.old) <= 8 and len(counter.spaced) + len(counter.spaced_old) <= 8


def test_token_counts(odd, odd_rows, none, pieces):
    got = Counter(tuple(r) for r in token_counts.token_counts(odd, MODEL, 4096).collect())
    assert got == Counter((k, len((t or "").encode()), n := len(pieces.encode(t or "")), n > 4096) for k, t in odd_rows)
    assert token_counts.token_counts(none, MODEL, 4096).count() == 0


def test_encode_column(odd, odd_rows, none, library):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in byte_bpe.encode_column(odd, RANKS, P.PATTERN).collect())
    want = Counter()
    for k, t in odd_rows:
        ids = library.encode_ordinary(t or "")
        want[k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids)] += 1
    assert got == want
    assert byte_bpe.encode_column(none, RANKS, P.PATTERN).count() == 0


# ---- id blocks


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 3)), min_size=1, max_size=300), min_size=1, max_size=6))
def test_blocks_round_trip(blocks):
    own = sorted((np.array(b, np.int32) for b in blocks), key=len, reverse=True)
    coded = id_coder.encode_blocks(own)
    assert [b.tolist() for b in id_coder.decode_blocks(coded, [len(b) for b in own])] == [b.tolist() for b in own]


def test_blocks_shrink_what_repeats():
    x = np.tile(np.random.default_rng(1).integers(0, 50_000, 200), 20).astype(np.int32)
    assert len(id_coder.encode_blocks([x])[0]) < len(x)  # a fifth of two bytes an id


def test_blocks_cost_no_more_than_some_sorts():
    """Coding and decoding, in CPU time of sorting as many numbers: 16-way choices for each id took over twice the bound."""
    import time

    ids = np.minimum(np.random.default_rng(2).zipf(1.3, 512 * 512), 50_000).astype(np.int32)
    blocks, numbers = list(ids.reshape(512, 512)), np.random.default_rng(3).random(len(ids))

    def least(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    both = least(lambda: id_coder.decode_blocks(id_coder.encode_blocks(blocks), [512] * 512))
    assert both < 17 * least(lambda: np.argsort(numbers, kind="stable"))


def test_blocks_with_counts():
    """Counts of the segment code what no block predicts in fewer bytes; the counts themselves come back."""
    ids = np.minimum(np.random.default_rng(4).zipf(1.5, 9000), 60_000).astype(np.int32)
    blocks = [ids[k : k + 4096] for k in range(0, 9000, 4096)]
    shares = id_coder.Shares.restored(id_coder.Shares.counted(ids).stored())
    assert int(shares.size.sum()) == 1 << id_coder.SHARES and set(np.flatnonzero(shares.size)) == set(ids.tolist())
    coded = id_coder.encode_blocks(blocks, shares)
    assert [b.tolist() for b in id_coder.decode_blocks(coded, [len(b) for b in blocks], shares)] == [b.tolist() for b in blocks]
    assert id_coder.decode_blocks(coded[1:2], [4096], shares)[0].tolist() == blocks[1].tolist()  # a block by itself
    assert sum(map(len, coded)) < 0.7 * sum(map(len, id_coder.encode_blocks(blocks)))
    for few in (np.zeros(5, np.int32), np.array([65535], np.int32), np.arange(65536, dtype=np.int32)):
        shares = id_coder.Shares.restored(id_coder.Shares.counted(few).stored())
        assert id_coder.decode_blocks(id_coder.encode_blocks([few], shares), [len(few)], shares)[0].tolist() == few.tolist()


def test_library_ids():
    own = id_coder.Encoder(IDS)
    some = ["", "a<|endoftext|>b", "word word", "²½ Ⅷ", "the\x1cend", " x\n\n y"]
    assert own.encode(some) == [x.ids for x in Tokenizer.from_file(IDS).encode_batch(some, add_special_tokens=False)]


def test_id_files(odd, odd_rows, none, monkeypatch):
    monkeypatch.setattr(id_coder, "SEGMENT", 2000)
    library = Tokenizer.from_file(IDS)
    got = id_coder.read_ids(id_coder.write_ids(odd, IDS)).collect()
    got = sorted(got, key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    want = Counter()
    for k, t in odd_rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want[k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), tuple(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32, tuple(r.ids)) for r in got) == want
    assert id_coder.read_ids(id_coder.write_ids(none, IDS)).count() == 0


def test_damaged_blocks_are_found(spark, odd):
    from pyspark.sql import functions as F

    segments = id_coder.write_ids(odd, IDS)
    bad = segments.withColumn("data", F.unhex(F.regexp_replace(F.hex("data"), "^..", "FE"))).withColumn("data", F.concat(F.unhex(F.lit("01")), F.expr("substring(data, 2)")))
    with pytest.raises(Exception, match="checksum"):
        id_coder.read_ids(bad).collect()


# ---- FLAC


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=576, max_size=576), min_size=1, max_size=4), st.sampled_from([0, 1, 3]))
def test_flac_round_trip(parts, order):
    stream = media_columns.encode_streams([b"".join(parts)], 576, order)[0]
    assert (media_columns.decode_streams([stream])[0] + 128).astype(np.uint8).tobytes() == b"".join(parts)


def test_flac_shapes():
    wave = (128 + 90 * np.sin(np.arange(576 * 40) / 25)).astype(np.uint8).tobytes()
    for order in (0, 2, 8):
        stream = media_columns.encode_streams([wave], 576, order)[0]
        assert len(stream) < 0.6 * len(wave)
        assert (media_columns.decode_streams([stream])[0] + 128).astype(np.uint8).tobytes() == wave
        for at in (0, 575, 576, 576 * 20 + 3, len(wave) - 1):
            k = at // 576
            assert (media_columns.seek(stream, at) + 128).astype(np.uint8).tobytes() == wave[576 * k : 576 * (k + 1)]
    extremes = bytes([0, 255] * 288) + bytes([128] * 575 + [255])
    assert (media_columns.decode_streams(media_columns.encode_streams([extremes]))[0] + 128).astype(np.uint8).tobytes() == extremes


def test_flac_checksums():
    """CRC-8 and CRC-16 by their definition, bit by bit; a flipped bit is found."""

    def crc(data, poly, bits):
        r = 0
        for b in data:
            r ^= b << (bits - 8)
            for _ in range(8):
                r = (r << 1) ^ poly if r >> (bits - 1) & 1 else r << 1
                r &= (1 << bits) - 1
        return r

    stream = bytearray(media_columns.encode_streams([bytes(range(256)) * 9])[0])
    p = media_columns.stream_parts(bytes(stream))
    starts = [*media_columns._frame_starts(bytes(stream), p), len(stream)]
    for a, b in zip(starts, starts[1:]):
        assert crc(stream[a : b - 2], 0x8005, 16) == int.from_bytes(stream[b - 2 : b], "big")
    assert crc(stream[starts[0] : starts[0] + 5], 0x07, 8) == stream[starts[0] + 5]
    stream[starts[0] + 40] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        media_columns.decode_streams([bytes(stream)])


def test_flac_columns(odd, odd_rows, none):
    rows = media_columns.flac_columns(odd).collect()
    want = Counter()
    for k, t in odd_rows:
        raw = (t or "").encode()
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        want[k, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert all(r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() for r in rows)
    assert media_columns.flac_columns(none).count() == 0


def test_pcm_blocks(spark):
    media = media_columns.flac_columns(frame(spark, [(1, "abc" * 500)]))
    blocks = sorted(media_columns.pcm_blocks(media).collect(), key=lambda r: r.block)
    assert b"".join(bytes(r.pcm) for r in blocks)[:1500] == b"abc" * 500
    assert [r.first_sample for r in blocks] == [0, 576, 1152] and blocks[0].byte_offset == 0


@pytest.mark.parametrize("wrong", [70_000, 1 << 16, -1])
def test_ids_beyond_16_bits_are_refused(wrong):
    """They would come back as others, with a right checksum."""
    with pytest.raises(ValueError, match="16 bits"):
        id_coder._segment([np.array([1, 2, wrong], np.int32)])
