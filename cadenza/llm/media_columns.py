"""FLAC media columns: lossless frames of PCM samples with Rice residuals and linear predictors.

A stream is `fLaC`, STREAMINFO (with the MD5 of the samples), a SEEKTABLE with one point for every SEEK_EVERY frames, and
mono frames of a fixed block size at 8 or 16 bits a sample. All frames of a batch are coded in lock-step with numpy: a
lane is a frame, a step is a sample, so the interpreter's cost is paid once for each sample place and not for each sample.

Cases: a null or empty text is one block of padding; equal payloads give equal streams; a stream whose header or frame
checksum, sample count or MD5 is wrong raises ValueError; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import utf8

SEEK_EVERY = 16
RATE = 44100
#: Fixed values of the format: predictor coefficients by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for b in range(256):
        r = b << (bits - 8)
        for _ in range(8):
            r = ((r << 1) ^ poly) & mask if r & top else (r << 1) & mask
        out.append(r)
    return np.array(out, np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_PAIRS: list[np.ndarray] = []


def _crc16(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of the first length[i] bytes of each row; two bytes a step. Rows are zero beyond their length."""
    if not _PAIRS:
        first = CRC16[np.arange(65536, dtype=np.uint32) >> 8]
        both = np.arange(65536, dtype=np.uint32) ^ 0
        # the register after two bytes, as a function of register xor those bytes
        one = ((first.astype(np.uint32) ^ ((both & 0xFF) << 8)) & 0xFFFF).astype(np.uint32)
        _PAIRS.append((CRC16[one >> 8] ^ ((one << 8) & 0xFFFF)).astype(np.uint16))
    pair = _PAIRS[0]
    even = (length // 2).astype(np.int64)
    order = np.argsort(-even, kind="stable")
    words = np.ascontiguousarray(rows[order][:, : rows.shape[1] // 2 * 2]).view(">u2").astype(np.uint16)
    words = np.ascontiguousarray(words.T)
    counts = even[order]
    crc = np.zeros(len(rows), np.uint16)
    left = np.searchsorted(-counts, -np.arange(1, (counts[0] if len(counts) else 0) + 1), "right")
    for k, n in enumerate(left.tolist()):
        crc[:n] = pair[crc[:n] ^ words[k, :n]]
    out = np.empty_like(crc)
    out[order] = crc
    odd = np.flatnonzero(length % 2)
    last = rows[odd, length[odd] - 1].astype(np.uint16)
    out[odd] = (out[odd] << np.uint16(8)) ^ CRC16[(out[odd] >> np.uint16(8)) ^ last]
    return out


def _coded_number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | (n >> (6 * k)) & 0x3F for k in range(size - 2, -1, -1)]
    return bytes([(0xFF00 >> size) & 0xFF | (n >> (6 * (size - 1))), *tail])


_HEADERS: dict[tuple[int, int, int], bytes] = {}


def _header(number: int, block: int, bits: int) -> bytes:
    key = (number, block, bits)
    if key not in _HEADERS:
        if len(_HEADERS) > 50_000:
            _HEADERS.clear()
        code = {576: 2, 1152: 3, 2304: 4, 4608: 5}.get(block, 7)
        head = bytes([0xFF, 0xF8, code << 4, {8: 1, 16: 4}[bits] << 1]) + _coded_number(number) + (struct.pack(">H", block - 1) if code == 7 else b"")
        crc = 0
        for b in head:
            crc = int(CRC8[crc ^ b])
        _HEADERS[key] = head + bytes([crc])
    return _HEADERS[key]


def encode_frames(samples: np.ndarray, numbers: np.ndarray, bits: int = 8, lpc_order: int = 0) -> list[bytes]:
    """Frames of the rows of `samples`: the shortest of constant, verbatim, fixed orders 0 to 4 and, if asked for, one LPC order."""
    n, block = samples.shape
    x = samples.astype(np.int32)
    best, kind, resid = np.full(n, block * bits, np.int64), np.full(n, -1), np.zeros((n, block), np.int32)
    rice = np.zeros(n, np.int64)
    diff, coded = x, {}
    for order in range(5):
        if order:
            diff = np.diff(diff, axis=1)
        size = np.abs(diff).astype(np.int64).sum(axis=1)
        k = np.clip(np.ceil(np.log2(np.maximum(1, 2 * size / diff.shape[1]) * 0.6931)), 0, 14).astype(np.int64)
        bound = 10 + order * bits + diff.shape[1] * (1 + k) + ((2 * size) >> k)
        better = bound < best
        best[better], kind[better], rice[better] = bound[better], order, k[better]
        coded[order] = diff
    for order in range(5):
        at = np.flatnonzero(kind == order)
        if len(at):
            resid[at, order:] = coded[order][at]
    coefficient = np.zeros((n, max(1, lpc_order)), np.int32)
    shift = 10
    if lpc_order:
        f = x.astype(np.float64)
        lag = np.stack([(f[:, : block - k] * f[:, k:]).sum(axis=1) for k in range(lpc_order + 1)], axis=1)
        for i in range(n):
            r = lag[i]
            m = np.array([[r[abs(a - b)] for a in range(lpc_order)] for b in range(lpc_order)]) + np.eye(lpc_order) * (r[0] * 1e-9 + 1e-9)
            c = np.clip(np.rint(np.linalg.solve(m, r[1:]) * (1 << shift)), -8191, 8191).astype(np.int32)
            guess = sum(c[j] * x[i, lpc_order - 1 - j : block - 1 - j].astype(np.int64) for j in range(lpc_order)) >> shift
            e = x[i, lpc_order:] - guess
            size = int(np.abs(e).sum())
            k = int(np.clip(np.ceil(np.log2(max(1, 2 * size / len(e)) * 0.6931)), 0, 14))
            if (bound := 10 + lpc_order * (bits + 14) + 9 + len(e) * (1 + k) + ((2 * size) >> k)) < best[i]:
                best[i], kind[i], rice[i], coefficient[i] = bound, 8 + lpc_order, k, c
                resid[i, lpc_order:] = e
    kind[(x == x[:, :1]).all(axis=1)] = -2
    out: list[bytes] = [b""] * n
    heads = [_header(int(v), block, bits) for v in numbers.tolist()]
    width = {8: ">i1", 16: ">i2"}[bits]
    bodies: dict[int, np.ndarray] = {}
    for i in np.flatnonzero(kind == -2).tolist():
        bodies[i] = np.frombuffer(bytes([0]) + x[i, :1].astype(width).tobytes(), np.uint8)
    for i in np.flatnonzero(kind == -1).tolist():
        bodies[i] = np.frombuffer(bytes([2]) + x[i].astype(width).tobytes(), np.uint8)
    for what in np.unique(kind[kind >= 0]).tolist():
        at = np.flatnonzero(kind == what)
        order = what if what < 8 else what - 8
        fields = [(np.full(len(at), (8 + what if what < 8 else 32 + order - 1) << 1), 8)]
        fields += [(x[at, j], bits) for j in range(order)]
        if what >= 8:
            fields += [(np.full(len(at), 13), 4), (np.full(len(at), shift), 5)] + [(coefficient[at, j], 14) for j in range(order)]
        fields += [(np.zeros(len(at), np.int64), 2), (np.zeros(len(at), np.int64), 4), (rice[at], 4)]
        lead = sum(w for _, w in fields)
        e = resid[at, order:]
        zig = ((e << 1) ^ (e >> 31)).astype(np.int64)
        k = rice[at][:, None]
        length = (zig >> k) + 1 + k
        end = np.cumsum(length, axis=1) + lead
        total = (end[:, -1] + 7) // 8
        plane = np.zeros((len(at), int(total.max()) * 8), np.uint8)
        place = 0
        for value, w in fields:
            v = np.asarray(value, np.int64)
            for b in range(w):
                plane[:, place + b] = (v >> (w - 1 - b)) & 1
            place += w
        flat, row = plane.reshape(-1), (np.arange(len(at)) * plane.shape[1])[:, None]
        stop = end + row - 1
        flat[(stop - k).reshape(-1)] = 1
        for b in range(int(rice[at].max())):
            has = (k > b) & (((zig >> b) & 1) > 0)
            flat[(stop - b)[has]] = 1
        packed = np.packbits(plane, axis=1)
        for j, i in enumerate(at.tolist()):
            bodies[i] = packed[j, : total[j]]
    size = np.array([len(heads[i]) + len(bodies[i]) for i in range(n)], np.int64)
    rows = np.zeros((n, int(size.max())), np.uint8)
    for i in range(n):
        h = len(heads[i])
        rows[i, :h] = np.frombuffer(heads[i], np.uint8)
        rows[i, h : size[i]] = bodies[i]
    crc = _crc16(rows, size)
    for i in range(n):
        out[i] = rows[i, : size[i]].tobytes() + int(crc[i]).to_bytes(2, "big")
    return out


def encode_streams(payloads: list[bytes], block: int = 576, lpc_order: int = 0, lanes: int = 4096) -> list[bytes]:
    """A FLAC stream of 8-bit mono samples (byte - 128) for each payload, whose length is a positive multiple of block."""
    counts = [len(p) // block for p in payloads]
    pcm = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, block)
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, np.int64)
    frames: list[bytes] = []
    for low in range(0, len(pcm), lanes):
        frames += encode_frames(pcm[low : low + lanes].astype(np.int16) - 128, numbers[low : low + lanes], 8, lpc_order)
    out, at = [], 0
    for payload, count in zip(payloads, counts):
        own = frames[at : at + count]
        at += count
        size = [len(f) for f in own]
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", block, block) + min(size).to_bytes(3, "big") + max(size).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        begin = np.concatenate([[0], np.cumsum(size)])
        seek = b"".join(struct.pack(">QQH", k * block, int(begin[k]), block) for k in range(0, count, SEEK_EVERY))
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek + b"".join(own))
    return out


def stream_parts(stream: bytes) -> dict:
    """STREAMINFO, seek points and the place of the first frame."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, out = 4, False, {"seek": []}
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            word = int.from_bytes(body[10:18], "big")
            out |= {"block": int.from_bytes(body[2:4], "big"), "largest": int.from_bytes(body[7:10], "big"), "bits": ((word >> 36) & 31) + 1, "samples": word & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind == 3:
            out["seek"] = [struct.unpack(">QQH", body[k : k + 18]) for k in range(0, size, 18)]
        at += 4 + size
    return out | {"first": at}


def _frame_starts(stream: bytes, part: dict) -> list[int]:
    """Where each frame begins: the next sync code whose header carries the expected number and a right CRC-8."""
    block, starts, at = part["block"], [], part["first"]
    for number in range(-(-part["samples"] // block)):
        head = _header(number, block, part["bits"])
        at = part["first"] if number == 0 else stream.find(head, at + 6)
        if at < 0 or stream[at : at + len(head)] != head:
            raise ValueError("a frame header is missing or its checksum is wrong")
        starts.append(at)
    return starts


def decode_frames(rows: np.ndarray, size: np.ndarray, head: np.ndarray, block: int, bits: int) -> np.ndarray:
    """Samples of the frames in `rows` (zero beyond size, with 8 spare bytes); head: length of each frame header."""
    n = len(rows)
    crc = _crc16(np.where(np.arange(rows.shape[1]) < (size - 2)[:, None], rows, 0), size - 2)
    at = np.arange(n)
    if (crc != (rows[at, size - 2].astype(np.uint16) << np.uint16(8) | rows[at, size - 1])).any():
        raise ValueError("a frame checksum is wrong")
    kind = rows[at, head] >> 1
    out = np.zeros((n, block), np.int32)
    wide = {8: 1, 16: 2}[bits]
    for i in np.flatnonzero(kind <= 1).tolist():
        raw = rows[i, head[i] + 1 : head[i] + 1 + (wide if kind[i] == 0 else block * wide)].tobytes()
        out[i] = np.frombuffer(raw, {8: ">i1", 16: ">i2"}[bits])
    flat, stride = np.ascontiguousarray(rows).reshape(-1), rows.shape[1]
    # every byte place as the 32 bits that begin there
    padded = np.append(flat, np.zeros(8, np.uint8)).astype(np.uint32)
    words = (padded[:-8] << np.uint32(24)) | (padded[1:-7] << np.uint32(16)) | (padded[2:-6] << np.uint32(8)) | padded[3:-5]
    for what in np.unique(kind[kind > 1]).tolist():
        lane = np.flatnonzero(kind == what)
        order = what - 8 if what < 32 else what - 31
        place = (lane * stride + head[lane] + 1) * 8

        def take(w: int) -> np.ndarray:
            nonlocal place
            v = (words[place >> 3] << (place & 7).astype(np.uint32)) >> np.uint32(32 - w)
            place = place + w
            return v.astype(np.int32)

        def signed(v: np.ndarray, w: int) -> np.ndarray:
            return (v ^ (1 << (w - 1))) - (1 << (w - 1))

        got = np.zeros((block, len(lane)), np.int32)
        for j in range(order):
            got[j] = signed(take(bits), bits)
        if what < 32:
            factor, shift = [np.int32(c) for c in FIXED[order]], np.int32(0)
        else:
            precision = int(take(4)[0]) + 1
            shift = take(5)
            factor = [signed(take(precision), precision) for _ in range(order)]
        if (take(2) != 0).any() or (take(4) != 0).any():
            raise ValueError("a residual coding that this reader doesn't know")
        k = take(4)
        back = (np.uint32(32) - k.astype(np.uint32)).astype(np.uint32)
        none, mask = k == 0, (np.int64(1) << k.astype(np.int64)).astype(np.int32) - 1
        for j in range(order, block):
            v = words[place >> 3] << (place & 7).astype(np.uint32)
            # zeros before the next one bit: 24 or fewer are seen at once
            zeros = 31 - (np.frexp(v.astype(np.float64))[1] - 1)
            slow = np.flatnonzero((zeros > 24) | (v == 0))
            if len(slow):
                zeros = zeros.copy()
                for s in slow.tolist():
                    p, q = int(place[s]), int(place[s])
                    while not (flat[q >> 3] >> (7 - (q & 7))) & 1:
                        q += 1
                    zeros[s] = q - p
            place = place + zeros + 1
            low = (words[place >> 3] << (place & 7).astype(np.uint32)) >> np.where(none, np.uint32(31), back)
            zig = (zeros.astype(np.int32) << k) | (low.astype(np.int32) & mask)
            place = place + k
            e = (zig >> 1) ^ -(zig & 1)
            if order:
                guess = sum(factor[i] * got[j - 1 - i] for i in range(order)) >> shift
                e = e + guess
            got[j] = e
        out[lane] = got.T
    return out


def decode_streams(streams: list[bytes], lanes: int = 4096) -> list[np.ndarray]:
    """The samples of each stream, checked against frame checksums, sample count and MD5."""
    parts = [stream_parts(s) for s in streams]
    whole, groups = [np.zeros((-(-p["samples"] // p["block"]), p["block"]), np.int32) for p in parts], {}
    for k, (s, p) in enumerate(zip(streams, parts)):
        starts = _frame_starts(s, p)
        for number, (a, b) in enumerate(zip(starts, [*starts[1:], len(s)])):
            groups.setdefault((p["block"], p["bits"]), []).append((k, number, a, b))
    for (block, bits), frames in groups.items():
        for low in range(0, len(frames), lanes):
            some = frames[low : low + lanes]
            size = np.array([b - a for _, _, a, b in some], np.int64)
            rows = np.zeros((len(some), int(size.max()) + 8), np.uint8)
            head = np.array([len(_header(number, block, bits)) for _, number, _, _ in some], np.int64)
            for j, (k, _, a, b) in enumerate(some):
                rows[j, : b - a] = np.frombuffer(streams[k], np.uint8, b - a, a)
            got = decode_frames(rows, size, head, block, bits)
            for j, (k, number, _, _) in enumerate(some):
                whole[k][number] = got[j]
    out = []
    for p, x in zip(parts, whole):
        flat = x.reshape(-1)[: p["samples"]]
        if hashlib.md5(flat.astype({8: "<i1", 16: "<i2"}[p["bits"]]).tobytes()).digest() != p["md5"]:
            raise ValueError("the samples differ from the stream's MD5")
        out.append(flat)
    return out


def seek(stream: bytes, sample: int) -> np.ndarray:
    """The samples of the frame that holds `sample`, found from the nearest seek point before it."""
    p = stream_parts(stream)
    if not 0 <= sample < p["samples"]:
        raise ValueError("no such sample")
    first, offset, _ = max((x for x in p["seek"] if x[0] <= sample), default=(0, 0, 0))
    at, number = p["first"] + offset, first // p["block"]
    goal = sample // p["block"]
    while number < goal:
        number += 1
        at = stream.find(_header(number, p["block"], p["bits"]), at + 6)
    stop = stream.find(_header(number + 1, p["block"], p["bits"]), at + 6)
    raw = np.frombuffer(stream[at : stop if stop >= 0 else len(stream)], np.uint8)
    rows = np.concatenate([raw, np.zeros(8, np.uint8)])[None]
    return decode_frames(rows, np.array([len(raw)]), np.array([len(_header(number, p["block"], p["bits"]))]), p["block"], p["bits"])[0]


def _payloads(column: pa.Array, block: int) -> tuple[list[bytes], list[int]]:
    data, at = utf8(column)
    raw, at = data.tobytes(), at.tolist()
    size = [b - a for a, b in zip(at[:-1], at[1:])]
    return [raw[a:b] + b"\xff" * (max(block, -(-(b - a) // block) * block) - (b - a)) for a, b in zip(at[:-1], at[1:])], size


def flac_columns(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = 576, keep_media: bool = True) -> DataFrame:
    """key, n_bytes, media (the stream; left out if not kept), and what is computed from the samples read back from it:
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature ("mean absolute step:zero crossings:peak")."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["n_bytes long", "payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string"] + ["media binary"] * keep_media

    def coded(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                payloads, size = _payloads(part.column(1), block)
                streams = encode_streams(payloads, block)
                rows = []
                for samples, stream, n in zip(decode_streams(streams), streams, size):
                    back = (samples + 128).astype(np.uint8).tobytes()
                    step = int(np.abs(np.diff(samples)).sum())
                    sign = samples < 0
                    feature = f"{step * 1000 // len(samples)}:{int((sign[1:] != sign[:-1]).sum())}:{int(np.abs(samples).max())}"
                    rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), feature) + (stream,) * keep_media)
                columns = [part.column(0), *(pa.array(list(c)) for c in zip(*rows))]
                if keep_media:
                    columns[-1] = columns[-1].cast(pa.binary())
                yield pa.RecordBatch.from_arrays(columns, [key, *(x.split()[0] for x in names)])

    return docs.select(key, text).mapInArrow(coded, f"`{key}` {kind}, " + ", ".join(names))


def pcm_blocks(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per frame of each stream: key, block, first_sample, byte_offset (from the first frame), n_samples, pcm (8-bit unsigned)."""
    kind = media.schema[key].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            rows = []
            streams = [x for x in batch.column(1).to_pylist()]
            keys = batch.column(0).to_pylist()
            pairs = [(k, s) for k, s in zip(keys, streams) if s is not None]
            for (k, s), x in zip(pairs, decode_streams([s for _, s in pairs])):
                p = stream_parts(s)
                for b, start in enumerate(_frame_starts(s, p)):
                    own = x[b * p["block"] : (b + 1) * p["block"]]
                    rows.append((k, b, b * p["block"], start - p["first"], len(own), (own + 128).astype(np.uint8).tobytes()))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], [key, "block", "first_sample", "byte_offset", "n_samples", "pcm"])

    return media.select(key, column).mapInArrow(cut, f"`{key}` {kind}, block long, first_sample long, byte_offset long, n_samples long, pcm binary")
