"""Media columns as FLAC.

Bytes are stored as mono 8-bit FLAC (RFC 9639) in blocks of 576 samples with a
seek point for each block, and read back: frame headers, Rice residuals and
linear predictors are decoded for very many frames at once, one sample of each
frame a step, and the header checksum, the frame checksum and the MD5 of the
stream are verified.  Blocks come out with their sample offset, and a range of
samples needs only the frames that hold it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm._shared import table

BLOCK = 576
RATE = 8000
#: Frames that are coded together, and payload bytes that are held at once besides a single longer text.
FRAMES, HELD_BYTES = 4096, 6 << 20
#: Seek points fit a metadata block of 24-bit length.
MOST_POINTS = 900_000
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class FlacError(ValueError):
    """The stored bytes are not a stream that can be read, or a checksum differs."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out, top = [], 1 << (bits - 1)
    for c in range(256):
        c <<= bits - 8
        for _ in range(8):
            c = (c << 1) ^ (poly if c & top else 0)
        out.append(c & ((1 << bits) - 1))
    return np.array(out, np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
LEADING_ZEROS = np.array([16, *(16 - i.bit_length() for i in range(1, 1 << 16))], np.int64)


def crc(columns: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Checksums of the columns of a byte matrix.  They start from 0, so rows of zeros before the first byte don't count."""
    state = np.zeros(columns.shape[1], np.uint16)
    for row in columns:
        state = table[state ^ row] if table is CRC8 else (state << np.uint16(8)) ^ table[(state >> np.uint16(8)) ^ row]
    return state


def right_aligned(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Columns with data[start:end], zeros before."""
    width = int((end - start).max(initial=0))
    at = np.arange(-width, 0)[:, None] + end[None, :]
    return np.where(at >= start[None, :], data[np.maximum(at, 0)], 0).astype(np.uint8)


def coded_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    head = (0xFF00 >> size) & 0xFF | n >> (6 * (size - 1))
    return bytes([head, *(0x80 | (n >> 6 * k) & 0x3F for k in range(size - 2, -1, -1))])


def frame_header(n: int) -> bytes:
    """Header of frame n: fixed block size 576, 8 kHz, mono, 8 bits."""
    head = b"\xff\xf8\x24\x02" + coded_number(n)
    state = 0
    for b in head:
        state = int(CRC8[state ^ b])
    return head + bytes([state])


_headers: list[bytes] = []


def _header(n: int) -> bytes:
    while len(_headers) <= n and n < 1 << 16:
        _headers.append(frame_header(len(_headers)))
    return _headers[n] if n < 1 << 16 else frame_header(n)


def encode_bodies(x: np.ndarray) -> list[bytes]:
    """The subframe of each row of samples, int32 [frames, BLOCK]: constant, verbatim, or the best fixed predictor with Rice codes."""
    n, size = x.shape
    residual, cost = [x], []
    for _ in FIXED[1:]:
        residual.append(np.diff(residual[-1], axis=1))
    cost = np.stack([np.abs(r[:, len(FIXED) - 1 - o :]).sum(axis=1) for o, r in enumerate(residual)])
    order = cost.argmin(axis=0)
    out: list[bytes] = [b""] * n
    constant = (x == x[:, :1]).all(axis=1)
    verbatim = np.zeros(n, bool)
    for o, r in enumerate(residual):
        own = np.flatnonzero((order == o) & ~constant)
        if not len(own):
            continue
        e = r[own]
        u = np.where(e < 0, -2 * e - 1, 2 * e)
        guess = np.maximum(0, np.floor(np.log2(np.maximum(u.mean(axis=1), 1)))).astype(np.int64)
        tries = np.stack([np.clip(guess + d, 0, 14) for d in (-1, 0, 1)])
        bits = np.stack([(u >> k[:, None]).sum(axis=1) + u.shape[1] * (1 + k) for k in tries])
        best = bits.argmin(axis=0)
        k, total = tries[best, np.arange(len(own))], bits.min(axis=0)
        dear = total + 10 + 8 * o >= 8 * size
        verbatim[own[dear]] = True
        own, u, k, total = own[~dear], u[~dear], k[~dear], total[~dear]
        if not len(own):
            continue
        # Subframe header, warm-up samples and the residual's header are 18 + 8 * o bits.
        head = 18 + 8 * o
        q = u >> k[:, None]
        last = np.cumsum(q + (1 + k)[:, None], axis=1) + (head - 1)
        value = ((1 << k)[:, None] | (u & ((1 << k) - 1)[:, None])).astype(np.int64)
        words = (int(last[:, -1].max()) >> 5) + 2
        at = (last >> 5) + (np.arange(len(own)) * words)[:, None] + 1
        value <<= 31 - (last & 31)
        low = np.bincount(at.ravel(), (value & 0xFFFFFFFF).ravel(), len(own) * words + 1)
        high = np.bincount(at.ravel() - 1, (value >> 32).ravel(), len(own) * words + 1)
        coded = (low + high)[: len(own) * words].astype(">u4").reshape(len(own), words)[:, 1:].tobytes()
        stride = 4 * (words - 1)
        size_of = (head + total + 7) // 8
        for i, f in enumerate(own.tolist()):
            body = bytearray(coded[i * stride : i * stride + int(size_of[i])])
            # 0, type 001ooo, no wasted bits; warm-up; method 00, one partition, its parameter.
            front = 0x10 | o << 1
            for w in x[f, :o].tolist():
                front = front << 8 | w & 0xFF
            front = (front << 10 | int(k[i])) << 6
            for j, b in enumerate(front.to_bytes(o + 3, "big")):
                body[j] |= b
            out[f] = bytes(body)
    for f in np.flatnonzero(verbatim & ~constant).tolist():
        out[f] = b"\x02" + x[f].astype(np.int8).tobytes()
    for f in np.flatnonzero(constant).tolist():
        out[f] = bytes([0, int(x[f, 0]) & 0xFF])
    return out


def stream(frames: list[bytes], n_samples: int, md5: bytes) -> bytes:
    """A FLAC file of frames of BLOCK samples, with a seek point for each frame or as many as fit."""
    sizes = np.array([len(f) for f in frames], np.int64)
    info = BLOCK.to_bytes(2, "big") * 2 + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | n_samples).to_bytes(8, "big") + md5
    step = -(-len(frames) // MOST_POINTS)
    points = np.zeros(len(range(0, len(frames), step)), [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
    points["sample"] = np.arange(0, len(frames), step) * BLOCK
    points["offset"] = (np.cumsum(sizes) - sizes)[::step]
    points["size"] = BLOCK
    seek = points.tobytes()
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC files of payloads, each a positive multiple of BLOCK bytes; a byte is the sample 128 less."""
    counts = [len(p) // BLOCK for p in payloads]
    if any(not c or len(p) % BLOCK for c, p in zip(counts, payloads, strict=True)):
        raise FlacError(f"a payload must be a positive multiple of {BLOCK} bytes")
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(c) for c in counts])
    frames: list[bytes] = []
    for at in range(0, len(data), FRAMES):
        own = [_header(n) + b for n, b in zip(numbers[at : at + FRAMES].tolist(), encode_bodies(data[at : at + FRAMES].astype(np.int32) - 128), strict=True)]
        sizes = np.array([len(f) for f in own], np.int64)
        ends = np.cumsum(sizes)
        sums = crc(right_aligned(np.frombuffer(b"".join(own), np.uint8), ends - sizes, ends), CRC16)
        frames += [f + s for f, s in zip(own, (sums.astype(">u2").tobytes()[2 * i : 2 * i + 2] for i in range(len(own))), strict=True)]
    out, at = [], 0
    for p, c in zip(payloads, counts, strict=True):
        md5 = hashlib.md5((np.frombuffer(p, np.uint8) ^ np.uint8(128)).tobytes()).digest()
        out.append(stream(frames[at : at + c], len(p), md5))
        at += c
    return out


class Bits:
    """Reads bits at many places of one buffer."""

    def __init__(self, data: bytes) -> None:
        self.data = np.frombuffer(data + bytes(16), np.uint8)
        self.size = len(data)
        self.words = np.ndarray((len(self.data) - 7,), ">u8", self.data, strides=(1,))

    def ahead(self, at: np.ndarray) -> np.ndarray:
        """The next 57 bits or more, from the top of a word."""
        if len(at) and int(at.max()) > 8 * self.size:
            raise FlacError("a frame runs over the end of the stream")
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        """The next n bits, up to 32, as unsigned."""
        n = np.broadcast_to(np.asarray(n, np.uint64), at.shape)
        return np.where(n == 0, np.uint64(0), self.ahead(at) >> ((np.uint64(64) - n) & np.uint64(63))).astype(np.int64)

    def read_signed(self, at: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        v, n = self.read(at, n), np.asarray(n, np.int64)
        return v - np.where((n > 0) & (v >> np.maximum(n - 1, 0) & 1 > 0), 1 << n, 0)


def rice(bits: Bits, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals coded with parameters k at the places, and the places after them."""
    word = bits.ahead(at)
    q = LEADING_ZEROS[word >> np.uint64(48)]
    if int(q.max(initial=0)) == 16:
        far, base = np.flatnonzero(q == 16), at.copy()
        q = q.copy()
        while len(far):
            base[far] += 16
            more = LEADING_ZEROS[bits.ahead(base[far]) >> np.uint64(48)]
            q[far] += more
            far = far[more == 16]
        word = bits.ahead(at + q) << np.uint64(1)
    else:
        word = word << (q + 1).astype(np.uint64)
    rest = np.where(k == 0, np.uint64(0), word >> ((np.uint64(64) - k.astype(np.uint64)) & np.uint64(63))).astype(np.int64)
    u = q << k | rest
    return u >> 1 ^ -(u & 1), at + q + 1 + k


def decode_residuals(bits: Bits, at: np.ndarray, size: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """[size - order, frames] residuals from the two bits of the coding method on, and the places after them."""
    method, parts = bits.read(at, 2), bits.read(at + 2, 4)
    if (method > 1).any():
        raise FlacError("the coding method of the residuals is reserved")
    out = np.empty((size - order, len(at)), np.int64)
    at = at + 6
    for m, p in {(int(m), int(p)) for m, p in zip(method, parts, strict=True)}:
        own = np.flatnonzero((method == m) & (parts == p))
        pos, wide = at[own], 4 + m
        if size % (1 << p) or size >> p < order:
            raise FlacError("the partition order doesn't fit the block")
        row = 0
        for part in range(1 << p):
            k = bits.read(pos, wide)
            pos = pos + wide
            raw = k == (1 << wide) - 1
            plain = bits.read(pos, 5) if raw.any() else None
            pos = pos + 5 * raw
            for _ in range((size >> p) - (order if part == 0 else 0)):
                e, after = rice(bits, pos, np.where(raw, 0, k)) if not raw.all() else (np.zeros(len(own), np.int64), pos)
                if plain is not None:
                    e, after = np.where(raw, bits.read_signed(pos, plain), e), np.where(raw, pos + plain, after)
                out[row, own] = e
                pos, row = after, row + 1
        at[own] = pos
    return out, at


def decode_frames(bits: Bits, start: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples of the mono frames that begin at the byte offsets, and the byte offsets after them.  Checksums are verified."""
    at = start * 8
    if ((bits.read(at, 15) << 1) != 0xFFF8).any():
        raise FlacError("there is no frame where one should begin")
    code, rate = bits.read(at + 16, 4), bits.read(at + 20, 4)
    if bits.read(at + 24, 4).any():
        raise FlacError("only one channel is read")
    depth = np.array([0, 8, 12, -1, 16, 20, 24, 32])[bits.read(at + 28, 3)]
    if (depth < 8).any() or (depth > 24).any():
        raise FlacError("only samples of 8 to 24 bits are read")
    lead = bits.read(at + 32, 8)
    ones = 8 - np.array([0, *(i.bit_length() for i in range(1, 256))])[lead ^ 0xFF]
    at = at + 32 + 8 * np.maximum(1, ones)
    size = np.select([code == 1, (code >= 2) & (code <= 5), code >= 8], [192, 576 << np.clip(code - 2, 0, 3), 256 << np.clip(code - 8, 0, 7)], 0)
    for c, n in ((6, 8), (7, 16)):
        size = np.where(code == c, bits.read(at, n) + 1, size)
        at = at + n * (code == c)
    at = at + 8 * (rate == 12) + 16 * ((rate == 13) | (rate == 14))
    head_end = at >> 3
    if (size == 0).any() or (crc(right_aligned(bits.data, start, head_end), CRC8) != bits.data[head_end]).any():
        raise FlacError("the checksum of a frame's header differs")
    at = at + 8
    kind, wasted = bits.read(at + 1, 6), bits.read(at + 7, 1)
    at = at + 8
    if wasted.any():
        raise FlacError("wasted bits are not read")
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(start)
    for n, d, t in {(int(n), int(d), int(t)) for n, d, t in zip(size, depth, kind, strict=True)}:
        own = np.flatnonzero((size == n) & (depth == d) & (kind == t))
        pos = at[own]
        if t == 0:
            x, pos = np.repeat(bits.read_signed(pos, d)[None, :], n, axis=0), pos + d
        elif t == 1:
            x = np.stack([bits.read_signed(pos + d * i, d) for i in range(n)])
            pos = pos + d * n
        elif 8 <= t <= 12 or t >= 32:
            order = t - 8 if t < 32 else t - 31
            warm = [bits.read_signed(pos + d * i, d) for i in range(order)]
            pos = pos + d * order
            if t < 32:
                factors, shift = [np.int64(c) for c in FIXED[order]], np.zeros(len(own), np.int64)
            else:
                precision = bits.read(pos, 4) + 1
                shift = bits.read_signed(pos + 4, 5)
                if (precision == 16).any() or (shift < 0).any():
                    raise FlacError("a predictor is reserved")
                pos = pos + 9
                factors = [bits.read_signed(pos + precision * i, precision) for i in range(order)]
                pos = pos + precision * order
            e, pos = decode_residuals(bits, pos, n, order)
            x = np.empty((n, len(own)), np.int64)
            x[:order] = np.array(warm).reshape(order, len(own))
            if order == 0:
                x = e
            for i in range(order, n) if order else ():
                guess = factors[0] * x[i - 1]
                for j in range(1, order):
                    guess += factors[j] * x[i - 1 - j]
                x[i] = e[i - order] + (guess >> shift)
        else:
            raise FlacError("the kind of a subframe is reserved")
        at[own] = pos
        for f, samples in zip(own.tolist(), np.ascontiguousarray(x.T), strict=True):
            out[f] = samples
    body_end = (at + 7) >> 3
    held = bits.data[body_end].astype(np.int64) << 8 | bits.data[body_end + 1]
    if (body_end + 2 > bits.size).any() or (crc(right_aligned(bits.data, start, body_end), CRC16) != held).any():
        raise FlacError("the checksum of a frame differs")
    return out, body_end + 2


def metadata(data: bytes) -> tuple[dict, np.ndarray, int]:
    """Stream properties, seek points (sample, offset in bytes from the first frame), and where the first frame begins."""
    if data[:4] != b"fLaC":
        raise FlacError("the stream has no marker")
    at, info, points = 4, {}, np.zeros((0, 2), np.int64)
    while True:
        if at + 4 > len(data):
            raise FlacError("the metadata has no end")
        kind, size = data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            held = np.frombuffer(body, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
            held = held[held["sample"] != 0xFFFFFFFFFFFFFFFF]
            points = np.stack([held["sample"].astype(np.int64), held["offset"].astype(np.int64)], axis=1)
        last, at = data[at] >> 7, at + 4 + size
        if last:
            return info, points, at


def decode_blocks(streams: list[bytes], first: int = 0, last: int | None = None) -> list[list[tuple[int, np.ndarray]]]:
    """For each stream its blocks (sample offset, samples) that hold samples from `first` to before `last`.

    Decoding starts at seek points and goes on frame by frame from each, for
    all streams and points together; without seek points it starts at the
    first frame.
    """
    found: list[dict[int, np.ndarray]] = [{} for _ in streams]
    bits = Bits(b"".join(streams))
    owner, sample, offset, until = [], [], [], []
    base = 0
    for k, s in enumerate(streams):
        info, points, begin = metadata(s)
        total = info["samples"]
        stop = min(total, last if last is not None else total)
        marks = points if len(points) and points[0, 0] == 0 else np.concatenate([[[0, 0]], points])
        ends = np.append(marks[1:, 0], total)
        use = (ends > first) & (marks[:, 0] < stop)
        owner.append(np.full(use.sum(), k))
        sample.append(marks[use, 0])
        offset.append(marks[use, 1] + base + begin)
        until.append(np.minimum(ends[use], stop))
        base += len(s)
    owner, sample, offset, until = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, sample, offset, until))
    for at in range(0, len(owner), FRAMES):
        live = np.arange(at, min(at + FRAMES, len(owner)))
        while len(live):
            got, after = decode_frames(bits, offset[live])
            for i, x in zip(live.tolist(), got, strict=True):
                if sample[i] + len(x) > first:
                    found[owner[i]][int(sample[i])] = x
                sample[i] += len(x)
            offset[live] = after
            live = live[sample[live] < until[live]]
    return [sorted(f.items()) for f in found]


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """All samples of each stream; the MD5 of 8-bit streams is verified."""
    out = []
    for s, blocks in zip(streams, decode_blocks(streams), strict=True):
        info = metadata(s)[0]
        x = np.concatenate([b for _, b in blocks]) if blocks else np.zeros(0, np.int64)
        if len(x) != info["samples"]:
            raise FlacError("samples are missing")
        if info["bits"] == 8 and any(info["md5"]) and hashlib.md5(x.astype(np.int8).tobytes()).digest() != info["md5"]:
            raise FlacError("the MD5 of the samples differs")
        out.append(x)
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the text padded with bytes 255 to a positive multiple of BLOCK."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\xff" * (-len(data) % BLOCK if data else BLOCK)


def features(pcm: np.ndarray) -> str:
    """Root mean square, mean, share of sign changes and mean step of 8-bit samples."""
    x = pcm.astype(np.int64)
    n = len(x)
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"rms={np.sqrt(int((x * x).sum()) / n):.6f};mean={int(x.sum()) / n:.6f};turns={turns / n:.6f};step={int(np.abs(np.diff(x)).sum()) / n:.6f}"


def _held(batch: pa.RecordBatch, column: str, size_of) -> Iterator[tuple[int, int]]:  # noqa: ANN001
    """Row ranges of about HELD_BYTES."""
    at, total = 0, 0
    for i, v in enumerate(batch.column(column)):
        total += size_of(v)
        if total >= HELD_BYTES:
            yield at, i + 1
            at, total = i + 1, 0
    if at < batch.num_rows:
        yield at, batch.num_rows


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a FLAC file; a null text is empty and has one block of padding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _held(batch, "text", lambda v: len(v.as_buffer() or b"") if v.is_valid else BLOCK):
                sizes, payloads = zip(*(payload_of(t.as_py()) for t in batch.column("text")[a:b]), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array(sizes, pa.int64()), pa.array(encode(list(payloads)), pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def pcm_bytes(x: np.ndarray, bits: int) -> bytes:
    """Signed samples as little-endian bytes, as many a sample as `bits` need."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, : (bits + 7) // 8].tobytes()


def pcm_blocks(media: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """(doc_id, sample_offset, n_samples, pcm): the blocks of rows (doc_id, media) that hold samples from `first` to before `last`.

    pcm is of the stream's own sample width, little-endian.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _held(batch, "media", lambda v: len(v.as_buffer() or b"") if v.is_valid else 0):
                held = [(i, m.as_py()) for i, m in zip(batch.column("doc_id")[a:b], batch.column("media")[a:b], strict=True) if m.is_valid]
                rows = [
                    (i.as_py(), at, len(x), pcm_bytes(x, metadata(m)[0]["bits"]))
                    for (i, m), blocks in zip(held, decode_blocks([m for _, m in held], first, last), strict=True)
                    for at, x in blocks
                ]
                cols = list(zip(*rows, strict=True)) or [()] * 4
                kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "sample_offset", "n_samples", "pcm"])

    rows = media.select("doc_id", "media")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, sample_offset long, n_samples int, pcm binary")


def read_back(media: DataFrame) -> DataFrame:
    """Digests of rows (doc_id, n_bytes, media): payload and features are those of the decoded samples."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _held(batch, "media", lambda v: len(v.as_buffer())):
                part = batch.slice(a, b - a)
                files = [m.as_py() for m in part.column("media")]
                rows = []
                for file, pcm in zip(files, decode(files), strict=True):
                    payload = (pcm + 128).astype(np.uint8).tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), features(pcm)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                cols = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *cols], names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op6_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(store(table(spark, sf_dir, "documents")))
