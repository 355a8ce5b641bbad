import hashlib
import zlib

import numpy as np
import pytest

from weirflow.llm import flac_media as f

RNG = np.random.default_rng(3)
PAYLOADS = [
    b"\xff" * 576,
    bytes(576 * 2),
    bytes(RNG.integers(0, 256, 576 * 3, dtype=np.uint8)),
    bytes(np.cumsum(RNG.integers(-2, 3, 576 * 150)).astype(np.uint8)),
    f.payload_of("Many words in a text, and then some more. " * 60)[1],
    bytes(([0] * 575 + [255]) * 2),
    bytes((128 + 100 * np.sin(np.arange(576 * 4) / 9)).astype(np.uint8)),
]


def test_round_trip():
    files = f.encode(PAYLOADS)
    for p, x in zip(PAYLOADS, f.decode(files), strict=True):
        assert (x + 128).astype(np.uint8).tobytes() == p
    assert len(files[0]) < 100 and len(files[6]) < len(PAYLOADS[6])


@pytest.mark.parametrize("span", [(0, 1), (575, 577), (600, 1300), (1151, 1152), (10_000, 10**9)])
def test_blocks_of_a_range(span):
    files = f.encode(PAYLOADS)
    for p, blocks in zip(PAYLOADS, f.decode_blocks(files, *span), strict=True):
        want = [k for k in range(0, len(p), 576) if k + 576 > span[0] and k < span[1]]
        assert [at for at, _ in blocks] == want
        for at, x in blocks:
            assert (x + 128).astype(np.uint8).tobytes() == p[at : at + 576]


def test_without_seek_points():
    """Frames are then found one after the other."""
    (file,) = f.encode(PAYLOADS[3:4])
    info_end = 4 + 4 + 34
    bare = file[:4] + b"\x80" + file[5:info_end] + file[f.metadata(file)[2] :]
    assert (f.decode([bare])[0] + 128).astype(np.uint8).tobytes() == PAYLOADS[3]
    assert [at for at, _ in f.decode_blocks([bare], 600, 700)[0]] == [576]


def test_damage_is_found():
    (file,) = f.encode(PAYLOADS[4:5])
    begin = f.metadata(file)[2]
    for at in (begin, begin + 4, begin + 60, len(file) - 1):
        bad = bytearray(file)
        bad[at] ^= 0x10
        with pytest.raises(f.FlacError):
            f.decode([bytes(bad)])
    bad = bytearray(file)
    bad[4 + 4 + 20] ^= 1
    with pytest.raises(f.FlacError, match="MD5"):
        f.decode([bytes(bad)])
    with pytest.raises(f.FlacError):
        f.encode([b"short"])


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def rice(self, e, k):
        u = 2 * e if e >= 0 else -2 * e - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u & ((1 << k) - 1), k)

    def data(self):
        return np.packbits(self.bits).tobytes()


def framed(body, n=0):
    frame = f.frame_header(n) + body
    sums = f.crc(np.frombuffer(frame, np.uint8)[:, None], f.CRC16)
    return frame + int(sums[0]).to_bytes(2, "big")


@pytest.mark.parametrize("parts,method", [(0, 0), (2, 0), (3, 1)])
def test_predictor_with_coefficients(parts, method):
    """A quantized predictor of order 2, in partitions, one of which is stored raw."""
    x = np.round(90 * np.sin(np.arange(576) / 7)).astype(np.int64)
    coefs, shift, order = [62, -31], 5, 2
    w = Writer()
    w.put(0, 1), w.put(32 + order - 1, 6), w.put(0, 1)
    for s in x[:order]:
        w.put(int(s) & 0xFF, 8)
    w.put(7 - 1, 4), w.put(shift, 5)
    for c in coefs:
        w.put(c & 0x7F, 7)
    w.put(method, 2), w.put(parts, 4)
    e = [int(x[i]) - ((coefs[0] * int(x[i - 1]) + coefs[1] * int(x[i - 2])) >> shift) for i in range(order, 576)]
    at, size = 0, 576 >> parts
    for k in range(1 << parts):
        own = e[at : at + size - (order if k == 0 else 0)]
        at += len(own)
        if k == 1:
            w.put((1 << (4 + method)) - 1, 4 + method), w.put(12, 5)
            for v in own:
                w.put(v & 0xFFF, 12)
        else:
            w.put(k % 4, 4 + method)
            for v in own:
                w.rice(v, k % 4)
    md5 = hashlib.md5(x.astype(np.int8).tobytes()).digest()
    assert (f.decode([f.stream([framed(w.data())], 576, md5)])[0] == x).all()


def test_long_runs_of_zero_bits():
    w = Writer()
    w.put(0x10, 8), w.put(0, 2), w.put(0, 4), w.put(0, 4)
    x = [100, -100, 0] * 192
    for v in x:
        w.rice(v, 0)
    md5 = hashlib.md5(np.array(x, np.int8).tobytes()).digest()
    assert f.decode([f.stream([framed(w.data())], 576, md5)])[0].tolist() == x


def test_frame_numbers():
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 2**21, 2**26):
        head = f.frame_header(n)
        assert head[4:-1] == (chr(n).encode("utf-8", "surrogatepass") if n < 0x110000 else head[4:-1])
        assert f.crc(np.frombuffer(head, np.uint8)[:, None], f.CRC8)[0] == 0


def test_digests(spark, tables, corpus):
    texts = {i: t for i, t, *_ in corpus}
    for r in f.op6_flac_media(spark, tables["full"]).collect():
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])


def test_stored_blocks(docs, corpus):
    media = f.store(docs)
    got = f.pcm_blocks(media, 576, 1000).collect()
    texts = {i: f.payload_of(t)[1] for i, t, *_ in corpus}
    assert {r["doc_id"] for r in got} == {i for i, p in texts.items() if len(p) > 576}
    for r in got:
        pcm = (np.frombuffer(r["pcm"], np.int8).astype(int) + 128).astype(np.uint8).tobytes()
        assert pcm == texts[r["doc_id"]][r["sample_offset"] : r["sample_offset"] + r["n_samples"]]
