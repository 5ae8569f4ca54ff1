import hashlib
import zlib

import numpy as np

from logtide.llm import pjpeg

from .conftest import make


def test_lossless_and_both_readers_agree(monkeypatch):
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 40):
        data = rng.integers(0, 256, 576 * n).astype(np.uint8).tobytes()
        image = pjpeg.decode(pjpeg.store(data))
        assert pjpeg.payload(image) == data
        with monkeypatch.context() as patch:
            patch.setattr(pjpeg, "_even_scan", lambda *a: False)
            slow = pjpeg.decode(pjpeg.store(data))
        assert all((a.blocks == b.blocks).all() for a, b in zip(image.parts, slow.parts, strict=True))


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def done(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


CODES = {0x00: (2, 0), 0x01: (3, 2), 0x02: (3, 3), 0x03: (3, 4), 0x11: (4, 10), 0x21: (4, 11), 0x31: (4, 12), 0x10: (5, 26), 0x04: (5, 27)}


def table(kind):
    by = sorted(CODES.items(), key=lambda x: x[1])
    return pjpeg._segment(0xC4, bytes([kind] + [sum(n == k for _, (n, _) in by) for k in range(1, 17)] + [s for s, _ in by]))


def test_sparse_refined_file():
    """A grey image by the standard's coding rules: zero runs, runs of empty bands, corrections and new coefficients."""
    blocks = np.zeros((6, 64), int)
    blocks[0, [0, 1, 3, 4, 5, 7]] = 5, 3, -1, 2, 1, -3
    blocks[3, [0, 2, 5]] = -7, -2, 1
    blocks[4, [0, 1, 3]] = 2, 1, 1
    code = lambda out, s: out.put(CODES[s][1], CODES[s][0])
    dc, before = Bits(), 0
    for v in blocks[:, 0].tolist():
        step, before = v - before, v
        n = abs(step).bit_length()
        code(dc, n)
        if n:
            dc.put(step if step > 0 else step + (1 << n) - 1, n)
    high = np.trunc(blocks / 2).astype(int)
    first, empty = Bits(), 0
    for own in high:
        at = [k for k in range(1, 64) if own[k]]
        if at and empty:
            code(first, 0x10 if empty > 1 else 0x00)  # two or three empty bands, or one
            if empty > 1:
                first.put(empty - 2, 1)
            empty = 0
        for last, k in zip([0, *at], at, strict=False):
            code(first, (k - last - 1) << 4 | 1)
            first.put(int(own[k] > 0), 1)
        empty += 1
    code(first, 0x10 if empty > 1 else 0x00)
    if empty > 1:
        first.put(empty - 2, 1)
    refined = Bits()
    for own, old in zip(blocks, high, strict=True):
        held, zeros = [], 0
        for k in range(1, 64):
            if old[k]:
                held.append(abs(int(own[k])) & 1)
            elif own[k]:
                code(refined, zeros << 4 | 1)
                refined.put(int(own[k] > 0), 1)
                for bit in held:
                    refined.put(bit, 1)
                held, zeros = [], 0
            else:
                zeros += 1
        code(refined, 0x00)
        for bit in held:
            refined.put(bit, 1)
    header = b"\xff\xd8" + pjpeg._segment(0xDB, b"\x00" + b"\x02" * 64) + pjpeg._segment(0xC2, b"\x08" + (10).to_bytes(2, "big") + (20).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    scan = lambda lo, hi, a, bits: pjpeg._segment(0xDA, bytes([1, 1, 0, lo, hi, a])) + bits.done()
    image = pjpeg.decode(header + table(0x00) + table(0x10) + scan(0, 0, 0x00, dc) + scan(1, 63, 0x01, first) + scan(1, 63, 0x10, refined) + b"\xff\xd9")
    assert (image.parts[0].blocks == blocks).all()
    assert pjpeg.tensor(image).shape == (10, 20, 3)


def test_flat_colour_and_inverse_transform():
    rng = np.random.default_rng(2)
    part = pjpeg.Component(1, 1, 1, 0, 2, 2, 2, 2, rng.integers(-90, 90, (4, 64)).astype(np.int16))
    got = pjpeg._plane(part, np.full(64, 2), 0, 2)
    for b in range(4):
        own = np.zeros((8, 8))
        own.flat[pjpeg.ZIGZAG] = part.blocks[b] * 2
        c = lambda u: np.sqrt(0.5) if u == 0 else 1.0
        x, y = 3, 6
        want = 128 + sum(c(u) * c(v) * own[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4
        assert abs(got[b // 2 * 8 + y, b % 2 * 8 + x] - min(255, max(0, want))) <= 1


def test_query_columns(spark, odd, odd_rows, empty):
    rows = pjpeg.digests(pjpeg.media(odd)).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        texts = {(t or "") for i, t in odd_rows if i == r["doc_id"]}
        payloads = [t.encode() + b"\xff" * ((-len(t.encode())) % 576 or (0 if t else 576)) for t in texts]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in [(len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for p in payloads]
    assert pjpeg.digests(pjpeg.media(empty)).collect() == []
    small = make(spark, [(1, "x")])
    [t] = pjpeg.tensors(pjpeg.media(small)).collect()
    assert len(t["rgb"]) == 3 * t["height"] * t["width"]
