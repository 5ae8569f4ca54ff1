"""Progressive JPEG: a decoder for media columns, and lossless storage of bytes as coefficients.

Decoding accumulates spectral-selection and successive-approximation scans into
coefficient arrays, transforms them back in numpy, upsamples chroma and gives
full-resolution RGB tensors. Any Huffman-coded progressive file of 8-bit
samples with up to three components is read: interleaved and single scans,
end-of-band runs, refinements and restart intervals.

Storing bytes uses the format's own unit, the quantised coefficient. An AC
coefficient of magnitude category 8 has exactly 256 values, one for each byte;
DC values alternate between two ranges so that every difference has one
category too. All codes of a scan are then equally long, and its bits are
written and read as one array. Blocks are 4:2:0; the payload's length is in a
comment segment.

Defined results: a null text is the empty text, whose payload is 576 bytes of
255; a null id stays null; a text of any length is one picture, decoded some
macroblock rows at a time; equal texts give equal values; other columns, whatever
their names, don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text

UNIT = 576
#: Fixed values of the format: the zigzag order of a block's coefficients.
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
#: The cosine basis in units of 2**-13. Whole numbers in float64: sums are exact, so that no two machines differ.
_COS = np.round(8192 * np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else np.sqrt(0.125)) for x in range(8)] for u in range(8)]))
#: Macroblock rows of an image that are turned into pixels at once.
STRIP = 64


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    rows: int = 0  # blocks, with those that fill up the last macroblocks
    cols: int = 0
    own_rows: int = 0  # blocks that cover the image
    own_cols: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int16))


@dataclass
class Image:
    width: int
    height: int
    parts: list[Component]
    tables: dict[int, np.ndarray]
    comment: bytes = b""

    @property
    def per_mcu(self) -> list[tuple[int, int, int]]:
        return [(i, y, x) for i, c in enumerate(self.parts) for y in range(c.v) for x in range(c.h)]


# Bits


def _unstuffed(data: bytes) -> bytes:
    return data.replace(b"\xff\x00", b"\xff")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _packed(values: np.ndarray, width: int) -> bytes:
    """Unsigned values of `width` bits each, one after the other, padded with ones and stuffed."""
    bits = ((values.reshape(-1, 1) >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8).ravel()
    pad = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")


def _unpacked(data: bytes, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    out = np.zeros(n, np.int32)
    for i in range(width):
        out = out << 1 | bits[:, i]
    return out


class _Bits:
    """Bit by bit, for scans whose codes differ in length."""

    def __init__(self, data: bytes):
        self._bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def bit(self) -> int:
        self.at += 1
        return self._bits[self.at - 1] if self.at <= len(self._bits) else 1

    def take(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bit()
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such Huffman code")

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


# Storing bytes


def store(payload: bytes) -> bytes:
    """A progressive 4:2:0 file whose coefficients are the bytes of payload; its length is a multiple of 64."""
    n = len(payload) // 64
    mcus = -(-n // 6)
    across = int(np.ceil(np.sqrt(mcus)))
    down = -(-mcus // across)
    data = np.full(across * down * 6 * 64, 128, np.int16)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    data = data.reshape(-1, 6, 64)
    dc, ac = data[:, :, 0].astype(np.int32), data[:, :, 1:].astype(np.int32)
    wave = np.empty_like(dc)  # each component's DC values alternate between -767..-512 and 0..255
    for i, own in enumerate((slice(0, 4), slice(4, 5), slice(5, 6))):
        turn = np.arange(dc[:, own].size).reshape(dc[:, own].shape) & 1
        wave[:, own] = dc[:, own] - 767 * (1 - turn)

    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload)))]
    out.append(_segment(0xDB, b"\x00" + b"\x01" * 64))
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))

    def scan(parts: list[int], lo: int, hi: int, old: int, new: int, symbol: int | None, bits: bytes) -> None:
        if symbol is not None:  # one code, of one bit
            out.append(_segment(0xC4, bytes([0x10 if lo else 0x00, 1] + [0] * 15 + [symbol])))
        out.append(_segment(0xDA, bytes([len(parts), *(x for p in parts for x in (p, 0)), lo, hi, old << 4 | new])) + bits)

    # DC with one bit less, in macroblock order; then the bit.
    half = wave >> 1
    steps = np.empty_like(half)
    for own in (slice(0, 4), slice(4, 5), slice(5, 6)):
        steps[:, own] = np.diff(half[:, own].ravel(), prepend=0).reshape(half[:, own].shape)
    scan([1, 2, 3], 0, 0, 0, 1, 9, _packed(np.where(steps < 0, steps + 511, steps), 10))
    # AC: the low bit of the magnitude is the refinement.
    magnitude = np.where(ac < 128, 255 - ac, ac)
    first = np.where(ac < 128, 127 - (magnitude >> 1), magnitude >> 1)
    low = (magnitude & 1).astype(np.uint8)
    order = _rows_of_luma(across, down)
    planes = [(1, first[:, :4].reshape(-1, 63)[order], low[:, :4].reshape(-1, 63)[order]), (2, first[:, 4], low[:, 4]), (3, first[:, 5], low[:, 5])]
    for part, values, _ in planes:
        for lo, hi in ((1, 5), (6, 63)) if part == 1 else ((1, 63),):
            scan([part], lo, hi, 0, 1, 7, _packed(values[:, lo - 1 : hi], 8))
    scan([1, 2, 3], 0, 0, 1, 0, None, _packed(wave & 1, 1))
    for part, _, bits in planes:
        scan([part], 1, 63, 1, 0, 0, _packed(np.concatenate([np.zeros((len(bits), 1), np.uint8), bits], 1), 1))
    return b"".join([*out, b"\xff\xd9"])


def _rows_of_luma(across: int, down: int) -> np.ndarray:
    """For each luma block in rows of the image, its place in macroblock order."""
    return np.arange(across * down * 4).reshape(down, across, 2, 2).transpose(0, 2, 1, 3).ravel()


# Decoding


def decode(data: bytes) -> Image:
    """Coefficients of a progressive file, all scans accumulated."""
    image, codes, single, at, interval = Image(0, 0, [], {}), {}, {}, 2, 0
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.tables[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts, rest, code, own = body[1:17], body[17:], 0, {}
                for n, count in enumerate(counts, 1):
                    for _ in range(count):
                        own[n, code] = rest[len(own)]
                        code += 1
                    code <<= 1
                codes[body[0]] = own
                single[body[0]] = next(iter(own.values())) if list(own) == [(1, 0)] else None
                body = rest[len(own) :]
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            image.parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            wide, tall = max(c.h for c in image.parts), max(c.v for c in image.parts)
            for c in image.parts:
                c.cols, c.rows = -(-image.width // (8 * wide)) * c.h, -(-image.height // (8 * tall)) * c.v
                c.own_cols, c.own_rows = -(-image.width * c.h // (8 * wide)), -(-image.height * c.v // (8 * tall))
                c.blocks = np.zeros((c.rows * c.cols, 64), np.int16)
        elif marker in (0xC0, 0xC1):
            raise ValueError("not a progressive file")
        elif marker == 0xDA:
            end = at
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            n = body[0]
            parts = [next(c for c in image.parts if c.ident == body[1 + 2 * i]) for i in range(n)]
            lo, hi, old, new = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            chosen = [body[2 + 2 * i] for i in range(n)]
            _scan(image, parts, chosen, lo, hi, old, new, codes, single, data[at:end], interval)
            at = end


def _order(image: Image, parts: list[Component]) -> list[np.ndarray]:
    """For each component of a scan, its blocks' places in the order of the scan."""
    if len(parts) == 1:
        c = parts[0]
        return [(np.arange(c.own_rows)[:, None] * c.cols + np.arange(c.own_cols)).ravel()]
    return [np.arange(c.rows * c.cols).reshape(c.rows // c.v, c.v, c.cols // c.h, c.h).transpose(0, 2, 1, 3).ravel() for c in parts]


def _scan(image: Image, parts: list[Component], chosen: list[int], lo: int, hi: int, old: int, new: int, codes: dict, single: dict, data: bytes, interval: int) -> None:
    places = _order(image, parts)
    per = [c.h * c.v if len(parts) > 1 else 1 for c in parts]
    if not interval and _even_scan(parts, places, per, chosen, lo, hi, old, new, single, data):
        return
    cuts, start, at = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0:
        if data[at + 1]:
            cuts.append(data[start:at])
            start = at + 2
        at += 2
    streams = iter([*cuts, data[start:]])
    units = len(places[0]) // per[0]
    for first in range(0, units, interval or units or 1):
        bits, run, before = _Bits(_unstuffed(next(streams))), 0, [0] * len(parts)
        for unit in range(first, min(units, first + (interval or units))):
            for i, c in enumerate(parts):
                for place in places[i][unit * per[i] : (unit + 1) * per[i]]:
                    block = c.blocks[place]
                    if lo == 0 and old:
                        block[0] |= bits.bit() << new
                    elif lo == 0:
                        before[i] += bits.signed(bits.symbol(codes[chosen[i] >> 4]))
                        block[0] = before[i] << new
                    elif old:
                        run = _refine(bits, codes[0x10 | chosen[i] & 15], block, lo, hi, new, run)
                    else:
                        run = _first(bits, codes[0x10 | chosen[i] & 15], block, lo, hi, new, run)


def _first(bits: _Bits, codes: dict, block: np.ndarray, lo: int, hi: int, new: int, run: int) -> int:
    if run:
        return run - 1
    k = lo
    while k <= hi:
        zeros, size = divmod(bits.symbol(codes), 16)
        if size:
            k += zeros
            block[k] = bits.signed(size) * (1 << new)
            k += 1
        elif zeros == 15:
            k += 16
        else:
            return (1 << zeros) + bits.take(zeros) - 1
    return 0


def _refine(bits: _Bits, codes: dict, block: np.ndarray, lo: int, hi: int, new: int, run: int) -> int:
    def correct(k: int) -> None:
        if bits.bit() and not abs(int(block[k])) >> new & 1:
            block[k] += (1 << new) if block[k] > 0 else -(1 << new)

    k = lo
    if not run:
        while k <= hi:
            zeros, size = divmod(bits.symbol(codes), 16)
            if not size and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            value = (1 if bits.bit() else -1) << new if size else 0
            while k <= hi:
                if block[k]:
                    correct(k)
                elif zeros == 0:
                    break
                else:
                    zeros -= 1
                k += 1
            if value and k <= hi:
                block[k] = value
            k += 1
    if run:
        for at in range(k, hi + 1):
            if block[at]:
                correct(at)
        return run - 1
    return 0


def _even_scan(parts: list[Component], places: list[np.ndarray], per: list[int], chosen: list[int], lo: int, hi: int, old: int, new: int, single: dict, data: bytes) -> bool:
    """Reads a scan whose codes are all equally long as one array; False if it isn't one."""
    data = _unstuffed(data)
    units, each = len(places[0]) // per[0], sum(per)
    if lo == 0:
        symbols = {single.get(t >> 4) for t in chosen}
        if old:
            got = _unpacked(data, 1, units * each)
        elif len(symbols) == 1 and (size := symbols.pop()):
            got = _unpacked(data, 1 + size, units * each)
            got = np.where(got >> (size - 1) & 1, got, got - (1 << size) + 1)
        else:
            return False
        got, at = got.reshape(units, each), 0
        for c, place, n in zip(parts, places, per, strict=True):
            own = got[:, at : at + n].ravel()
            if old:
                c.blocks[place, 0] |= (own << new).astype(np.int16)
            else:
                c.blocks[place, 0] = np.cumsum(own) << new
            at += n
        return True
    c, place, size = parts[0], places[0], single.get(0x10 | chosen[0] & 15)
    width = hi - lo + 1
    if size is None:
        return False
    if not old and 0 < size < 16:  # no run of zeros, one category
        if len(data) * 8 < len(place) * width * (1 + size):
            return False
        got = _unpacked(data, 1 + size, len(place) * width)
        got = np.where(got >> (size - 1) & 1, got, got - (1 << size) + 1).reshape(len(place), width)
        c.blocks[place, lo : hi + 1] = got * (1 << new)
        return True
    held = c.blocks[place, lo : hi + 1]
    if old and size == 0 and (held != 0).all():  # an end of band, then a bit for each coefficient
        got = _unpacked(data, 1 + width, len(place)) if width < 31 else np.unpackbits(np.frombuffer(data, np.uint8), count=len(place) * (1 + width)).reshape(len(place), 1 + width)[:, 1:]
        if width < 31:
            got = got[:, None] >> np.arange(width - 1, -1, -1) & 1
        c.blocks[place, lo : hi + 1] += (np.sign(held) * got * (1 << new)).astype(np.int16)
        return True
    return False


def payload(image: Image) -> bytes:
    """The bytes that store() put into the coefficients."""
    n = struct.unpack(">Q", image.comment)[0]
    luma, *chroma = image.parts
    order = np.argsort(_rows_of_luma(luma.cols // 2, luma.rows // 2))
    blocks = np.concatenate([luma.blocks[order].reshape(-1, 4, 64), *(c.blocks.reshape(-1, 1, 64) for c in chroma)], 1)
    out = np.where(blocks > 0, blocks, blocks + 255)
    for own in (slice(0, 4), slice(4, 5), slice(5, 6)):
        dc = blocks[:, own, 0]
        turn = np.arange(dc.size).reshape(dc.shape) & 1
        out[:, own, 0] = dc + 767 * (1 - turn)
    return out.astype(np.uint8).tobytes()[:n]


def _plane(c: Component, table: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Samples of block rows lo to hi, level-shifted and clipped; all arithmetic is in whole numbers."""
    own = c.blocks[lo * c.cols : hi * c.cols]
    square = np.zeros((len(own), 64))
    square[:, ZIGZAG] = own * table
    square = square.reshape(-1, 8, 8)
    pixels = np.floor((_COS.T @ square @ _COS + (1 << 25)) / (1 << 26)) + 128
    pixels = np.clip(pixels, 0, 255).astype(np.int32)
    return pixels.reshape(hi - lo, c.cols, 8, 8).transpose(0, 2, 1, 3).reshape((hi - lo) * 8, c.cols * 8)


def strips(image: Image) -> Iterator[np.ndarray]:
    """Full-resolution RGB tensors (rows, width, 3) of uint8, some macroblock rows at a time."""
    wide, tall = max(c.h for c in image.parts), max(c.v for c in image.parts)
    for lo in range(0, -(-image.height // (8 * tall)), STRIP):
        planes = []
        for c in image.parts:
            hi = min(c.rows, (lo + STRIP) * c.v)
            own = _plane(c, image.tables[c.table], lo * c.v, hi)
            planes.append(own.repeat(tall // c.v, 0).repeat(wide // c.h, 1))
        rows = min(image.height - lo * 8 * tall, len(planes[0]))
        y, cb, cr = (p[:rows, : image.width] for p in (planes if len(planes) == 3 else [planes[0], np.full_like(planes[0], 128), np.full_like(planes[0], 128)]))
        cb, cr = cb - 128, cr - 128
        # 1.402, 0.344136, 0.714136 and 1.772 in units of 2**-16.
        rgb = np.stack([y + (91881 * cr + 32768 >> 16), y - (22554 * cb + 46802 * cr + 32768 >> 16), y + (116130 * cb + 32768 >> 16)], -1)
        yield np.clip(rgb, 0, 255).astype(np.uint8)


def tensor(image: Image) -> np.ndarray:
    return np.concatenate(list(strips(image)))


def features(image: Image) -> str:
    """Width, height, and for each colour the sum, the sum of squares and the sum of steps to the right."""
    sums = np.zeros((3, 3), np.int64)
    for rgb in strips(image):
        own = rgb.astype(np.int64)
        sums += own.sum((0, 1)), (own * own).sum((0, 1)), np.abs(np.diff(own, axis=1)).sum((0, 1))
    return f"{image.width}x{image.height}:" + ",".join(map(str, sums.T.ravel()))


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as a progressive JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text.encode() for text in batch.column(1).to_pylist()]
            files = [store(t + b"\xff" * ((-len(t)) % UNIT or (0 if t else UNIT))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def tensors(files: DataFrame) -> DataFrame:
    """(doc_id, height, width, rgb): full-resolution tensors of a media column, rows of RGB bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rgb = tensor(decode(data))
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([rgb.shape[0]], pa.int32()), pa.array([rgb.shape[1]], pa.int32()), pa.array([rgb.tobytes()], pa.binary())], names=["doc_id", "height", "width", "rgb"])

    return files.select("doc_id", "media").mapInArrow(run, "doc_id long, height int, width int, rgb binary")


def digests(files: DataFrame) -> DataFrame:
    """What a media column holds: the payload and the picture are both read from the stored bytes."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                image = decode(data)
                back = payload(image)
                rows.append((len(back), sha256(back).hexdigest(), crc32(back[-32:]), len(data), sha256(data).hexdigest(), features(image)))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
