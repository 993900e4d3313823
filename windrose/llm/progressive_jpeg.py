"""Media columns: JPEG files, progressive ones above all, decoded to full-resolution RGB tensors.

Every scan adds to one coefficient array per component: spectral selection fills bands of coefficients, successive
approximation first their high bits and then one bit a scan. When the file ends the arrays are dequantised,
inverse-transformed at once in numpy, chroma is repeated up to full resolution, and colours are converted.
``encode`` makes progressive files (ten scans, 4:2:0) for tests and for tables without media of their own.

Read: SOF0, SOF1 and SOF2 of 8 bits, one to four components, any sampling factors, restart intervals, 8- and 16-bit
quantisers; JFIF YCbCr, Adobe RGB, grey. CMYK, arithmetic coding and lossless files are reported as errors.

Defined cases: a null or empty file gives a null tensor and the error "no data"; a broken or truncated one a null tensor and
what was wrong. Memory is taken for coefficients only once a scan has a bit for every block, so a short file that claims to be a large picture is an error
at once; a picture whose tensor would be 2 GiB or more, which no row can hold, is an error too. Tensors are handed on about 64 MB at a time. Rows that
repeat are decoded each; an empty table gives an empty one; input columns are passed on, but for those called ``width height rgb error``, which are replaced.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from windrose.llm._common import col, mapped, others

ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
_N = np.arange(8)
_DCT = np.cos((2 * _N[None, :] + 1) * _N[:, None] * np.pi / 16) * np.where(_N[:, None] == 0, np.sqrt(1 / 8), 0.5)
#: Bytes of a row's tensor: what an Arrow column of binaries can hold.
MOST_BYTES = (1 << 31) - 1
#: Bytes of tensors that are handed on together.
_TOGETHER = 64 << 20


class BadImage(ValueError):
    """The file can't be decoded."""


@lru_cache(maxsize=256)
def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """By the next 16 bits: code length << 8 | symbol, or 0."""
    table, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            low = code << (16 - length)
            if low + (1 << (16 - length)) > 1 << 16 or at >= len(symbols):
                raise BadImage("bad Huffman table")
            table[low : low + (1 << (16 - length))] = length << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table.tolist()


class _Bits:
    """Bits of one entropy-coded segment."""

    __slots__ = ("data", "at", "end")

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data + b"\0\0\0\0", 0, 8 * len(data)

    def take(self, n: int) -> int:
        if not n:
            return 0
        at, d = self.at, self.data
        self.at = at + n
        if self.at > self.end:
            raise BadImage("truncated scan")
        i = at >> 3
        return ((d[i] << 16 | d[i + 1] << 8 | d[i + 2]) >> (24 - (at & 7) - n)) & ((1 << n) - 1)

    def symbol(self, table: list[int]) -> int:
        at, d = self.at, self.data
        i = at >> 3
        if at >= self.end:
            raise BadImage("truncated scan")
        found = table[((d[i] << 16 | d[i + 1] << 8 | d[i + 2]) >> (8 - (at & 7))) & 0xFFFF]
        if not found:
            raise BadImage("bad Huffman code")
        self.at = at + (found >> 8)
        return found & 255

    def signed(self, n: int) -> int:
        if not n:
            return 0
        v = self.take(n)
        return v if v >> (n - 1) else v - (1 << n) + 1


class _Component:
    def __init__(self, ident: int, h: int, v: int, tq: int) -> None:
        self.ident, self.h, self.v, self.tq = ident, h, v, tq
        self.coef: array | None = None  # 64 a block; made when the first scan shows that there are data for them
        self.blocks = 0
        self.wide = self.high = self.stride = self.pred = 0


class Decoder:
    """One file; ``components`` hold the coefficient arrays after ``parse``."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.quant: dict[int, np.ndarray] = {}
        self.huff: dict[int, list[int]] = {}
        self.components: list[_Component] = []
        self.restart = self.width = self.height = 0
        self.progressive = False
        self.adobe: int | None = None
        self.eobrun = 0

    def parse(self) -> Decoder:
        data, at = self.data, 2
        if data[:2] != b"\xff\xd8":
            raise BadImage("not a JPEG file")
        scans = 0
        while True:
            while at < len(data) and data[at] != 0xFF:
                at += 1
            while at < len(data) and data[at] == 0xFF:
                at += 1
            if at >= len(data):
                raise BadImage("no end marker")
            marker, at = data[at], at + 1
            if marker == 0xD9:
                break
            if marker == 1 or 0xD0 <= marker <= 0xD7 or marker == 0:
                continue
            if at + 2 > len(data):
                raise BadImage("truncated segment")
            (length,) = struct.unpack_from(">H", data, at)
            body = data[at + 2 : at + length]
            if length < 2 or len(body) != length - 2:
                raise BadImage("truncated segment")
            at += length
            if marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC4:
                self._tables(body)
            elif marker in (0xC0, 0xC1, 0xC2):
                self._frame(body, marker == 0xC2)
            elif marker in (0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise BadImage("unsupported kind of JPEG")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.adobe = body[11]
            elif marker == 0xDA:
                at = self._scan(body, at)
                scans += 1
        if not scans:
            raise BadImage("no scan")
        return self

    def _quantisers(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, ident, at = body[at] >> 4, body[at] & 15, at + 1
            size = 128 if wide else 64
            if at + size > len(body):
                raise BadImage("truncated quantiser")
            self.quant[ident] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at).astype(np.int64)
            at += size

    def _tables(self, body: bytes) -> None:
        at = 0
        while at + 17 <= len(body):
            ident, counts = body[at], body[at + 1 : at + 17]
            self.huff[ident] = _lookup(counts, body[at + 17 : at + 17 + sum(counts)])
            at += 17 + sum(counts)

    def _frame(self, body: bytes, progressive: bool) -> None:
        if self.components:
            raise BadImage("several frames")
        bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if bits != 8 or not self.height or not self.width or n not in (1, 2, 3, 4) or len(body) < 6 + 3 * n:
            raise BadImage("unsupported frame")
        if 3 * self.width * self.height > MOST_BYTES:
            raise BadImage("a tensor of 2 GiB or more doesn't fit a row")
        self.progressive = progressive
        for k in range(n):
            ident, hv, tq = body[6 + 3 * k : 9 + 3 * k]
            if not 1 <= hv >> 4 <= 4 or not 1 <= hv & 15 <= 4:
                raise BadImage("bad sampling factors")
            self.components.append(_Component(ident, hv >> 4, hv & 15, tq))
        self.hmax, self.vmax = max(c.h for c in self.components), max(c.v for c in self.components)
        self.mcus = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c in self.components:
            c.wide = -(-(-(-self.width * c.h // self.hmax)) // 8)
            c.high = -(-(-(-self.height * c.v // self.vmax)) // 8)
            c.stride = self.mcus[0] * c.h
            c.blocks = c.stride * self.mcus[1] * c.v

    def _segments(self, at: int) -> tuple[list[bytes], int]:
        """The scan's entropy-coded segments between restart markers, and where the next marker is."""
        data, out, start = self.data, [], at
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                raise BadImage("truncated scan")
            follow = data[at + 1]
            if follow == 0:
                at += 2
            elif follow == 0xFF:
                at += 1
            elif 0xD0 <= follow <= 0xD7:
                out.append(data[start:at].replace(b"\xff\0", b"\xff"))
                start = at = at + 2
            else:
                out.append(data[start:at].rstrip(b"\xff").replace(b"\xff\0", b"\xff") if data[at - 1 : at] == b"\xff" else data[start:at].replace(b"\xff\0", b"\xff"))
                return out, at

    def _scan(self, body: bytes, at: int) -> int:
        n = body[0] if body else 0
        if len(body) < 4 + 2 * n or not 1 <= n <= 4:
            raise BadImage("bad scan")
        chosen = []
        for k in range(n):
            ident, tables = body[1 + 2 * k], body[2 + 2 * k]
            part = next((c for c in self.components if c.ident == ident), None)
            if part is None:
                raise BadImage("unknown component")
            chosen.append((part, self.huff.get(tables >> 4), self.huff.get(16 | tables & 15)))
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if not self.progressive:
            first, last, high, low = 0, 63, 0, 0
        if first > last or last > 63 or (self.progressive and first == 0 and last) or (first and n > 1):
            raise BadImage("bad spectral selection")
        segments, after = self._segments(at)
        count = chosen[0][0].wide * chosen[0][0].high if n == 1 else self.mcus[0] * self.mcus[1] * sum(c.h * c.v for c, _, _ in chosen)
        if first == 0 and not high:
            # Every block has a code of a bit at least here, so no header can claim more blocks than there are bits.
            if count > 8 * sum(map(len, segments)):
                raise BadImage("truncated scan")
            for c, _, _ in chosen:
                c.coef = array("h", bytes(128 * c.blocks))
        if any(c.coef is None for c, _, _ in chosen):
            raise BadImage("a scan before the first of its component")
        if any((dc is None and first == 0 and not high) or (ac is None and last) for _, dc, ac in chosen):
            raise BadImage("no Huffman table")
        step = self._step(first, high)
        per = self.restart * (1 if n == 1 else sum(c.h * c.v for c, _, _ in chosen)) or count
        for k, (base, (c, dc, ac)) in enumerate(self._order(chosen)):
            if k % per == 0:
                if k // per >= len(segments):
                    raise BadImage("truncated scan")
                bits, self.eobrun = _Bits(segments[k // per]), 0
                for part, _, _ in chosen:
                    part.pred = 0
            step(bits, c.coef, base, c, dc, ac, first, last, low)
        return after

    def _order(self, chosen: list) -> Iterator[tuple[int, tuple]]:
        """The scan's blocks: where their coefficients begin, and whose they are."""
        if len(chosen) == 1:
            c = chosen[0][0]
            return ((64 * (y * c.stride + x), chosen[0]) for y in range(c.high) for x in range(c.wide))
        return (
            (64 * ((my * c.v + v) * c.stride + mx * c.h + h), part)
            for my in range(self.mcus[1]) for mx in range(self.mcus[0]) for part in chosen for c in part[:1] for v in range(c.v) for h in range(c.h)
        )

    def _step(self, first: int, high: int):
        if not self.progressive:
            return self._sequential
        if first == 0:
            return self._dc_refine if high else self._dc_first
        return self._ac_refine if high else self._ac_first

    def _sequential(self, bits, coef, base, c, dc, ac, first, last, low) -> None:
        self._dc_first(bits, coef, base, c, dc, ac, 0, 0, 0)
        k = 1
        while k <= 63:
            rs = bits.symbol(ac)
            run, size = rs >> 4, rs & 15
            if not size:
                if run != 15:
                    return
                k += 16
                continue
            k += run
            if k > 63:
                raise BadImage("coefficient out of range")
            coef[base + k] = bits.signed(size)
            k += 1

    def _dc_first(self, bits, coef, base, c, dc, ac, first, last, low) -> None:
        c.pred += bits.signed(bits.symbol(dc) & 15)
        coef[base] = c.pred * (1 << low)

    def _dc_refine(self, bits, coef, base, c, dc, ac, first, last, low) -> None:
        if bits.take(1):
            coef[base] |= 1 << low

    def _ac_first(self, bits, coef, base, c, dc, ac, first, last, low) -> None:
        if self.eobrun:
            self.eobrun -= 1
            return
        k = first
        while k <= last:
            rs = bits.symbol(ac)
            run, size = rs >> 4, rs & 15
            if size:
                k += run
                if k > last:
                    raise BadImage("coefficient out of range")
                coef[base + k] = bits.signed(size) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                self.eobrun = (1 << run) - 1 + bits.take(run)
                return

    def _ac_refine(self, bits, coef, base, c, dc, ac, first, last, low) -> None:
        k, last, plus = base + first, base + last, 1 << low
        if not self.eobrun:
            while k <= last:
                rs = bits.symbol(ac)
                run, size, new = rs >> 4, rs & 15, 0
                if size:
                    new = plus if bits.take(1) else -plus
                elif run != 15:
                    self.eobrun = (1 << run) + bits.take(run)
                    break
                while k <= last:
                    v = coef[k]
                    if v:
                        if bits.take(1) and not abs(v) & plus:
                            coef[k] = v + plus if v > 0 else v - plus
                    elif run == 0:
                        if new:
                            coef[k] = new
                        k += 1
                        break
                    else:
                        run -= 1
                    k += 1
        if self.eobrun:
            while k <= last:
                v = coef[k]
                if v and bits.take(1) and not abs(v) & plus:
                    coef[k] = v + plus if v > 0 else v - plus
                k += 1
            self.eobrun -= 1

    def planes(self) -> list[np.ndarray]:
        """Full-resolution samples of every component, 0 to 255 before rounding."""
        out = []
        for c in self.components:
            if c.tq not in self.quant:
                raise BadImage("no quantiser")
            if c.coef is None:
                raise BadImage("a component without a scan")
            zigzagged = np.frombuffer(c.coef, np.int16).reshape(-1, 64) * self.quant[c.tq]
            blocks = np.zeros_like(zigzagged)
            blocks[:, ZIGZAG] = zigzagged
            pixels = _DCT.T @ blocks.reshape(-1, 8, 8) @ _DCT + 128
            rows = c.blocks // c.stride
            plane = pixels.reshape(rows, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * c.stride)
            y = np.arange(self.height) * c.v // self.vmax
            x = np.arange(self.width) * c.h // self.hmax
            out.append(np.clip(np.rint(plane), 0, 255)[y][:, x])
        return out

    def rgb(self) -> np.ndarray:
        planes = self.planes()
        if len(planes) == 1:
            return np.repeat(planes[0][..., None], 3, axis=2).astype(np.uint8)
        if len(planes) != 3:
            raise BadImage("unsupported colours")
        if self.adobe == 0 or (self.adobe is None and [c.ident for c in self.components] == [82, 71, 66]):
            return np.stack(planes, axis=2).astype(np.uint8)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        rgb = np.stack((y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb), axis=2)
        return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """The height x width x 3 tensor of a file; raises ``BadImage``."""
    try:
        return Decoder(data).parse().rgb()
    except (IndexError, struct.error, OverflowError) as broken:
        raise BadImage(f"broken file: {broken}") from broken


def decoded(files: DataFrame, *, file: str = "file") -> DataFrame:
    """``files``, all its columns, with width, height, rgb (bytes, row by row) and error."""
    names = others(files, "width", "height", "rgb", "error")
    at = names.index(file)

    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            first = size = 0

            def made() -> pa.RecordBatch:
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                own = batch.slice(first, len(rows))
                return pa.RecordBatch.from_arrays([*own.columns, *columns], [*batch.schema.names, *(f"made_{n}" for n in ("width", "height", "rgb", "error"))])

            for data in batch.column(at):
                try:
                    if not data.is_valid or not len(data.as_buffer()):
                        raise BadImage("no data")
                    pixels = decode(data.as_py())
                    row = pixels.shape[1], pixels.shape[0], pixels.tobytes(), None
                except BadImage as bad:
                    row = None, None, None, str(bad)
                if rows and size + len(row[2] or b"") > _TOGETHER:
                    yield made()
                    first, size, rows = first + len(rows), 0, []
                rows.append(row)
                size += len(row[2] or b"")
            if rows:
                yield made()

    return mapped(files.select(*map(col, names)), run, [("width", "integer"), ("height", "integer"), ("rgb", "binary"), ("error", "string")])


# Encoding: for tests, and for tables that have no media of their own.

_DC_COUNTS = bytes([0, 0, 0, 0, 16, *[0] * 11])
_DC_SYMBOLS = bytes(range(16))
_AC_COUNTS = bytes([0, 0, 0, 0, 0, 0, 0, 254, 2, *[0] * 7])
_AC_SYMBOLS = bytes(range(256))
#: (components, first, last, high, low)
SCRIPT = [
    ((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 2), ((2,), 1, 63, 0, 1), ((1,), 1, 63, 0, 1), ((0,), 6, 63, 0, 2),
    ((0,), 1, 63, 2, 1), ((0, 1, 2), 0, 0, 1, 0), ((2,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((0,), 1, 63, 1, 0),
]
LUMA = np.clip(np.rint(4 + 1.5 * np.add.outer(_N, _N)), 1, 255).astype(np.int64).ravel()[ZIGZAG]
CHROMA = np.clip(np.rint(6 + 3 * np.add.outer(_N, _N)), 1, 255).astype(np.int64).ravel()[ZIGZAG]


class _Writer:
    def __init__(self) -> None:
        self.value = self.size = 0

    def put(self, value: int, size: int) -> None:
        self.value = self.value << size | value
        self.size += size

    def ac(self, symbol: int) -> None:
        if symbol < 254:
            self.put(symbol, 8)
        else:
            self.put(508 + symbol - 254, 9)

    def bytes(self) -> bytes:
        pad = -self.size % 8
        return ((self.value << pad) | ((1 << pad) - 1)).to_bytes((self.size + pad) // 8, "big").replace(b"\xff", b"\xff\0")


def _magnitude(v: int) -> tuple[int, int]:
    size = abs(v).bit_length()
    return size, v if v >= 0 else v + (1 << size) - 1


class _AcScan:
    """Progressive AC coding of one component's blocks."""

    def __init__(self, out: _Writer, first: int, last: int, low: int) -> None:
        self.out, self.first, self.last, self.low = out, first, last, low
        self.run, self.tail = 0, []

    def flush(self) -> None:
        if self.run:
            size = self.run.bit_length() - 1
            self.out.ac(size << 4)
            self.out.put(self.run - (1 << size), size)
            self.run = 0
        for bit in self.tail:
            self.out.put(bit, 1)
        self.tail = []

    def first_pass(self, block: list[int]) -> None:
        zeros = 0
        for k in range(self.first, self.last + 1):
            v = block[k]
            v = v >> self.low if v >= 0 else -(-v >> self.low)
            if not v:
                zeros += 1
                continue
            self.flush()
            while zeros > 15:
                self.out.ac(0xF0)
                zeros -= 16
            size, bits = _magnitude(v)
            self.out.ac(zeros << 4 | size)
            self.out.put(bits, size)
            zeros = 0
        if zeros:
            self.run += 1
            if self.run == 0x7FFF:
                self.flush()

    def refine(self, block: list[int]) -> None:
        shifted = [abs(block[k]) >> self.low for k in range(64)]
        end = max((k for k in range(self.first, self.last + 1) if shifted[k] == 1), default=-1)
        zeros, held = 0, []
        for k in range(self.first, self.last + 1):
            v = shifted[k]
            if not v:
                zeros += 1
                continue
            while zeros > 15 and k <= end:
                self.flush()
                self.out.ac(0xF0)
                zeros -= 16
                for bit in held:
                    self.out.put(bit, 1)
                held = []
            if v > 1:
                held.append(v & 1)
                continue
            self.flush()
            self.out.ac(zeros << 4 | 1)
            self.out.put(int(block[k] > 0), 1)
            for bit in held:
                self.out.put(bit, 1)
            zeros, held = 0, []
        if zeros or held:
            self.run += 1
            self.tail += held
            if self.run == 0x7FFF or len(self.tail) > 900:
                self.flush()


def coefficients(pixels: np.ndarray) -> list[tuple[list[list[int]], int, int, int]]:
    """Quantised zigzag blocks of Y, Cb and Cr at 4:2:0: (blocks, blocks a row, blocks wide, blocks high)."""
    height, width = pixels.shape[:2]
    mx, my = -(-width // 16), -(-height // 16)
    padded = np.pad(pixels.astype(np.float64), ((0, 16 * my - height), (0, 16 * mx - width), (0, 0)), mode="edge")
    r, g, b = padded[..., 0], padded[..., 1], padded[..., 2]
    planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168735892 * r - 0.331264108 * g + 0.5 * b, 128 + 0.5 * r - 0.418687589 * g - 0.081312411 * b]
    out = []
    for k, plane in enumerate(planes):
        if k:
            plane = plane.reshape(8 * my, 2, 8 * mx, 2).mean(axis=(1, 3))
        rows, stride = plane.shape[0] // 8, plane.shape[1] // 8
        blocks = (plane - 128).reshape(rows, 8, stride, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        spectrum = (_DCT @ blocks @ _DCT.T).reshape(-1, 64)[:, ZIGZAG]
        quantised = np.rint(spectrum / (CHROMA if k else LUMA)).astype(np.int64)
        half = 2 if k else 1
        out.append((quantised.tolist(), stride, -(-(-(-width // half)) // 8), -(-(-(-height // half)) // 8)))
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(pixels: np.ndarray, restart: int = 0) -> bytes:
    """A progressive 4:2:0 file of a height x width x 3 tensor; ``restart``: MCUs between restart markers."""
    height, width = pixels.shape[:2]
    planes = coefficients(pixels)
    mx, my = -(-width // 16), -(-height // 16)
    file = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    file.append(_segment(0xDB, b"\0" + bytes(LUMA.tolist()) + b"\1" + bytes(CHROMA.tolist())))
    file.append(_segment(0xC2, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])))
    file.append(_segment(0xC4, b"\0" + _DC_COUNTS + _DC_SYMBOLS + b"\x10" + _AC_COUNTS + _AC_SYMBOLS))
    if restart:
        file.append(_segment(0xDD, struct.pack(">H", restart)))
    for parts, first, last, high, low in SCRIPT:
        file.append(_segment(0xDA, bytes([len(parts), *(x for c in parts for x in (c + 1, 0)), first, last, high << 4 | low])))
        if len(parts) > 1:
            mcus = []
            for y in range(my):
                for x in range(mx):
                    luma, stride = planes[0][:2]
                    mcus.append([(0, luma[(2 * y + v) * stride + 2 * x + h]) for v in (0, 1) for h in (0, 1)] + [(c, planes[c][0][y * mx + x]) for c in (1, 2)])
        else:
            blocks, stride, wide, tall = planes[parts[0]]
            mcus = [[(parts[0], blocks[y * stride + x])] for y in range(tall) for x in range(wide)]
        per = restart or len(mcus)
        for nth, begin in enumerate(range(0, len(mcus), per)):
            out, pred = _Writer(), [0, 0, 0]
            ac = _AcScan(out, first, last, low)
            for mcu in mcus[begin : begin + per]:
                for c, block in mcu:
                    if first:
                        (ac.refine if high else ac.first_pass)(block)
                    elif high:
                        out.put(block[0] >> low & 1, 1)
                    else:
                        value = block[0] >> low
                        size, bits = _magnitude(value - pred[c])
                        pred[c] = value
                        out.put(size, 5)
                        out.put(bits, size)
            ac.flush()
            file.append((b"\xff" + bytes([0xD0 + (nth - 1) % 8]) if nth else b"") + out.bytes())
    return b"".join([*file, b"\xff\xd9"])


def thumbnail(vector: list[float], nth: int) -> np.ndarray:
    """A picture of a vector: its values, scaled to 0..255, as a square of grey steps in red, mirrored in green and blue; 17 to 24 wide, 16 to 20 high."""
    values = np.nan_to_num(np.asarray(vector, np.float64))
    side = max(1, int(np.ceil(np.sqrt(len(values)))))
    grid = np.zeros(side * side)
    low, high = (values.min(), values.max()) if len(values) else (0.0, 0.0)
    grid[: len(values)] = (values - low) / (high - low or 1.0) * 255
    grid = grid.reshape(side, side)
    height, width = 16 + nth % 5, 17 + nth % 8
    y, x = np.arange(height) * side // height, np.arange(width) * side // width
    return np.stack([plane[y][:, x] for plane in (grid, grid.T, grid[::-1])], axis=2).astype(np.uint8)


def thumbnails(vectors: DataFrame, *, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, file): a progressive JPEG of every vector; a null vector has a null file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            files = [None if v is None else encode(thumbnail([x if x is not None else 0.0 for x in v], i or 0)) for i, v in zip(ids, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], [ident, "file"])

    return vectors.select(col(ident).cast("bigint").alias(ident), col(vector).alias(vector)).mapInArrow(run, f"`{ident}` bigint, file binary")
