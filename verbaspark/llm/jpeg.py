"""Progressive JPEG: scans are gathered into coefficient arrays, then transformed to RGB with numpy.

``decode`` reads any Huffman-coded progressive file (SOF2, 8 bits, one or three components, restart intervals):
spectral selection and successive approximation, first passes and refinements. Three kinds of data are taken by
whole arrays: refinements of DC, runs of blocks that hold correction bits only, and first passes whose table has
one symbol, so that all coefficients have codes of one length. All else goes coefficient by coefficient.

``encode`` writes coefficients the other way about. Most of a payload lies in magnitudes 128 to 255 only, in scans that this
makes cheap; the upper band of the last component holds signed values around zero, in scans with run lengths, ends of bands and
refinements that bring new coefficients, as files of other writers have.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
import struct
from dataclasses import dataclass, field

import numpy as np

_MARKER = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]")
_RESTART = re.compile(rb"\xff+[\xd0-\xd7]")


@functools.cache
def zigzag() -> np.ndarray:
    """Natural place (8 * row + column) of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


@functools.cache
def basis() -> np.ndarray:
    """Row k: what zigzag coefficient k adds to the 64 samples, times 65536, rounded; sums are exact in doubles."""
    k = np.arange(8)
    cosines = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    full = np.einsum("xu,yv->uvxy", cosines, cosines).reshape(64, 64)
    return np.rint(full[zigzag()] * 65536)


@functools.lru_cache(64)
def scaled(quant: bytes) -> np.ndarray:
    """The basis for coefficients that are still to be multiplied by 64 steps of eight bytes each; sums stay exact."""
    return basis() * np.frombuffer(quant, np.int64)[:, None]


@functools.lru_cache(256)
def lookup(spec: bytes) -> tuple[list[int], list[tuple[int, int]]]:
    """(length << 8 | symbol) for each 16 bits that may come next, and the table's (length, symbol) pairs."""
    table = np.zeros(1 << 16, np.int32)
    code, at, pairs = 0, 16, []
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            first = code << (16 - length)
            table[first : first + (1 << (16 - length))] = length << 8 | spec[at]
            pairs.append((length, spec[at]))
            code += 1
            at += 1
        code <<= 1
    return table.tolist(), pairs


@functools.lru_cache(16)
def differences(spec: bytes) -> list[int]:
    """For each 16 bits that may come next, code and value at once: (value + 65536) << 8 | length of both; 0 where they are longer."""
    table = np.array(lookup(spec)[0])
    size = table & 255
    total = np.where(table, (table >> 8) + size, 17)
    size = np.where(total <= 16, size, 0)
    value = np.arange(1 << 16) >> np.maximum(16 - total, 0) & (1 << size) - 1
    value -= np.where(value >> np.maximum(size - 1, 0), 0, (1 << size) - 1)
    return np.where(total <= 16, value + 65536 << 8 | total, 0).tolist()


@functools.lru_cache(64)
def magnitudes(size: int, low: int) -> np.ndarray:
    """What a byte gives whose last ``size`` bits are a coefficient's."""
    value = np.arange(256, dtype=np.int32) & (1 << size) - 1
    return np.where(value >> (size - 1), value, value - (1 << size) + 1).astype(np.int32) * (1 << low)


class Bits:
    """Reads bits of one restart interval."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff") if b"\xff" in data else data
        self.padded = self.data + bytes(4)
        self.at = 0

    def symbol(self, table: list[int]) -> int:
        b, i = self.padded, self.at >> 3
        if i > len(self.data):
            raise ValueError("the scan's data end too early")
        got = table[(b[i] << 16 | b[i + 1] << 8 | b[i + 2]) >> (8 - (self.at & 7)) & 0xFFFF]
        if not got:
            raise ValueError("no such code")
        self.at += got >> 8
        return got & 255

    def take(self, n: int) -> int:
        if not n:
            return 0
        b, i = self.padded, self.at >> 3
        got = (b[i] << 16 | b[i + 1] << 8 | b[i + 2]) >> (24 - n - (self.at & 7)) & ((1 << n) - 1) if n + (self.at & 7) <= 24 else 0
        self.at += n
        return got

    def word(self, n: int) -> int:
        """The next n bits as a number, however many."""
        end = self.at + n
        if end > 8 * len(self.padded):
            raise ValueError("the scan's data end too early")
        got = int.from_bytes(self.padded[self.at >> 3 : (end + 7) >> 3], "big") >> (-end & 7) & (1 << n) - 1
        self.at = end
        return got

    def many(self, n: int) -> np.ndarray:
        """The next n bits as an array."""
        first = self.at >> 3
        raw = np.frombuffer(self.data, np.uint8)[first : (self.at + n + 7) >> 3]
        bits = np.unpackbits(raw)[self.at & 7 :][:n]
        if len(bits) < n:
            raise ValueError("the scan's data end too early")
        self.at += n
        return bits


@dataclass
class Component:
    h: int
    v: int
    quant: int
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))
    shown: tuple[int, int] = (0, 0)
    order: np.ndarray | None = None


@dataclass
class Image:
    width: int
    height: int
    components: dict[int, Component]
    quants: dict[int, np.ndarray]
    comment: bytes


#: Pixels of an image that is decoded, at most: a header can claim four thousand million.
MOST_PIXELS = 1 << 25


def coefficients(data: bytes, most: int = MOST_PIXELS) -> Image:
    """All coefficients of a progressive file, in zigzag order by block. Beyond ``most`` pixels it is an error."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, quants, tables, image, comment, interval = 2, {}, {}, None, b"", 0
    while True:
        while data[at + 1 : at + 2] == b"\xff":
            at += 1
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide, name = body[i] >> 4, body[i] & 15
                quants[name] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1).astype(np.int64)
                i += 129 if wide else 65
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = 16 + sum(body[i + 1 : i + 17])
                tables[body[i]] = body[i + 1 : i + 1 + n]
                i += 1 + n
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            image = _frame(body, quants, most)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a progressive Huffman-coded file")
        elif marker == 0xDA:
            if image is None:
                raise ValueError("a scan before the frame")
            found = _MARKER.search(data, at)
            if not found:
                raise ValueError("no end of the image")
            piece = data[at : found.start()]
            _scan(image, body, _RESTART.split(piece) if b"\xff" in piece else [piece], tables, interval)
            at = found.end() - 2
    if image is None:
        raise ValueError("no frame")
    image.comment = comment
    return image


def _frame(body: bytes, quants: dict[int, np.ndarray], most: int) -> Image:
    depth, height, width, n = struct.unpack_from(">BHHB", body)
    if depth != 8 or n not in (1, 3) or not width or not height:
        raise ValueError("a kind of image that is not supported")
    if width * height > most:
        raise ValueError("an image of too many pixels")
    parts = {body[6 + 3 * k]: Component(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
    if len(parts) != n or not all(1 <= c.h <= 4 and 1 <= c.v <= 4 for c in parts.values()):
        raise ValueError("wrong components")
    h, v = max(c.h for c in parts.values()), max(c.v for c in parts.values())
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    for c in parts.values():
        c.blocks = np.zeros((down * c.v, across * c.h, 64), np.int32)
        c.shown = (-(-(-(-height * c.v // v)) // 8), -(-(-(-width * c.h // h)) // 8))
    return Image(width, height, parts, quants, b"")


def _scan(image: Image, body: bytes, pieces: list[bytes], tables: dict[int, bytes], interval: int) -> None:
    n = body[0]
    parts = []
    for k in range(n):
        c = image.components[body[1 + 2 * k]]
        names = body[2 + 2 * k]
        parts.append((c, tables.get(names >> 4), tables.get(16 | names & 15)))
    first, last, bits = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
    high, low = bits >> 4, bits & 15
    if n > 1 and first:
        raise ValueError("an interleaved scan of AC coefficients")
    if n == 1:
        c = parts[0][0]
        rows, cols = c.shown
        whole = cols == c.blocks.shape[1]
        blocks = c.blocks[:rows].reshape(-1, 64) if whole else c.blocks[:rows, :cols].reshape(-1, 64)  # a view, or a copy
        order = None
        units = rows * cols
    else:
        counts = [c.h * c.v for c, _, _ in parts]
        order = [_mcu_order(c) for c, _, _ in parts]
        units = len(order[0]) // counts[0]
    step = interval or units
    for k, start in enumerate(range(0, units, step)):
        reader = Bits(pieces[k] if k < len(pieces) else b"")
        end = min(units, start + step)
        if n == 1 and first:
            (_ac_refine if high else _ac_first)(reader, blocks[start:end], first, last, low, parts[0][2])
        elif n == 1:
            _dc(reader, [(blocks[:, 0], np.arange(start, end), 1, parts[0][1])], end - start, high, low)
        else:
            _dc(reader, [(c.blocks.reshape(-1, 64)[:, 0], o[start * m : end * m], m, t) for (c, t, _), o, m in zip(parts, order, counts, strict=True)], end - start, high, low)
    if n == 1 and not whole:
        parts[0][0].blocks[:rows, :cols] = blocks.reshape(rows, cols, 64)


def _mcu_order(c: Component) -> np.ndarray:
    if c.order is None:
        rows, cols = c.blocks.shape[:2]
        c.order = np.arange(rows * cols)
        if c.h > 1 or c.v > 1:
            c.order = c.order.reshape(rows // c.v, c.v, cols // c.h, c.h).transpose(0, 2, 1, 3).ravel()
    return c.order


def _dc(reader: Bits, parts: list[tuple], units: int, high: int, low: int) -> None:
    """parts: for each component its DC column, the blocks in the scan's order, how many a unit has, its table."""
    if high:
        bits = reader.many(units * sum(p[2] for p in parts)).reshape(units, -1).astype(np.int32)
        at = 0
        for column, order, m, _ in parts:
            column[order] |= bits[:, at : at + m].reshape(-1) << low
            at += m
        return
    tables = [differences(p[3]) for p in parts]
    values: list[list[int]] = [[] for _ in parts]
    last = [0] * len(parts)
    plan = [(k, tables[k], values[k].append) for k, p in enumerate(parts) for _ in range(p[2])]
    b, at, n = reader.padded, reader.at, len(reader.data)
    for _ in range(units):
        for k, table, append in plan:
            i = at >> 3
            if i > n:
                raise ValueError("the scan's data end too early")
            both = table[(b[i] << 16 | b[i + 1] << 8 | b[i + 2]) >> (8 - (at & 7)) & 0xFFFF]
            if both:
                at += both & 255
                last[k] += (both >> 8) - 65536
            else:
                reader.at = at
                size = reader.symbol(lookup(parts[k][3])[0])
                if size > 16:
                    raise ValueError("a difference of too many bits")
                v = reader.take(size)
                last[k] += v if v >> (size - 1) else v - (1 << size) + 1
                at = reader.at
            append(last[k])
    reader.at = at
    for k, (column, order, _, _) in enumerate(parts):
        column[order] = np.array(values[k], np.int32) << low


def _ac_first(reader: Bits, blocks: np.ndarray, first: int, last: int, low: int, spec: bytes) -> None:
    table, pairs = lookup(spec)
    if len(pairs) == 1 and 0 < pairs[0][1] < 16:
        length, size = pairs[0]
        each, n = length + size, blocks.shape[0] * (last - first + 1)
        if each == 8 and not reader.at and len(reader.data) >= n:
            value = magnitudes(size, low).take(np.frombuffer(reader.data, np.uint8, n))
        else:
            value = reader.many(n * each).reshape(n, each)[:, length:] @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
            value = np.where(value >> (size - 1), value, value - (1 << size) + 1) * (1 << low)
        blocks[:, first : last + 1] = value.reshape(blocks.shape[0], -1)
        return
    run, symbol, take = 0, reader.symbol, reader.take
    for b in range(len(blocks)):
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            code = symbol(table)
            r, size = code >> 4, code & 15
            if size:
                k += r
                if k > last:
                    raise ValueError("a run beyond the band")
                v = take(size)
                blocks[b, k] = (v if v >> (size - 1) else v - (1 << size) + 1) * (1 << low)
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) - 1 + take(r)
                break


def _correct_row(reader: Bits, row: list[int], known: list[int], one: int) -> None:
    """One correction bit for each of the places ``known``."""
    bits = reader.word(len(known))
    if bits:
        for k in reversed(known):
            v = row[k]
            if bits & 1 and not v & one:
                row[k] = v + one if v > 0 else v - one
            bits >>= 1


def _correct(reader: Bits, part: np.ndarray, low: int) -> None:
    """One correction bit for each coefficient that is not zero."""
    if part.size <= 64:  # too few for array operations to pay
        rows = part.tolist()
        known = [[k for k, v in enumerate(row) if v] for row in rows]
        if reader.at + sum(map(len, known)) > 8 * len(reader.data):
            raise ValueError("the scan's data end too early")
        for row, places in zip(rows, known, strict=True):
            _correct_row(reader, row, places, 1 << low)
        part[...] = rows
        return
    if part.all():
        step = reader.many(part.size).reshape(part.shape).astype(np.int32) << low
        step &= ~part
        sign = part >> 31
        step ^= sign
        step -= sign
        part += step
        return
    at = np.nonzero(part)
    if not len(at[0]):
        return
    value = part[at]
    part[at] = value + np.where(reader.many(len(value)) & ((value & (1 << low)) == 0), np.where(value > 0, 1 << low, -(1 << low)), 0)


def _ac_refine(reader: Bits, blocks: np.ndarray, first: int, last: int, low: int, spec: bytes) -> None:
    table, symbol, take = lookup(spec)[0], reader.symbol, reader.take
    band, wide = blocks[:, first : last + 1], last + 1 - first
    one, b = 1 << low, 0
    while b < len(band):
        k, run, row = 0, 0, None
        while k < wide:
            code = symbol(table)
            r, size = code >> 4, code & 15
            if not size and r < 15:
                run = (1 << r) + take(r)
                break
            new = 0
            if size:
                new = one if take(1) else -one
            if row is None:
                row = band[b].tolist()
            known = []
            while k < wide:
                if row[k]:
                    known.append(k)
                elif r:
                    r -= 1
                else:
                    break
                k += 1
            if known:
                _correct_row(reader, row, known, one)
            if new and k < wide:
                row[k] = new
            k += 1
        if row is not None:
            if run:
                _correct_row(reader, row, [j for j in range(k, wide) if row[j]], one)
            band[b] = row
            if run > 1:
                _correct(reader, band[b + 1 : b + run], low)
        elif run:
            _correct(reader, band[b : b + run], low)
        b += max(run, 1)


def rgb(image: Image) -> np.ndarray:
    """Full-resolution samples, height x width x 3: inverse transform, chroma repeated to full size, colours converted."""
    h, v = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
    planes = []
    for c in image.components.values():
        rows, cols = c.blocks.shape[:2]
        flat = c.blocks.reshape(-1, 64).astype(np.float64) @ scaled(image.quants[c.quant].tobytes())
        flat *= 1 / 65536
        flat += 128.5
        samples = flat.clip(0, 255, out=flat).astype(np.int32)
        plane = samples.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        if v == 2 * c.v and h == 2 * c.h:
            plane = plane.repeat(2, 0).repeat(2, 1)
        elif c.h != h or c.v != v:  # any ratio: each place takes the sample that covers it
            plane = plane[np.arange(image.height) * c.v // v][:, np.arange(image.width) * c.h // h]
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][..., None].astype(np.uint8), 3, 2)
    y, blue, red = planes
    y = (y << 16) + (1 << 15)
    blue, red = blue - 128, red - 128
    out = np.empty((image.height, image.width, 3), np.uint8)
    for k, value in enumerate((91881 * red, -22554 * blue - 46802 * red, 116130 * blue)):
        value += y
        value >>= 16
        out[..., k] = value.clip(0, 255, out=value)
    return out


def decode(data: bytes, most: int = MOST_PIXELS) -> np.ndarray:
    return rgb(coefficients(data, most))


# Writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(name: int, by_length: dict[int, list[int]]) -> bytes:
    sizes = bytes(len(by_length.get(k, [])) for k in range(1, 17))
    return _segment(0xC4, bytes([name]) + sizes + b"".join(bytes(by_length[k]) for k in sorted(by_length)))


def _start(parts: list[int], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(parts), *(x for p in parts for x in (p, 0)), first, last, high << 4 | low]))


def _stuffed(bits: np.ndarray) -> bytes:
    """Bits to bytes, filled up with ones."""
    out = bytearray(np.packbits(bits))
    if len(bits) % 8:
        out[-1] |= (1 << -len(bits) % 8) - 1
    return bytes(out.replace(b"\xff", b"\xff\x00"))


def _packed(bits: str) -> bytes:
    """The same for digits."""
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b""


_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1] * 64))
_DC_TABLE = _table(0x00, {4: list(range(9))})
_AC_TABLE = _table(0x10, {1: [0x07]})


@functools.cache
def _begin(parts: tuple[int, ...], first: int, last: int, high: int, low: int) -> bytes:
    return _start(list(parts), first, last, high, low)


def _value(v: int) -> str:
    """The bits of a coefficient or difference."""
    size = abs(v).bit_length()
    return f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if v else ""


@functools.cache
def _difference_words() -> list[str]:
    """For differences 0 to 255 and, from the end, -1 to -255: four bits of size and the size's bits."""
    return [f"{abs(v).bit_length():04b}{_value(v)}" for v in (*range(256), *range(-255, 0))]


def _dc_first(values: np.ndarray) -> bytes:
    """values: for each unit four blocks' DC >> 1 of luma, then one of either chroma."""
    diff = values.copy()
    diff[:, 1:4] -= values[:, :3]
    diff[1:, 0] -= values[:-1, 3]
    diff[1:, 4:] -= values[:-1, 4:]
    words = _difference_words()
    return _packed("".join([words[v] for v in diff.ravel().tolist()]))


@functools.cache
def _runs_table(kinds: tuple[int, ...]) -> bytes:
    return _table(0x10, {k + 1: [r << 4] for k, r in enumerate(kinds)})


def _ac_corrections(bits: np.ndarray) -> tuple[bytes, bytes]:
    """The table and data of a refinement: runs of blocks with correction bits only."""
    runs = [32767] * (len(bits) // 32767) + [len(bits) % 32767] * (len(bits) % 32767 > 0)
    kinds = tuple(sorted({n.bit_length() - 1 for n in runs}, reverse=True))
    out, at = [], 0
    for n in runs:
        r = n.bit_length() - 1
        code = [0] if r == kinds[0] else [1, 0]
        out.append(np.array(code + [(n >> k) & 1 for k in range(r - 1, -1, -1)], np.uint8))
        out.append(bits[at : at + n].ravel())
        at += n
    return _runs_table(kinds), _stuffed(np.concatenate(out))


#: The band of the last component that holds signed values: first coefficient, how far a byte lies above its value, first point transform.
BAND, ABOVE, SHIFT = 56, 96, 2


@functools.cache
def _run_codes() -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A table for runs and sizes (of eight bits at most) and ends of bands, and (code, length) of each symbol, by Huffman's rule for weights that fall with both."""
    weight = {r << 4 | size: 2.0 ** -(r / 4 + 0.75 * size) for r in range(16) for size in range(1, 9)} | {0xF0: 2.0**-6} | {r << 4: 2.0 ** -(2 + r / 2) for r in range(15)}
    heap = [(w + 1e-6, s, (s,)) for s, w in weight.items()] + [(0.0, 256, (256,))]  # 256 takes the code of ones, which none may have
    heapq.heapify(heap)
    length = dict.fromkeys([*weight, 256], 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    order = sorted(weight, key=lambda s: (length[s], s))
    sizes = bytes(sum(length[s] == k for s in order) for k in range(1, 17))
    assert sum(sizes) == len(order)
    codes, code, last = {}, 0, length[order[0]]
    for s in order:
        code <<= length[s] - last
        codes[s], last = (code, length[s]), length[s]
        code += 1
    return _segment(0xC4, bytes([0x10]) + sizes + bytes(order)), codes


class _Writer:
    """Bits of one scan: symbols of the table for runs, and what stands behind them."""

    def __init__(self):
        self.codes, self.out, self.ends, self.held = _run_codes()[1], [], 0, []

    def symbol(self, s: int, value: int = 0, size: int = 0) -> None:
        code, n = self.codes[s]
        self.out.append(f"{code << size | value:0{n + size}b}")

    def end_bands(self) -> None:
        """The blocks whose band has ended since the last symbol, and their correction bits."""
        if self.ends:
            size = self.ends.bit_length() - 1
            self.symbol(size << 4, self.ends - (1 << size), size)
            self.out += self.held
            self.ends, self.held = 0, []

    def end_block(self, held: list[str]) -> None:
        self.ends += 1
        self.held += held
        if self.ends == 0x7FFF:
            self.end_bands()

    def data(self) -> bytes:
        self.end_bands()
        return _packed("".join(self.out))


@functools.cache
def _run_words() -> dict[int, str]:
    """The symbol and bits of a value below 256 after a run, by run << 9 | value & 511."""
    codes = _run_codes()[1]
    return {r << 9 | v & 511: f"{codes[r << 4 | abs(v).bit_length()][0]:0{codes[r << 4 | abs(v).bit_length()][1]}b}{_value(v)}" for r in range(16) for v in range(-255, 256) if v}


def _write_first(band: np.ndarray, low: int) -> bytes:
    """A first pass over a band, the magnitudes shifted by ``low``."""
    w, words = _Writer(), _run_words()
    out = w.out
    for row in (np.sign(band) * (np.abs(band) >> low)).tolist():
        run = 0
        for v in row:
            if not v:
                run += 1
                continue
            if w.ends:
                w.end_bands()
            while run > 15:
                w.symbol(0xF0)
                run -= 16
            out.append(words[run << 9 | v & 511])
            run = 0
        if run:
            w.end_block([])
    return w.data()


def _write_refinement(band: np.ndarray, low: int) -> bytes:
    """The next bit of the coefficients that are known, and those that it makes new."""
    w, words = _Writer(), _run_words()
    out = w.out
    for row in (np.sign(band) * (np.abs(band) >> low)).tolist():
        run, held = 0, []
        left = row.count(1) + row.count(-1)
        for v in row:
            if v > 1 or v < -1:
                held.append("1" if v & 1 else "0")
            elif v:
                if w.ends:
                    w.end_bands()
                out.append(words[run << 9 | v & 511])
                out += held
                run, held, left = 0, [], left - 1
            elif run == 15 and left:
                w.end_bands()
                w.symbol(0xF0)
                out += held
                run, held = 0, []
            else:
                run += 1
        if run or held:
            w.end_block(held)
    return w.data()


def encode(payload: bytes) -> bytes:
    """A colour image with halved chroma whose coefficients hold ``payload``, a byte in each.

    Byte b is coefficient b from 128 on and b - 255 below, so that every magnitude is 128 to 255: after a point
    transform by 1 all have the size 7, their bits are b >> 1, and the last bit of the magnitude is left to the
    refinement. In the last component's coefficients from BAND on, byte b is b - ABOVE, written in SHIFT + 1 scans.
    The payload fills luma, then both chroma planes; what is left holds zero bytes. A comment has its length.
    """
    units = max(1, -(-len(payload) // 384))
    across = math.isqrt(units - 1) + 1
    down = -(-units // across)
    units = across * down
    raw = np.frombuffer(payload + bytes(units * 384 - len(payload)), np.uint8)
    ends = (0, units * 4, units * 5, units * 6)
    blocks = raw.reshape(-1, 64)
    half, last_bits = blocks >> 1, (blocks & 1) ^ (blocks < 128)
    comment = _segment(0xFE, str(len(payload)).encode())
    frame = _segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    dc = blocks[:, 0].astype(np.int16)
    dc -= (dc < 128) * np.int16(255)
    joined = np.empty((units, 6), np.int16)
    joined[:, :4] = dc[: ends[1]].reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(units, 4)
    joined[:, 4:] = dc[ends[1] :].reshape(2, units).T
    out = [_HEAD, comment, frame, _DC_TABLE, _begin((1, 2, 3), 0, 0, 0, 1), _dc_first(joined >> 1), _AC_TABLE]
    for part, first, last in ((1, 1, 5), (2, 1, 63), (3, 1, BAND - 1), (1, 6, 63)):
        # A code of one bit, zero, and seven bits: a byte below 128 each, so none needs stuffing.
        out += [_begin((part,), first, last, 0, 1), half[ends[part - 1] : ends[part], first : last + 1].tobytes()]
    out += [_begin((1, 2, 3), 0, 0, 1, 0), _stuffed((joined & 1).astype(np.uint8).ravel())]
    for part, last in ((1, 63), (2, 63), (3, BAND - 1)):
        table, data = _ac_corrections(last_bits[ends[part - 1] : ends[part], 1 : last + 1])
        out += [table, _begin((part,), 1, last, 1, 0), data]
    band = blocks[ends[2] :, BAND:].astype(np.int16) - ABOVE
    out += [_run_codes()[0], _begin((3,), BAND, 63, 0, SHIFT), _write_first(band, SHIFT)]
    for low in range(SHIFT - 1, -1, -1):
        out += [_begin((3,), BAND, 63, low + 1, low), _write_refinement(band, low)]
    return b"".join([*out, b"\xff\xd9"])


def payload(image: Image) -> bytes:
    """What ``encode`` stored."""
    parts = [c.blocks.reshape(-1, 64) for c in image.components.values()]
    parts = [(p + (p >> 31)).astype(np.uint8) for p in parts]  # b - 255 less 1 is b, but for a multiple of 256
    parts[2][:, BAND:] = image.components[3].blocks.reshape(-1, 64)[:, BAND:] + ABOVE
    return b"".join(parts)[: int(image.comment)]
