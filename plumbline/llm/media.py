"""Media columns: progressive JPEG, written and read in numpy.

The decoder accumulates scans (spectral selection and successive
approximation) into coefficient arrays, transforms them back with integer
arithmetic, repeats chroma samples to full resolution and gives RGB tensors. It
reads one code from each restart interval at a time, for all intervals of a
batch of files together. The encoder writes any coefficients within 8 bits
losslessly: a block of 64 bytes becomes a block of 64 coefficients, the unit
of the format.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table
from plumbline.session import ship

UNIT = 64
#: Places of the zigzag sequence in an 8 x 8 block: diagonals, walked up and down in turn.
ZIGZAG = np.array([8 * y + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda q: (q[0] + q[1], q[0] if (q[0] + q[1]) % 2 else q[1]))])
#: Blocks that are worked on at a time.
_CHUNK = 1 << 14
_ROW_MCUS = 4000
_SAMPLING = ((2, 2), (1, 1), (1, 1))


# --- Huffman tables ---------------------------------------------------------------------------------------------


def _canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A DHT body (16 counts, then symbols) and each symbol's (code, length)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(lengths[s] == n for s in order) for n in range(1, 17))
    codes, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    if code > (1 << last) - 1:
        raise ValueError("the code of all ones must stay free")
    return counts + bytes(order), codes


#: Short codes for the sizes that bytes of text have; a run of zeros or the end of a block is rare.
_AC_LENGTHS = {0x04: 2, 0x03: 2, 0x06: 3, 0x05: 4, 0x02: 4, 0x07: 4, 0x01: 5, 0x00: 6, 0xF0: 8} | {16 * r + s: 12 for r in range(1, 16) for s in range(1, 8)}
_REFINE_LENGTHS = {0x00: 1, 0x01: 2, 0xF0: 3} | {16 * r + 1: 7 for r in range(1, 16)}
_DC_LENGTHS = {0: 4, 1: 4, 2: 3, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 8: 5}
_AC_BODY, _AC = _canonical(_AC_LENGTHS)
_REFINE_BODY, _REFINE = _canonical(_REFINE_LENGTHS)
_DC_BODY, _DC = _canonical(_DC_LENGTHS)


def _code_arrays(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s, (c, n) in codes.items():
        code[s], length[s] = c, n
    return code, length


@lru_cache(maxsize=64)
def _decode_table(body: bytes) -> np.ndarray:
    """For the next 16 bits: length << 8 | symbol; 0 where no code fits."""
    table, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            lo = code << (16 - n)
            table[lo : lo + (1 << (16 - n))] = n << 8 | body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


# --- Writing ----------------------------------------------------------------------------------------------------

_SIZE = np.array([int(v).bit_length() for v in range(1 << 12)], np.int64)


def _stream(code: np.ndarray, length: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the codes (each under 58 bits), every row filled up with ones to whole bytes; and the bytes of each row.

    `rows` are the numbers of codes of each row. Codes are summed into 64-bit words.
    """
    bits = np.add.reduceat(length, np.r_[0, np.cumsum(rows)[:-1]])
    pad = -bits % 8
    ends = np.cumsum(rows)
    code = np.insert(code, ends, (np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1))
    length = np.insert(length, ends, pad)
    start = np.cumsum(length) - length
    word, room = start >> 6, 64 - (start & 63) - length
    fits = room >= 0
    head = np.where(fits, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    total = int(start[-1] + length[-1])
    words = np.zeros((total + 63 >> 6) + 1, np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[first]] += np.add.reduceat(head, first)
    over = np.flatnonzero(~fits)
    words[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
    return words.byteswap().view(np.uint8)[: total >> 3], (bits + pad) >> 3


def _marked(data: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuffed bytes with a restart marker after each row; and the new sizes of the rows, markers included."""
    full = data == 0xFF
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(data)) + np.cumsum(full) - full + 2 * row
    new = sizes + np.bincount(row[full], minlength=len(sizes)) + 2
    out = np.zeros(int(new.sum()), np.uint8)
    out[place] = data
    ends = np.cumsum(new)
    out[ends - 2], out[ends - 1] = 0xFF, 0xD0 + (number & 7)
    return out, new


def _ac_first(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of coefficients 1 to 63 at one bit less, row by row."""
    n = len(c)
    size_code, size_len = _code_arrays(_AC)
    low = np.abs(c) >> 1
    row, k = np.nonzero(low)
    v = low[row, k].astype(np.int64)
    before = np.r_[-1, k[:-1]]
    before[np.r_[True, row[1:] != row[:-1]][: len(row)]] = -1
    run = k - before - 1
    size = _SIZE[v]
    bits = np.where(c[row, k] < 0, (1 << size) - 1 - v, v).astype(np.uint64)
    symbol = (run & 15) << 4 | size
    code = size_code[symbol] << size.astype(np.uint64) | bits
    length = size_len[symbol] + size
    z_code, z_len = _AC[0xF0]
    for more in (1, 2, 3):  # runs of sixteen zeros go before
        far = np.flatnonzero(run >> 4 >= more)
        code[far] |= np.uint64(z_code) << length[far].astype(np.uint64)
        length[far] += z_len
    counts = np.bincount(row, minlength=n)
    last = np.full(n, -1)
    last[row] = k
    tail = np.flatnonzero(last < 62)
    at = np.cumsum(counts)[tail]
    return np.insert(code, at, np.uint64(_AC[0][0])), np.insert(length, at, _AC[0][1]), counts + (last < 62)


def _ac_refine(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the last bit of coefficients 1 to 63: one item for each coefficient, a segment's symbol with its first."""
    n, m = c.shape
    a = np.abs(c)
    old, new = a >= 2, a == 1
    zero = a == 0
    end = new.copy()
    if zero.any():
        # a run of sixteen zeros ends a segment too, if a new coefficient follows
        later = np.flip(np.maximum.accumulate(np.flip(new, 1), 1), 1)
        for r in np.flatnonzero((zero & later).sum(1) >= 16):
            run = 0
            for k in range(m):
                run = 0 if new[r, k] else run + int(zero[r, k])
                if run == 16 and later[r, k]:
                    end[r, k], run = True, 0
    start = np.ones((n, m), bool)
    start[:, 1:] = end[:, :-1]
    first = np.flatnonzero(start)
    stop = end.copy()
    stop[:, -1] = True
    last = np.flatnonzero(stop)
    zeros = np.r_[0, np.cumsum(zero)]
    flat_new, flat_end = new.ravel(), end.ravel()
    run = zeros[last] - zeros[first]
    symbol = np.where(flat_new[last], np.minimum(run, 15) << 4 | 1, np.where(flat_end[last], 0xF0, 0))
    s_code, s_len = _code_arrays(_REFINE)
    code, length = np.zeros(n * m, np.uint64), np.zeros(n * m, np.int64)
    sign = (c.ravel()[last] > 0).astype(np.uint64)
    code[first] = np.where(flat_new[last], s_code[symbol] << np.uint64(1) | sign, s_code[symbol])
    length[first] = s_len[symbol] + flat_new[last]
    flat_old = old.ravel()
    code[flat_old] = code[flat_old] << np.uint64(1) | (a.ravel()[flat_old] & 1).astype(np.uint64)
    length[flat_old] += 1
    return code, length, np.full(n, m)


def _dc_first(mcus: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Differences of the six first coefficients of each MCU, at one bit less."""
    d = mcus >> 1
    diff = np.stack([d[:, 0], d[:, 1] - d[:, 0], d[:, 2] - d[:, 1], d[:, 3] - d[:, 2], d[:, 4], d[:, 5]], 1).ravel().astype(np.int64)
    size = _SIZE[np.abs(diff)]
    s_code, s_len = _code_arrays(_DC)
    bits = np.where(diff < 0, diff + (1 << size) - 1, diff).astype(np.uint64)
    return s_code[size] << size.astype(np.uint64) | bits, s_len[size] + size, np.full(len(mcus), 6)


def _dc_refine(mcus: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (mcus & 1).ravel().astype(np.uint64), np.ones(mcus.size, np.int64), np.full(len(mcus), 6)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _sos(components: list[tuple[int, int, int]], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(components)]) + b"".join(bytes([i, dc << 4 | ac]) for i, dc, ac in components) + bytes([ss, se, ah << 4 | al]))


_TABLES = _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC4, b"\x00" + _DC_BODY) + _segment(0xC4, b"\x10" + _AC_BODY) + _segment(0xC4, b"\x11" + _REFINE_BODY) + _segment(0xDD, b"\0\1")


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A progressive 4:2:0 JPEG for each payload, a multiple of 64 bytes: byte k of a block, less 128, is its k-th coefficient.

    Blocks fill MCUs in order (four of luma, then one of each chroma); the last
    MCU and row are filled up with zero blocks, and a comment holds the
    payload's size. Every block is a restart interval.
    """
    files: list[list[bytes]] = []
    shape, mcu_counts = [], []
    for p in payloads:
        mcus = max(1, -(-len(p) // (6 * UNIT)))
        wide = min(mcus, _ROW_MCUS)
        high = -(-mcus // wide)
        shape.append((wide, high))
        mcu_counts.append(wide * high)
        frame = struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(_SAMPLING))
        files.append([b"\xff\xd8", _segment(0xFE, b"bytes=%d" % len(p)), _segment(0xC2, frame), _TABLES])
    total = sum(mcu_counts)
    coefficients = np.zeros((total * 6, UNIT), np.int16)
    at = 0
    for p, m in zip(payloads, mcu_counts):
        coefficients[at : at + len(p) // UNIT] = np.frombuffer(p, np.uint8).reshape(-1, UNIT).astype(np.int16) - 128
        at += 6 * m
    mcu_ends = np.cumsum(mcu_counts)
    mcu_starts = mcu_ends - mcu_counts
    luma = np.concatenate([_luma_order(w, h) + 6 * s for (w, h), s in zip(shape, mcu_starts)])
    chroma = 6 * np.arange(total)
    plans = [
        (_sos([(1, 0, 0), (2, 0, 0), (3, 0, 0)], 0, 0, 0, 1), None, _dc_first, 1),
        *[(_sos([(i + 1, 0, 0)], 1, 63, 0, 1), rows, _ac_first, 4 if i == 0 else 1) for i, rows in enumerate((luma, chroma + 4, chroma + 5))],
        (_sos([(1, 0, 0), (2, 0, 0), (3, 0, 0)], 0, 0, 1, 0), None, _dc_refine, 1),
        *[(_sos([(i + 1, 0, 1)], 1, 63, 1, 0), rows, _ac_refine, 4 if i == 0 else 1) for i, rows in enumerate((luma, chroma + 4, chroma + 5))],
    ]
    for header, rows, codes, blocks in plans:
        units = total if rows is None else len(rows)
        starts = mcu_starts * blocks
        number = np.arange(units) - np.repeat(starts, np.array(mcu_counts) * blocks)
        parts, sizes = [], []
        for lo in range(0, units, _CHUNK):
            hi = min(units, lo + _CHUNK)
            c = coefficients[6 * lo : 6 * hi, 0].reshape(-1, 6).astype(np.int64) if rows is None else coefficients[rows[lo:hi], 1:]
            data, size = _marked(*_stream(*codes(c)), number[lo:hi])
            parts.append(data)
            sizes.append(size)
        data, ends = np.concatenate(parts), np.cumsum(np.concatenate(sizes))
        for f, lo, hi in zip(files, starts, mcu_ends * blocks):
            f += [header, data[ends[lo - 1] if lo else 0 : ends[hi - 1] - 2].tobytes()]  # no marker after the last interval
    return [b"".join([*f, b"\xff\xd9"]) for f in files]


@lru_cache(maxsize=512)
def _luma_order(wide: int, high: int) -> np.ndarray:
    """Places of luma blocks among an image's blocks in MCU order, in raster order."""
    y, x = np.mgrid[0 : 2 * high, 0 : 2 * wide]
    return (6 * ((y >> 1) * wide + (x >> 1)) + 2 * (y & 1) + (x & 1)).ravel()


@lru_cache(maxsize=512)
def _luma_places(wide: int, high: int) -> np.ndarray:
    """The inverse of _luma_order: raster places in MCU order."""
    return np.argsort(_luma_order(wide, high), kind="stable")


# --- Reading ----------------------------------------------------------------------------------------------------


#: A marker other than a stuffed zero, a restart or a fill byte.
_NEXT_MARKER = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")


@dataclass
class Scan:
    components: tuple[int, ...]
    band: tuple[int, int]
    bits: tuple[int, int]
    tables: tuple[tuple[bytes, bytes], ...]
    restart: int
    start: int
    end: int


@dataclass
class Image:
    """A parsed file: frame, scans, and quantisation tables by component in zigzag order."""

    data: bytes
    width: int = 0
    height: int = 0
    ids: list[int] = field(default_factory=list)
    sampling: list[tuple[int, int]] = field(default_factory=list)
    quant: list[tuple[int, ...]] = field(default_factory=list)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""

    @cached_property
    def most(self) -> tuple[int, int]:
        return max(h for h, _ in self.sampling), max(v for _, v in self.sampling)

    @cached_property
    def mcus(self) -> tuple[int, int]:
        h, v = self.most
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def stored(self, c: int) -> tuple[int, int]:
        """Blocks across and down, whole MCUs."""
        return self.mcus[0] * self.sampling[c][0], self.mcus[1] * self.sampling[c][1]

    def real(self, c: int) -> tuple[int, int]:
        """Blocks across and down that a scan of this component alone has."""
        h, v = self.most
        return -(-(-(-self.width * self.sampling[c][0] // h)) // 8), -(-(-(-self.height * self.sampling[c][1] // v)) // 8)


def parse(data: bytes) -> Image:
    """Headers and places of the scans of a progressive JPEG; other kinds raise ValueError."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, at, restart = Image(data), 2, 0
    quant: dict[int, tuple[int, ...]] = {}
    huffman: dict[int, bytes] = {}
    chosen: list[int] = []
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = struct.unpack(f">64{'H' if wide else 'B'}", body[1 : 65 + 64 * wide])
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xC2:
            precision, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if precision != 8 or not image.height or not image.width or n not in (1, 3):
                raise ValueError("only 8-bit images of one or three components")
            for i in range(n):
                c, s, q = body[6 + 3 * i : 9 + 3 * i]
                image.ids.append(c)
                image.sampling.append((s >> 4, s & 15))
                chosen.append(q)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a progressive JPEG with Huffman codes")
        elif marker == 0xDA:
            n = body[0]
            comps = tuple(image.ids.index(body[1 + 2 * i]) for i in range(n))
            names = [body[2 + 2 * i] for i in range(n)]
            ss, se, bits = body[1 + 2 * n : 4 + 2 * n]
            found = _NEXT_MARKER.search(data, at)  # one that doesn't belong to the scan
            end = found.start() if found else len(data)
            tables = tuple((huffman.get(x >> 4, b""), huffman.get(16 | x & 15, b"")) for x in names)
            image.scans.append(Scan(comps, (ss, se), (bits >> 4, bits & 15), tables, restart, at, end))
            at = end
    else:
        raise ValueError("the file is cut off")
    image.quant = [quant[q] for q in chosen]
    return image


class _Bits:
    """Unstuffed scan data of many intervals, and a place in each."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        padded = np.concatenate([data, np.full(8, 0xFF, np.uint8)]).astype(np.uint32)
        self.words = padded[:-4] << 24 | padded[1:-3] << 16 | padded[2:-2] << 8 | padded[3:-1]
        self.at = starts.astype(np.int64) * 8

    def peek16(self, rows) -> np.ndarray:
        at = self.at[rows]
        byte = np.minimum(at >> 3, len(self.words) - 1)
        return (self.words[byte] >> (16 - (at & 7)).astype(np.uint32)) & 0xFFFF

    def symbol(self, rows, table: np.ndarray) -> np.ndarray:
        found = table[self.peek16(rows)]
        if not found.all():
            raise ValueError("a code is not in its table")
        self.at[rows] += found >> 8
        return found & 0xFF

    def take(self, rows, sizes: np.ndarray) -> np.ndarray:
        value = self.peek16(rows).astype(np.int64) >> (16 - sizes)
        self.at[rows] += sizes
        return value


def _intervals(images: list[Image], number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a scan in all images: unstuffed bytes without markers, the intervals' starts, and each interval's image."""
    raw = np.frombuffer(b"".join(i.data[i.scans[number].start : i.scans[number].end] for i in images), np.uint8)
    sizes = np.array([i.scans[number].end - i.scans[number].start for i in images])
    after = np.r_[False, raw[:-1] == 0xFF]
    begins = np.cumsum(sizes) - sizes
    after[begins[begins < len(raw)]] = False
    marker = after & (raw >= 0xD0) & (raw <= 0xD7)
    drop = after & (raw == 0) | marker
    drop[np.flatnonzero(marker) - 1] = True
    kept = np.cumsum(~drop)
    starts = np.sort(np.r_[begins, np.flatnonzero(marker) + 1])
    owner = np.searchsorted(begins, starts, side="right") - 1
    return raw[~drop], np.where(starts > 0, kept[np.maximum(starts - 1, 0)], 0), owner


def _extend(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(value < (1 << np.maximum(size, 1) - 1), value - (1 << size) + 1, value) * (size > 0)


def _read_ac_first(bits: _Bits, rows: np.ndarray, c: np.ndarray, blocks: np.ndarray, band, al: int, table: np.ndarray, skip: np.ndarray) -> None:
    """One block of each interval `rows`, into c[blocks]; skip: blocks that the interval's last end of band covers."""
    k = np.full(len(rows), band[0])
    live = np.flatnonzero(skip[rows] == 0)
    skip[rows] = np.maximum(0, skip[rows] - 1)
    while len(live):
        sub = rows[live]
        symbol = bits.symbol(sub, table)
        run, size = symbol >> 4, symbol & 15
        value = _extend(bits.take(sub, size), size)
        ends = (size == 0) & (run < 15)
        some = size > 0
        k[live] += run
        put = live[some]
        if (k[put] > band[1]).any():
            raise ValueError("a coefficient lies outside its band")
        c[blocks[put], k[put]] = value[some] << al
        k[live] += 1
        if ends.any():
            e = sub[ends]
            skip[e] = (1 << run[ends]) - 1 + bits.take(e, run[ends])
        live = live[~ends & (k[live] <= band[1])]


def _read_ac_refine(bits: _Bits, rows: np.ndarray, c: np.ndarray, blocks: np.ndarray, band, al: int, table: np.ndarray, skip: np.ndarray) -> None:
    """The next bit of one block of each interval: symbols are read for all intervals together, correction bits at the end for all blocks."""
    lo, hi = band
    part = c[blocks, lo : hi + 1]
    n, m = part.shape
    old = part != 0
    rank = np.zeros((n, m + 1), np.int32)
    np.cumsum(old, axis=1, out=rank[:, 1:])
    where = np.zeros((n, m), np.int64)  # of the correction bits
    column = np.arange(m)
    k = np.zeros(n, np.int64)
    pending = np.arange(n)
    while len(pending):
        sub = rows[pending]
        symbol = np.zeros(len(pending), np.int64)
        waiting = skip[sub] > 0
        fresh = np.flatnonzero(~waiting)
        if len(fresh):
            symbol[fresh] = bits.symbol(sub[fresh], table)
        run, size = symbol >> 4, symbol & 15
        stop = waiting | (size == 0) & (run < 15)
        begun = np.flatnonzero(stop & ~waiting)
        if len(begun):
            skip[sub[begun]] = (1 << run[begun]) + bits.take(sub[begun], run[begun])
        sign = np.zeros(len(pending), np.int64)
        new = np.flatnonzero(size > 0)
        if len(new):
            sign[new] = bits.take(sub[new], np.ones(len(new), np.int64))
        end = np.full(len(pending), m)
        go = np.flatnonzero(~stop)
        if len(go):
            g = pending[go]
            zeros_seen = (np.cumsum(~old[g], axis=1) - (k[g] - rank[g, k[g]])[:, None])
            reach = ~old[g] & (zeros_seen == (run[go] + 1)[:, None]) & (column >= k[g][:, None])
            end[go] = np.where(reach.any(1), reach.argmax(1), m)
        base = bits.at[sub]
        span = (column >= k[pending][:, None]) & (column < end[:, None])
        where[pending] = np.where(span, base[:, None] + rank[pending, :m] - rank[pending, k[pending]][:, None], where[pending])
        bits.at[sub] += rank[pending, np.minimum(end, m)] - rank[pending, k[pending]]
        hit = np.flatnonzero((size > 0) & (end < m))
        part[pending[hit], end[hit]] = np.where(sign[hit] > 0, 1, -1) << al
        k[pending] = np.minimum(end + 1, m)
        skip[sub[stop]] -= 1
        pending = pending[~stop & (k[pending] < m)]
    r, j = np.nonzero(old)
    at = where[r, j]
    bit = (bits.words[np.minimum(at >> 3, len(bits.words) - 1)] >> (31 - (at & 7)).astype(np.uint32)) & 1
    part[r, j] += (np.sign(part[r, j]) * bit.astype(np.int64) << al).astype(part.dtype)
    c[blocks, lo : hi + 1] = part


def _units(image: Image, scan: Scan) -> list[tuple[int, np.ndarray]]:
    """For each block of an MCU of the scan: its component and, for all MCUs in order, its place among that component's blocks."""
    if len(scan.components) == 1:
        c = scan.components[0]
        return [(c, _raster(*image.real(c), image.stored(c)[0]))]
    out = []
    for c in scan.components:
        h, v = image.sampling[c]
        out += [(c, _corners(*image.mcus, h, v, x, y)) for y in range(v) for x in range(h)]
    return out


@lru_cache(maxsize=512)
def _raster(wide: int, high: int, stride: int) -> np.ndarray:
    return (np.arange(high)[:, None] * stride + np.arange(wide)).ravel()


@lru_cache(maxsize=2048)
def _corners(wide: int, high: int, h: int, v: int, x: int, y: int) -> np.ndarray:
    """Places of the block (x, y) of each MCU."""
    return ((np.arange(high)[:, None] * v + y) * wide * h + np.arange(wide) * h + x).ravel()


def _key(image: Image) -> tuple:
    return (tuple(image.sampling), tuple((s.components, s.band, s.bits, s.tables, s.restart) for s in image.scans))


def coefficients(images: list[Image]) -> list[np.ndarray]:
    """By component: the coefficients (blocks, 64), in zigzag order, of all images one after the other. All have the same scans."""
    first = images[0]
    counts = [np.array([math.prod(i.stored(c)) for i in images]) for c in range(len(first.ids))]
    begins = [np.cumsum(n) - n for n in counts]
    out = [np.zeros((int(n.sum()), 64), np.int16) for n in counts]
    for number, scan in enumerate(first.scans):
        data, starts, owner = _intervals(images, number)
        units = [_units(i, i.scans[number]) for i in images]
        mcus = np.array([len(u[0][1]) for u in units])
        places = [np.concatenate([u[b][1] + begins[u[b][0]][i] for i, u in enumerate(units)]) for b in range(len(units[0]))]
        of = [c for c, _ in units[0]]
        step = scan.restart or int(mcus.max())
        # the first MCU and the MCUs of each interval
        index = np.arange(len(starts)) - np.searchsorted(owner, owner)
        mcu_begin = (np.cumsum(mcus) - mcus)[owner] + index * step
        length = np.minimum(step, mcus[owner] - index * step)
        ok = length > 0
        starts, mcu_begin, length = starts[ok], mcu_begin[ok], length[ok]
        bits = _Bits(data, starts)
        ah, al = scan.bits
        skip = np.zeros(len(starts), np.int64)
        previous = np.zeros((len(starts), len(first.ids)), np.int64)
        for lo in range(0, len(starts), _CHUNK):
            chunk = np.arange(lo, min(len(starts), lo + _CHUNK))
            for j in range(int(length[chunk].max())):
                rows = chunk[length[chunk] > j]
                for b, c in enumerate(of):
                    blocks = places[b][mcu_begin[rows] + j]
                    dc_body, ac_body = scan.tables[scan.components.index(c)]
                    if scan.band[0] == 0:
                        if ah:
                            out[c][blocks, 0] |= (bits.take(rows, np.ones(len(rows), np.int64)) << al).astype(np.int16)
                        else:
                            size = bits.symbol(rows, _decode_table(dc_body)).astype(np.int64)
                            previous[rows, c] += _extend(bits.take(rows, size), size)
                            out[c][blocks, 0] = previous[rows, c] << al
                    else:
                        (_read_ac_refine if ah else _read_ac_first)(bits, rows, out[c], blocks, scan.band, al, _decode_table(ac_body), skip)
    return out


def _basis() -> np.ndarray:
    """The inverse transform of a block in zigzag order, times 8192, in whole numbers (so that sums are exact in any order)."""
    u, x = np.mgrid[0:8, 0:8]
    one = np.where(u == 0, math.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * math.pi / 16)
    full = np.einsum("vy,ux->vuyx", one, one).reshape(64, 64)
    return np.rint(full[ZIGZAG] * 8192)


_BASIS = _basis()


def samples(c: np.ndarray, quant) -> np.ndarray:
    """8-bit samples (blocks, 8, 8) of coefficients in zigzag order."""
    out = np.empty((len(c), 64), np.uint8)
    for lo in range(0, len(c), _CHUNK):
        exact = (c[lo : lo + _CHUNK] * np.asarray(quant, np.int32)).astype(np.float64) @ _BASIS
        out[lo : lo + _CHUNK] = np.clip((exact.astype(np.int64) + 4096 >> 13) + 128, 0, 255)
    return out.reshape(-1, 8, 8)


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """RGB of full-resolution planes, in fixed point."""
    y, b, r = y.astype(np.int32) << 16, cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    half = 1 << 15
    out = np.empty((*y.shape, 3), np.uint8)
    out[..., 0] = np.clip(y + 91881 * r + half >> 16, 0, 255)
    out[..., 1] = np.clip(y - 22554 * b - 46802 * r + half >> 16, 0, 255)
    out[..., 2] = np.clip(y + 116130 * b + half >> 16, 0, 255)
    return out


def decode_rgb(data: bytes) -> np.ndarray:
    """The (height, width, 3) tensor of a progressive JPEG; grey images have three equal channels."""
    image = parse(data)
    most = [max(s[i] for s in image.sampling) for i in (0, 1)]
    planes = []
    for c, found in enumerate(coefficients([image])):
        wide, high = image.stored(c)
        plane = samples(found, image.quant[c]).reshape(high, wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * high, 8 * wide)
        h, v = image.sampling[c]
        planes.append(plane.repeat(most[1] // v, 0).repeat(most[0] // h, 1)[: image.height, : image.width])
    return to_rgb(*planes) if len(planes) == 3 else np.repeat(planes[0][..., None], 3, 2)


def _decoded_alike(images: list[Image]) -> list[tuple[bytes | None, np.ndarray]]:
    """(payload, RGB tensor) of files by encode_payloads() that share their scans; all MCUs are turned into pixels together."""
    y, cb, cr = coefficients(images)
    q = images[0].quant
    shapes = [(i.stored(0), i.stored(1)) for i in images]
    counts = np.array([w * h for _, (w, h) in shapes])
    ends = np.cumsum(counts)
    starts = ends - counts
    order = np.concatenate([_luma_places(*small) + 4 * s for (_, small), s in zip(shapes, starts)])
    n = int(ends[-1])
    blocks = np.empty((n, 6, UNIT), np.int16)
    blocks[:, :4] = y[order].reshape(n, 4, UNIT)
    blocks[:, 4], blocks[:, 5] = cb, cr
    pixels = np.empty((n, 16, 16, 3), np.uint8)
    for lo in range(0, n, 1024):
        part = blocks[lo : lo + 1024]
        luma = samples(part[:, :4].reshape(-1, UNIT), q[0]).reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16)
        pixels[lo : lo + 1024] = to_rgb(luma, *[samples(part[:, 3 + c], q[c]).repeat(2, 1).repeat(2, 2) for c in (1, 2)])
    out = []
    for image, (_, (cw, ch)), lo, hi in zip(images, shapes, starts, ends):
        size = int(image.comment.split(b"=")[1])
        payload = (blocks[lo:hi].reshape(-1)[:size] + 128).astype(np.uint8).tobytes()
        out.append((payload, pixels[lo:hi].reshape(ch, cw, 16, 16, 3).transpose(0, 2, 1, 3, 4).reshape(16 * ch, 16 * cw, 3)[: image.height, : image.width]))
    return out


def decoded(files: list[bytes | None]) -> list[tuple[bytes | None, np.ndarray | None, str | None]]:
    """(payload, RGB tensor, error) of each file; a payload only of files by encode_payloads(), an error where there is no tensor."""
    out: list = [(None, None, "no file")] * len(files)
    alike: dict[tuple, list[tuple[int, Image]]] = {}
    for i, f in enumerate(files):
        if f is None:
            continue
        try:
            image = parse(f)
            if image.comment.startswith(b"bytes="):
                alike.setdefault(_key(image), []).append((i, image))
            else:
                out[i] = (None, decode_rgb(f), None)
        except (ValueError, IndexError, KeyError, struct.error) as e:
            out[i] = (None, None, f"{type(e).__name__}: {e}")
    for group in alike.values():
        try:
            for (i, _), (payload, rgb) in zip(group, _decoded_alike([image for _, image in group]), strict=True):
                out[i] = (payload, rgb, None)
        except (ValueError, IndexError, KeyError, struct.error) as e:
            if len(group) == 1:
                out[group[0][0]] = (None, None, f"{type(e).__name__}: {e}")
            else:  # one of them is broken: each by itself
                for i, _ in group:
                    out[i] = decoded([files[i]])[0]
    return out


def tensor_feature(rgb: np.ndarray) -> str:
    """Width x height, the sums of the channels, and a checksum of the tensor."""
    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    return f"{rgb.shape[1]}x{rgb.shape[0]}:{sums[0]}:{sums[1]}:{sums[2]}:{zlib.crc32(np.ascontiguousarray(rgb)):08x}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """A text's bytes (null: none) with zeros up to a positive multiple of 64; and their number without these."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % UNIT if raw else UNIT)


_FIELDS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
_TENSORS = "doc_id long, n_bytes long, media binary, payload binary, height int, width int, rgb binary, error string"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
_TOGETHER = 1 << 20


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _ARROW[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as a progressive JPEG."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in _cuts([len(t or "") for t in texts]):
                made = [payload_of(t) for t in texts[lo:hi]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array(encode_payloads([p for _, p in made]), pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _cuts(sizes: list[int]) -> list[tuple[int, int]]:
    """Runs of items of about _TOGETHER in size."""
    out, lo, size = [], 0, 0
    for i, s in enumerate(sizes):
        if i > lo and size + s > _TOGETHER:
            out.append((lo, i))
            lo, size = i, 0
        size += s
    return [*out, (lo, len(sizes))] if sizes else out


def rgb_tensors(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) with payload, height, width and rgb: the tensor of each file, (height, width, 3) bytes in rows.

    The payload is null for files by others. A null file, one that isn't a
    progressive JPEG of Huffman codes, and a broken one have nulls and an error.
    """
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, files = (batch.column(i).to_pylist() for i in range(3))
            for lo, hi in _cuts([len(f or b"") for f in files]):
                rows = []
                for i, n, f, (payload, rgb, error) in zip(ids[lo:hi], sizes[lo:hi], files[lo:hi], decoded(files[lo:hi])):
                    high, wide = (None, None) if rgb is None else rgb.shape[:2]
                    rows.append((i, n, f, payload, high, wide, None if rgb is None else rgb.tobytes(), error))
                yield _batch(rows, _TENSORS)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _TENSORS)


def media_digests(tensors: DataFrame) -> DataFrame:
    """Digests of the payloads, files and tensors of rgb_tensors(): one row for each; nulls where there is no payload or tensor."""
    ship(tensors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                i, n, f, payload, high, wide, rgb, error = (batch.column(c)[k].as_py() for c in range(8))
                own = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]))
                file = (None, None) if f is None else (len(f), hashlib.sha256(f).hexdigest())
                rows.append((i, n, *own, *file, None if rgb is None else tensor_feature(np.frombuffer(rgb, np.uint8).reshape(high, wide, 3)), error))
            yield _batch(rows, _FIELDS)

    return tensors.mapInArrow(run, _FIELDS)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text as a progressive JPEG, decoded to a tensor column, and the digests of all three.

    Null and empty texts are 64 zero bytes; a null doc_id stays null; rows that
    repeat give equal rows; a very long text is one image of many rows of MCUs;
    other columns play no part; an empty table gives no row.
    """
    return media_digests(rgb_tensors(media_column(table(spark, sf_dir, "documents"))))
