"""Lossless WebP: a decoder for whole batches of images, and an encoder for byte payloads.

The decoder reads the VP8L bit stream of RFC 9649: prefix codes (simple and
normal, any number of groups), back-references, the colour cache, and the
predictor, cross-colour, subtract-green and palette transforms. A batch of
images is decoded in step: each round decodes one pixel of every image that
has pixels left, with array operations over all of them, so the cost of a
round is shared by thousands of images.

The encoder writes RGB images of width 64 with static prefix codes, the colour
cache and back-references for runs, or through transforms where that is smaller
(``webp_forward``). Equal pixels give equal files.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

SIGNATURE = 0x2F
#: Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_CODES, DISTANCE_CODES = 24, 40
CACHE_FACTOR = 0x1E35A7BD
#: Short distance codes: the 120 nearest pixels (columns back, rows up), nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
NEAR_X, NEAR_Y = (np.array(c, np.int64) for c in zip(*NEAR, strict=True))


class BitReader:
    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos = data, pos

    def read(self, n: int) -> int:
        at = self.pos >> 3
        if self.pos + n > 8 * len(self.data):
            raise ValueError("the image ends too early")
        value = int.from_bytes(self.data[at : at + 8], "little") >> (self.pos & 7)
        self.pos += n
        return value & ((1 << n) - 1)


class BitWriter:
    def __init__(self):
        self.value, self.size = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def data(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


# Prefix codes


def canonical(lengths: Sequence[int]) -> dict[int, tuple[int, int]]:
    """Symbol to (code as it stands in the stream, first bit lowest; length)."""
    code, out, before = 0, {}, 0
    for n, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        out[symbol] = (int(format(code, f"0{n}b")[::-1], 2), n)
        code, before = code + 1, n
    return out


@dataclass
class Code:
    """A table over the next ``bits`` bits: length << 16 | symbol."""

    bits: int
    table: np.ndarray


def code_of(lengths: Sequence[int]) -> Code:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return Code(0, np.array([used[0]], np.int64))
    if not used or sum(2.0 ** -lengths[s] for s in used) != 1:
        raise ValueError("a prefix code is not complete")
    bits = max(lengths)
    table = np.zeros(1 << bits, np.int64)
    for symbol, (code, n) in canonical(lengths).items():
        table[code :: 1 << n] = n << 16 | symbol
    return Code(bits, table)


def read_code(r: BitReader, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        symbols = [r.read(8 if wide else 1)] + ([r.read(8)] if two else [])
        for s in symbols:
            if s >= alphabet:
                raise ValueError("a symbol is outside its alphabet")
            lengths[s] = 1
        return code_of(lengths)
    first = [0] * 19
    for k in CODE_LENGTH_ORDER[: 4 + r.read(4)]:
        first[k] = r.read(3)
    code = code_of(first)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
    at, before = 0, 8
    while at < alphabet and left:
        left -= 1
        entry = int(code.table[_peek(r, code.bits)])
        r.pos += entry >> 16
        s = entry & 0xFFFF
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
            continue
        count, value = {16: (3, 2), 17: (3, 3), 18: (11, 7)}[s]
        count += r.read(value)
        if at + count > alphabet:
            raise ValueError("too many code lengths")
        if s == 16:
            lengths[at : at + count] = [before] * count
        at += count
    return code_of(lengths)


def _peek(r: BitReader, n: int) -> int:
    at = r.pos >> 3
    return (int.from_bytes(r.data[at : at + 8], "little") >> (r.pos & 7)) & ((1 << n) - 1)


def code_lengths(weights: Sequence[float], most: int = 15) -> list[int]:
    """Huffman code lengths of at most ``most`` bits; symbols of weight 0 get none."""
    used = [(w, s) for s, w in enumerate(weights) if w > 0]
    lengths = [0] * len(weights)
    if len(used) == 1:
        lengths[used[0][1]] = 1
        return lengths
    floor = 0.0
    while True:
        heap = [(max(w, floor), i, [s]) for i, (w, s) in enumerate(used)]
        heapq.heapify(heap)
        depth = dict.fromkeys((s for _, s in used), 0)
        age = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], age, a[2] + b[2]))
            age += 1
        if not depth or max(depth.values()) <= most:
            for s, n in depth.items():
                lengths[s] = n
            return lengths
        floor = max(floor * 2, sum(w for w, _ in used) / 2**most)


def write_code(w: BitWriter, lengths: Sequence[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.write(1, 1)
        w.write(len(used) - 1, 1)
        w.write(1, 1)
        for s in used:
            w.write(s, 8)
        return
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    at = 0
    while at < len(lengths):
        run = 1
        while at + run < len(lengths) and lengths[at + run] == lengths[at]:
            run += 1
        n, left = lengths[at], run
        if n:
            tokens.append((n, 0, 0))
            left -= 1
        while left:
            if n == 0 and left >= 11:
                k = min(left, 138)
                tokens.append((18, k - 11, 7))
            elif n == 0 and left >= 3:
                k = min(left, 10)
                tokens.append((17, k - 3, 3))
            elif n and left >= 3:
                k = min(left, 6)
                tokens.append((16, k - 3, 2))
            else:
                k = 1
                tokens.append((n, 0, 0))
            left -= k
        at += run
    counts = [0] * 19
    for s, _, _ in tokens:
        counts[s] += 1
    if sum(c > 0 for c in counts) == 1:
        counts[0 if not counts[0] else 1] += 1
    first = code_lengths(counts, 7)
    last = max(i for i, k in enumerate(CODE_LENGTH_ORDER) if first[k]) + 1
    last = max(4, last)
    w.write(0, 1)
    w.write(last - 4, 4)
    for k in CODE_LENGTH_ORDER[:last]:
        w.write(first[k], 3)
    w.write(0, 1)
    codes = canonical(first)
    for s, extra, n in tokens:
        w.write(*codes[s])
        w.write(extra, n)


# Decoding


@dataclass
class Pixels:
    """Entropy-coded pixels: where they begin and how they are coded."""

    data: bytes
    pos: int
    width: int
    height: int
    groups: list[list[Code]]
    cache_bits: int = 0
    group_bits: int = 0
    group_map: np.ndarray | None = None


@dataclass
class Parsed:
    width: int
    height: int
    pixels: Pixels
    transforms: list[tuple] = field(default_factory=list)


def _blocks(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


def _read_pixels_header(r: BitReader, width: int, height: int, main: bool) -> Pixels:
    cache = r.read(4) if r.read(1) else 0
    if cache > 11:
        raise ValueError("bad size of the colour cache")
    bits, group_map, n = 0, None, 1
    if main and r.read(1):
        bits = r.read(3) + 2
        coded = _sub_image(r, _blocks(width, bits), _blocks(height, bits))
        group_map = ((coded >> 8) & 0xFFFF).astype(np.int64)
        n = int(group_map.max()) + 1
    sizes = (256 + LENGTH_CODES + (1 << cache if cache else 0), 256, 256, 256, DISTANCE_CODES)
    groups = [[read_code(r, s) for s in sizes] for _ in range(n)]
    return Pixels(r.data, r.pos, width, height, groups, cache, bits, group_map)


def _sub_image(r: BitReader, width: int, height: int) -> np.ndarray:
    p = _read_pixels_header(r, width, height, False)
    out, r.pos = _decode_one(p)
    return out


def _decode_one(p: Pixels) -> tuple[np.ndarray, int]:
    """ARGB pixels of one small image in one group of codes, and the bit after its last; a plain loop, as arrays don't pay for one image."""
    tables = [(c.table.tolist(), (1 << c.bits) - 1) for c in p.groups[0]]
    r, n, out = BitReader(p.data, p.pos), p.width * p.height, []
    cache, shift = [0] * (1 << p.cache_bits), 32 - p.cache_bits

    def symbol(k: int) -> int:
        table, mask = tables[k]
        if not mask:
            return table[0] & 0xFFFF
        entry = table[_peek(r, 16) & mask]
        r.pos += entry >> 16
        return entry & 0xFFFF

    def value(code: int) -> int:
        if code < 4:
            return code + 1
        extra = (code - 2) >> 1
        return ((2 + (code & 1)) << extra) + r.read(extra) + 1

    while len(out) < n:
        s, start = symbol(0), len(out)
        if s < 256:
            red, blue, alpha = symbol(1), symbol(2), symbol(3)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s >= 256 + LENGTH_CODES:
            out.append(cache[s - 256 - LENGTH_CODES])
        else:
            length, code = value(s - 256), value(symbol(4))
            x, y = NEAR[min(code, len(NEAR)) - 1]
            back = code - len(NEAR) if code > len(NEAR) else max(1, x + y * p.width)
            if back > len(out) or len(out) + length > n:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out.append(out[-back])
        if r.pos > 8 * len(p.data):
            raise ValueError("the image ends too early")
        if p.cache_bits:
            for pixel in out[start:]:
                cache[(pixel * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = pixel
    return np.array(out, np.uint32), r.pos


def parse(data: bytes) -> Parsed:
    """Header, transforms and prefix codes of a VP8L stream."""
    r = BitReader(data)
    if r.read(8) != SIGNATURE:
        raise ValueError("not a lossless WebP stream")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    known = _known(data)
    if known is not None:
        return Parsed(width, height, Pixels(data, known[0], width, height, known[1], known[2]))
    transforms: list[tuple] = []
    coded = width
    while r.read(1):
        kind = r.read(2)
        if kind in {t[0] for t in transforms}:
            raise ValueError("a transform is there twice")
        if kind in (0, 1):
            bits = r.read(3) + 2
            transforms.append((kind, coded, bits, _sub_image(r, _blocks(coded, bits), _blocks(height, bits))))
        elif kind == 2:
            transforms.append((2, coded))
        else:
            size = r.read(8) + 1
            table = _channels(_sub_image(r, size, 1))
            table = np.cumsum(table, axis=0, dtype=np.int64).astype(np.uint8)
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            transforms.append((3, coded, packed, table))
            coded = _blocks(coded, packed)
    pixels = _read_pixels_header(r, coded, height, True)
    if not transforms and pixels.group_map is None:
        _remember(data, pixels)
    return Parsed(width, height, pixels, transforms)


#: Prefix codes of headers seen before: (bits, whole bytes, last bits) -> codes. A header has them from bit 40.
_headers: dict[tuple, tuple] = {}


def _remember(data: bytes, p: Pixels) -> None:
    if len(_headers) >= 8:
        _headers.clear()
    whole, rest = divmod(p.pos, 8)
    _headers[(p.pos, data[5:whole], data[whole] & ((1 << rest) - 1) if rest else 0)] = (p.groups, p.cache_bits)


def _known(data: bytes):
    for (pos, head, last), (groups, cache) in _headers.items():
        whole, rest = divmod(pos, 8)
        if data.startswith(head, 5) and (not rest or len(data) > whole and data[whole] & ((1 << rest) - 1) == last):
            return pos, groups, cache
    return None


def decode_pixels(images: list[Pixels]) -> tuple[list[np.ndarray], list[int]]:
    """ARGB pixels of each image in order of rows, and the bit after its last."""
    order = sorted(range(len(images)), key=lambda i: -images[i].width * images[i].height)
    lanes = [images[i] for i in order]
    sizes = np.array([p.width * p.height for p in lanes], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(base[-1]), np.uint32)
    ob = base[:-1]
    pad = b"\0" * 16
    starts = np.concatenate([[0], np.cumsum([len(p.data) + 16 for p in lanes])]).astype(np.int64)
    stream = b"".join(x for p in lanes for x in (p.data, pad))
    bits64 = np.ndarray((len(stream) - 8,), np.dtype("<u8"), stream, 0, (1,))
    pos = 8 * starts[:-1] + np.array([p.pos for p in lanes], np.int64)
    limit = 8 * (starts[:-1] + np.array([len(p.data) for p in lanes], np.int64))
    # All tables in one array; equal tables once.
    place: dict[int, int] = {}
    tables: list[np.ndarray] = []
    length = 0
    first_group, rows = [], []
    seen_groups: dict[int, int] = {}
    for p in lanes:
        if id(p.groups) not in seen_groups:
            seen_groups[id(p.groups)] = len(rows)
            for g in p.groups:
                row = []
                for c in g:
                    if id(c) not in place:
                        place[id(c)] = length
                        tables.append(c.table)
                        length += len(c.table)
                    row.append((place[id(c)], (1 << c.bits) - 1))
                rows.append(row)
        first_group.append(seen_groups[id(p.groups)])
    table = np.concatenate(tables)
    offset, mask = (np.ascontiguousarray(x) for x in np.array(rows, np.int64).reshape(-1, 5, 2).transpose(2, 1, 0))
    group = np.array(first_group, np.int64)
    mapped = any(p.group_map is not None for p in lanes)
    width = np.array([p.width for p in lanes], np.int64)
    if mapped:
        maps = [p.group_map if p.group_map is not None else np.zeros(1, np.int64) for p in lanes]
        map_at = np.concatenate([[0], np.cumsum([len(m) for m in maps])])[:-1].astype(np.int64)
        flat_map = np.concatenate(maps)
        map_bits = np.array([p.group_bits if p.group_map is not None else 40 for p in lanes], np.int64)
        map_width = np.array([_blocks(p.width, p.group_bits) if p.group_map is not None else 1 for p in lanes], np.int64)
    plain_alpha = not mapped and bool((mask[3, group] == 0).all())
    alpha = (table[offset[3, group]] & 0xFF).astype(np.uint32) << np.uint32(24) if plain_alpha else None
    cached = np.array([p.cache_bits for p in lanes], np.int64)
    any_cache, all_cache = bool(cached.any()), bool(cached.all())
    slot_base = np.concatenate([[0], np.cumsum(np.where(cached > 0, 1 << cached, 1))]).astype(np.int64)
    cache = np.zeros(int(slot_base[-1]), np.uint32)
    slot_base, cache_shift = slot_base[:-1], (32 - cached).astype(np.uint64)
    copy = np.zeros(len(lanes), np.int64)
    dist = np.ones(len(lanes), np.int64)
    copying = 0
    steps = int(sizes[0]) if len(lanes) else 0
    # Lanes with pixels left at step t.
    alive = len(lanes) - np.searchsorted(sizes[::-1], np.arange(steps), side="right")
    seven, byte, low16 = np.int64(7), np.int64(255), np.int64(0xFFFF)

    def window(at: np.ndarray) -> np.ndarray:
        return (bits64[at >> 3] >> (at & seven).astype(np.uint64)).astype(np.int64) & np.int64(0x1FFFFFFFFFFFFF)

    for t in range(steps):
        m = int(alive[t])
        if copying:
            reading = np.flatnonzero(copy[:m] == 0)
            everyone = len(reading) == m
        else:
            everyone = True
        at = pos[:m] if everyone else pos[reading]
        if everyone or len(reading):
            if mapped:
                lane = np.arange(m) if everyone else reading
                x, y, b = t % width[lane], t // width[lane], map_bits[lane]
                g = group[lane] + flat_map[map_at[lane] + (y >> b) * map_width[lane] + (x >> b)]
            else:
                g = group[:m] if everyone else group[reading]
            win = window(at)
            entry = table[offset[0, g] + (win & mask[0, g])]
            n = entry >> 16
            symbol = entry & low16
            literal = symbol < 256
            win >>= n
            used = n
            red = table[offset[1, g] + (win & mask[1, g])]
            n = red >> 16
            win >>= n
            used = used + n
            blue = table[offset[2, g] + (win & mask[2, g])]
            used = used + (blue >> 16)
            pixel = ((red & byte) << 16 | symbol << 8 | (blue & byte)).astype(np.uint32)
            if plain_alpha:
                pixel |= alpha[:m] if everyone else alpha[reading]
            else:
                a = table[offset[3, g] + (window(at + used) & mask[3, g])]
                used = used + (a >> 16)
                pixel |= (a & byte).astype(np.uint32) << np.uint32(24)
            if not literal.all():
                other = np.flatnonzero(~literal)
                used[other] = entry[other] >> 16
                lane = other if everyone else reading[other]
                s = symbol[other]
                hit = s >= 256 + LENGTH_CODES
                if hit.any():
                    pixel[other[hit]] = cache[slot_base[lane[hit]] + s[hit] - 256 - LENGTH_CODES]
                if not hit.all():
                    ref, lane, gr = other[~hit], lane[~hit], g[other[~hit]]
                    here = at[ref] + used[ref]
                    length_, here = _prefixed(s[~hit] - 256, here, window)
                    far = table[offset[4, gr] + (window(here) & mask[4, gr])]
                    here = here + (far >> 16)
                    code, here = _prefixed(far & low16, here, window)
                    near = np.minimum(code, len(NEAR)) - 1
                    d = np.where(code > len(NEAR), code - len(NEAR), np.maximum(1, NEAR_X[near] + NEAR_Y[near] * width[lane]))
                    if (d > t).any() or (t + length_ > sizes[lane]).any():
                        raise ValueError("a back-reference leaves the image")
                    copy[lane], dist[lane] = length_, d
                    copying = 1
                    used[ref] = here - at[ref]
            if everyone:
                pos[:m] += used
            else:
                pos[reading] += used
        if copying:
            now = pixel if everyone else np.zeros(m, np.uint32)
            if not everyone and len(reading):
                now[reading] = pixel
            busy = np.flatnonzero(copy[:m])
            now[busy] = out[ob[busy] + t - dist[busy]]
            copy[busy] -= 1
            copying = int(copy.any())
        else:
            now = pixel
        out[ob[:m] + t] = now
        if any_cache:
            if all_cache:
                cache[slot_base[:m] + (((now.astype(np.uint64) * np.uint64(CACHE_FACTOR)) & np.uint64(0xFFFFFFFF)) >> cache_shift[:m]).astype(np.int64)] = now
            else:
                c = np.flatnonzero(cached[:m])
                cache[slot_base[c] + (((now[c].astype(np.uint64) * np.uint64(CACHE_FACTOR)) & np.uint64(0xFFFFFFFF)) >> cache_shift[c]).astype(np.int64)] = now[c]
        if t & 255 == 255 and (pos > limit).any():
            raise ValueError("the image ends too early")
    if (pos > limit).any():
        raise ValueError("the image ends too early")
    found: list = [None] * len(lanes)
    ends = [0] * len(lanes)
    for k, i in enumerate(order):
        found[i] = out[base[k] : base[k + 1]]
        ends[i] = int(pos[k] - 8 * starts[k])
    return found, ends


def _prefixed(code: np.ndarray, at: np.ndarray, window) -> tuple[np.ndarray, np.ndarray]:
    """Values of length or distance codes with their extra bits, from 1, and the places after them."""
    extra = np.where(code < 4, 0, (code - 2) >> 1)
    value = np.where(code < 4, code, ((2 + (code & 1)) << extra) + (window(at) & ((np.int64(1) << extra) - 1)))
    return value + 1, at + extra


def _channels(argb: np.ndarray) -> np.ndarray:
    """(pixels, 4) bytes in the order blue, green, red, alpha."""
    return argb.astype("<u4").view(np.uint8).reshape(-1, 4)


def _inverse_predictor(jobs: list[tuple[np.ndarray, int, int, np.ndarray]]) -> list[np.ndarray]:
    """Undo the predictor for a batch of (residual channels, width, block bits, mode image), in step."""
    order = sorted(range(len(jobs)), key=lambda i: -len(jobs[i][0]))
    sizes = np.array([len(jobs[i][0]) for i in order], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = np.concatenate([jobs[i][0] for i in order]).astype(np.int16)
    width, bits = (np.array([jobs[i][k] for i in order], np.int64) for k in (1, 2))
    modes = np.concatenate([(jobs[i][3] >> 8) & 0xF for i in order]).astype(np.int64)
    mode_at = np.concatenate([[0], np.cumsum([len(jobs[i][3]) for i in order])])[:-1].astype(np.int64)
    across = np.array([_blocks(jobs[i][1], jobs[i][2]) for i in order], np.int64)
    black = np.array([0, 0, 0, 255], np.int16)

    def mean(a, b):
        return (a + b) >> 1

    for t in range(int(sizes[0]) if len(order) else 0):
        m = int(len(sizes) - np.searchsorted(sizes[::-1], t, side="right"))
        w, here = width[:m], base[:m] + t
        x, y = t % w, t // w
        mode = modes[mode_at[:m] + (y >> bits[:m]) * across[:m] + (x >> bits[:m])]
        mode = np.where(y == 0, 1, np.where(x == 0, 2, mode)) if t else np.zeros(m, np.int64)
        for k in np.unique(mode):
            i = here[mode == k]
            wi = w[mode == k]
            left, top, right, corner = (out[np.maximum(i - d, 0)] for d in (1, wi, wi - 1, wi + 1))
            if k == 1:
                p = left
            elif k == 2:
                p = top
            elif k == 3:
                p = right
            elif k == 4:
                p = corner
            elif k == 5:
                p = mean(mean(left, right), top)
            elif k == 6:
                p = mean(left, corner)
            elif k == 7:
                p = mean(left, top)
            elif k == 8:
                p = mean(corner, top)
            elif k == 9:
                p = mean(top, right)
            elif k == 10:
                p = mean(mean(left, corner), mean(top, right))
            elif k == 11:
                to_left = np.abs(top - corner).sum(axis=1)
                to_top = np.abs(left - corner).sum(axis=1)
                p = np.where((to_left < to_top)[:, None], left, top)
            elif k == 12:
                p = np.clip(left + top - corner, 0, 255)
            elif k == 13:
                a = mean(left, top)
                half = a - corner
                p = np.clip(a + np.sign(half) * (np.abs(half) >> 1), 0, 255)
            else:
                p = black
            out[i] = (out[i] + p) & 255
    found: list = [None] * len(jobs)
    for k, i in enumerate(order):
        found[i] = out[base[k] : base[k + 1]].astype(np.uint8)
    return found


def _inverse_cross_colour(c: np.ndarray, width: int, bits: int, element: np.ndarray) -> np.ndarray:
    i = np.arange(len(c))
    e = _channels(element).view(np.int8).astype(np.int32)[(i // width >> bits) * _blocks(width, bits) + (i % width >> bits)]
    signed = c.view(np.int8).astype(np.int32)
    out = c.astype(np.int32)
    out[:, 2] += (e[:, 0] * signed[:, 1]) >> 5
    red = (out[:, 2] & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    out[:, 0] += ((e[:, 1] * signed[:, 1]) >> 5) + ((e[:, 2] * red) >> 5)
    return (out & 255).astype(np.uint8)


def _inverse_palette(c: np.ndarray, width: int, packed: int, table: np.ndarray) -> np.ndarray:
    each = 8 >> packed
    coded = _blocks(width, packed)
    rows = c[:, 1].reshape(-1, coded)
    x = np.arange(width)
    index = (rows[:, x >> packed] >> ((x & ((1 << packed) - 1)) * each)) & ((1 << each) - 1)
    full = np.zeros((256, 4), np.uint8)
    full[: len(table)] = table
    return full[index.reshape(-1)]


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """(height, width, 4) arrays of red, green, blue and alpha for VP8L streams."""
    parsed = [parse(s) for s in streams]
    pixels, _ = decode_pixels([p.pixels for p in parsed])
    planes = [_channels(x) for x in pixels]
    left = [list(p.transforms) for p in parsed]
    while any(left):
        jobs = [i for i, t in enumerate(left) if t and t[-1][0] == 0]
        if jobs:
            done = _inverse_predictor([(planes[i], *left[i][-1][1:]) for i in jobs])
            for i, d in zip(jobs, done, strict=True):
                planes[i] = d
                left[i].pop()
        for i, todo in enumerate(left):
            while todo and todo[-1][0]:
                kind, width, *rest = todo.pop()
                if kind == 1:
                    planes[i] = _inverse_cross_colour(np.ascontiguousarray(planes[i]), width, *rest)
                elif kind == 2:
                    c = planes[i].copy()
                    c[:, 0] += c[:, 1]
                    c[:, 2] += c[:, 1]
                    planes[i] = c
                else:
                    planes[i] = _inverse_palette(planes[i], width, *rest)
    return [p[:, [2, 1, 0, 3]].reshape(x.height, x.width, 4) for p, x in zip(planes, parsed, strict=True)]


def streams_of(media: bytes) -> list[bytes]:
    """The VP8L streams of WebP files that stand one after the other."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        chunk = at + 12
        while chunk + 8 <= end:
            name, size = media[chunk : chunk + 4], struct.unpack_from("<I", media, chunk + 4)[0]
            if name == b"VP8L":
                out.append(media[chunk + 8 : chunk + 8 + size])
            chunk += 8 + size + (size & 1)
        at = end + (end - at & 1)
    return out


def riff(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


# Encoding of byte payloads

#: Pixels of a row, and rows of an image at most; a longer payload takes several images.
WIDTH, ROWS = 64, 64
CACHE_BITS = 8
#: Equal pixels in a row from which a run is written as a back-reference.
LEAST_RUN = 5
#: Bytes of text from the most to the least frequent, as the static codes expect them.
FREQUENT = b" etnoiashrdlucmfwgypbvk,.\n-jxqz\xc3\xa9\xa8\xad\xb3\xbc\xa4\xb6\xaa\xb1\xa7\xa1\x9f"


def _static_lengths() -> tuple[list[int], list[int]]:
    weight = [2e-5] * 256
    for b in range(33, 127):
        weight[b] = 6e-4
    for b in range(128, 192):
        weight[b] = 3e-4
    for i, b in enumerate(FREQUENT):
        weight[b] = 1 / (i + 4) ** 1.3
        if 97 <= b <= 122:
            weight[b - 32] = weight[b] / 25
    total = sum(weight)
    share = [w / total for w in weight]
    run = [1e-4] * LENGTH_CODES
    return code_lengths([0.75 * s for s in share] + run + [0.25 / (1 << CACHE_BITS)] * (1 << CACHE_BITS)), code_lengths(share)


class _Encoder:
    def __init__(self):
        green, other = _static_lengths()
        w = BitWriter()
        w.write(0, 1)  # no transform
        w.write(1, 1)
        w.write(CACHE_BITS, 4)
        w.write(0, 1)  # one group of codes
        one = [0] * 256
        one[255] = 1
        distance = [0] * DISTANCE_CODES
        distance[1] = 1  # the pixel to the left
        for lengths in (green, other, other, one, distance):
            write_code(w, lengths)
        self.head, self.head_bits = w.value, w.size
        self.green = self._arrays(green)
        self.other = self._arrays(other)

    @staticmethod
    def _arrays(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        codes = canonical(lengths)
        return tuple(np.array([codes.get(s, (0, 0))[k] for s in range(len(lengths))], np.uint64) for k in (0, 1))

    def encode(self, rgb: np.ndarray) -> bytes:
        """The stream of an image of ``WIDTH`` columns from its (pixels, 3) bytes."""
        p = rgb.astype(np.uint32)
        pixel = np.uint32(0xFF000000) | p[:, 0] << np.uint32(16) | p[:, 1] << np.uint32(8) | p[:, 2]
        n = len(pixel)
        slot = ((pixel.astype(np.uint64) * np.uint64(CACHE_FACTOR)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE_BITS)
        slot = slot.astype(np.int64)
        order = np.argsort(slot, kind="stable")
        hit = np.zeros(n, bool)
        hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (pixel[order[1:]] == pixel[order[:-1]])
        g_code, g_len = self.green
        o_code, o_len = self.other
        green, red, blue = rgb[:, 1].astype(np.int64), rgb[:, 0].astype(np.int64), rgb[:, 2].astype(np.int64)
        value = g_code[green] | o_code[red] << g_len[green] | o_code[blue] << (g_len[green] + o_len[red])
        size = g_len[green] + o_len[red] + o_len[blue]
        at_cache = 256 + LENGTH_CODES + slot
        value, size = np.where(hit, g_code[at_cache], value), np.where(hit, g_len[at_cache], size)
        start = np.flatnonzero(np.concatenate([[True], pixel[1:] != pixel[:-1]]))
        run = np.diff(np.concatenate([start, [n]]))
        long = run >= LEAST_RUN
        if long.any():
            keep = np.ones(n, bool)
            for s, k in zip(start[long].tolist(), run[long].tolist(), strict=True):
                keep[s + 2 : s + k] = False
                code, extra_bits, extra = self._length(k - 1)
                value[s + 1] = int(g_code[256 + code]) | extra << int(g_len[256 + code])
                size[s + 1] = int(g_len[256 + code]) + extra_bits
            value, size = value[keep], size[keep]
        return self._pack(n // WIDTH, value, size)

    @staticmethod
    def _length(k: int) -> tuple[int, int, int]:
        v = k - 1
        if v < 4:
            return v, 0, 0
        high = v.bit_length() - 1
        second = (v >> (high - 1)) & 1
        return 2 * high + second, high - 1, v & ((1 << (high - 1)) - 1)

    def _pack(self, rows: int, value: np.ndarray, size: np.ndarray) -> bytes:
        front = SIGNATURE | (WIDTH - 1) << 8 | (rows - 1) << 22 | self.head << 40
        front_bits = 40 + self.head_bits
        words = -(-front_bits // 64)
        at = np.uint64(front_bits) + np.concatenate([np.zeros(1, np.uint64), np.cumsum(size, dtype=np.uint64)])
        out = np.zeros((int(at[-1]) >> 6) + 2, np.uint64)
        out[:words] = np.frombuffer(front.to_bytes(8 * words, "little"), "<u8")
        word, shift = (at[:-1] >> np.uint64(6)).astype(np.int64), at[:-1] & np.uint64(63)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] |= np.bitwise_or.reduceat(value << shift, first)
        high = np.where(shift > 0, value >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        out[word[first] + 1] |= np.bitwise_or.reduceat(high, first)
        return out.tobytes()[: (int(at[-1]) + 7) // 8]


_encoder: list[_Encoder] = []


def encode_payload(payload: bytes) -> bytes:
    """WebP files, one after the other, that hold a payload of a positive multiple of 192 bytes as RGB pixels.

    Each image takes the smaller of two forms: static codes without transforms, or the best transforms.
    """
    from fundloom.llm.webp_forward import smaller_stream

    if not _encoder:
        _encoder.append(_Encoder())
    rgb = np.frombuffer(payload, np.uint8).reshape(-1, 3)
    step = WIDTH * ROWS
    parts = (rgb[i : i + step] for i in range(0, len(rgb), step))
    return b"".join(riff(smaller_stream(p, WIDTH, _encoder[0].encode(p))) for p in parts)


def decode_payloads(media: list[bytes]) -> list[np.ndarray]:
    """The (pixels, 3) RGB bytes of each payload, its images joined."""
    streams = [streams_of(m) for m in media]
    images = decode([s for x in streams for s in x])
    out, at = [], 0
    for x in streams:
        out.append(np.concatenate([i.reshape(-1, 4)[:, :3] for i in images[at : at + len(x)]]))
        at += len(x)
    return out
