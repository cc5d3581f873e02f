"""Forward transforms of lossless WebP images, and their choice by size.

An image may be written through the palette transform, through the predictor,
the cross-colour transform or both, or without any. The size of each form is
estimated by the entropy of its channels; the best is written with prefix
codes of its own and kept where it is smaller than the image without
transforms in static codes.
"""

from __future__ import annotations

import numpy as np

from fundloom.llm.webp import DISTANCE_CODES, LENGTH_CODES, SIGNATURE, BitWriter, _blocks, canonical, code_lengths, write_code

#: Share of the plain size under which another form is tried, as reading codes of an image's own takes time.
WORTH = 0.8
#: Bits of the prefix codes of an image, about.
CODES = 500
#: Columns and rows of a predictor block, and of a cross-colour block, as powers of two.
PREDICTOR_BITS, CROSS_BITS = 4, 6
LEAST_RUN = 5
#: Bytes of an image in static codes from which other forms are tried, and rows that tell whether one is worth it.
LEAST_BYTES, SAMPLE_ROWS = 900, 16
_PLANES = 256 * np.arange(3)[:, None]


def _entropy(values: np.ndarray) -> float:
    counts = np.bincount(values)
    counts = counts[counts > 0]
    return float((counts * np.log2(len(values) / counts)).sum())


def _bits(bgra: np.ndarray) -> float:
    return sum(_entropy(bgra[:, k]) for k in range(3))


def _argb(bgra: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(bgra).view("<u4").reshape(-1)


def predicted(bgra: np.ndarray, width: int, mode: int) -> np.ndarray:
    """Each pixel as predictor ``mode`` has it from pixels before it; the first row and column as the format fixes them."""
    c = bgra.astype(np.int16)
    i = np.arange(len(c))
    left, top, right, corner = (c[np.maximum(i - d, 0)] for d in (1, width, width - 1, width + 1))

    def mean(a, b):
        return (a + b) >> 1

    black = np.broadcast_to(np.array([0, 0, 0, 255], np.int16), c.shape)
    if mode == 11:
        near_left = np.abs(top - corner).sum(axis=1) < np.abs(left - corner).sum(axis=1)
        p = np.where(near_left[:, None], left, top)
    elif mode == 13:
        half = mean(left, top) - corner
        p = np.clip(mean(left, top) + np.sign(half) * (np.abs(half) >> 1), 0, 255)
    else:
        p = {
            0: lambda: black,
            1: lambda: left,
            2: lambda: top,
            3: lambda: right,
            4: lambda: corner,
            5: lambda: mean(mean(left, right), top),
            6: lambda: mean(left, corner),
            7: lambda: mean(left, top),
            8: lambda: mean(corner, top),
            9: lambda: mean(top, right),
            10: lambda: mean(mean(left, corner), mean(top, right)),
            12: lambda: np.clip(left + top - corner, 0, 255),
        }[mode]()
    p = np.where((i % width == 0)[:, None], top, p)
    p = np.where((i < width)[:, None], left, p)
    return np.concatenate([black[:1], p[1:]])


def forward_predictor(bgra: np.ndarray, width: int, bits: int = PREDICTOR_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(residuals, ARGB image of the modes): for each block the mode with the least sum of absolute residuals."""
    i = np.arange(len(bgra))
    block = (i // width >> bits) * _blocks(width, bits) + (i % width >> bits)
    residuals, sums = [], []
    for mode in range(14):
        r = (bgra.astype(np.int16) - predicted(bgra, width, mode)).astype(np.uint8)
        residuals.append(r)
        sums.append(np.bincount(block, np.abs(r.view(np.int8).astype(np.int32)).sum(axis=1)))
    best = np.argmin(np.array(sums), axis=0)
    out = np.array(residuals)[best[block], i]
    return out, (np.uint32(0xFF000000) | best.astype(np.uint32) << np.uint32(8)).astype(np.uint32)


def forward_cross_colour(bgra: np.ndarray, width: int, bits: int = CROSS_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(residuals, ARGB image of the multipliers): red without its share of green, blue without those of green and red, by least squares in each block."""
    i = np.arange(len(bgra))
    block = (i // width >> bits) * _blocks(width, bits) + (i % width >> bits)
    blue, green, red = (bgra[:, k].view(np.int8).astype(np.int32) for k in range(3))

    def factor(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(32 * np.bincount(block, y * x) / np.maximum(1, np.bincount(block, x * x))), -128, 127).astype(np.int32)

    by_green = factor(red, green)
    out = bgra.astype(np.int32)
    out[:, 2] -= (by_green[block] * green) >> 5
    blue_by_green = factor(blue, green)
    rest = blue - ((blue_by_green[block] * green) >> 5)
    blue_by_red = factor(rest, red)
    out[:, 0] -= ((blue_by_green[block] * green) >> 5) + ((blue_by_red[block] * red) >> 5)
    element = np.stack([by_green & 255, blue_by_green & 255, blue_by_red & 255, np.full(len(by_green), 255)], axis=1).astype(np.uint8)
    return (out & 255).astype(np.uint8), _argb(element)


def forward_palette(bgra: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int] | None:
    """(ARGB pixels of packed indexes, the palette's differences, bits of packing), or None beyond 256 colours."""
    colours, index = np.unique(_argb(bgra), return_inverse=True)
    if len(colours) > 256:
        return None
    packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
    each, across = 8 >> packed, _blocks(width, packed)
    rows = np.zeros((len(index) // width, across << packed), np.uint32)
    rows[:, :width] = index.reshape(-1, width)
    rows = rows.reshape(len(rows), across, 1 << packed)
    green = (rows << (each * np.arange(1 << packed, dtype=np.uint32))).sum(axis=2, dtype=np.uint32).reshape(-1)
    table = colours.astype("<u4").view(np.uint8).reshape(-1, 4)
    steps = np.concatenate([table[:1], np.diff(table, axis=0)])
    return np.uint32(0xFF000000) | green << np.uint32(8), _argb(steps), packed


def write_pixels(w: BitWriter, argb: np.ndarray, main: bool) -> None:
    """Pixels without a colour cache, in one group of codes of their own; runs are back-references to the pixel before."""
    w.write(0, 1)
    if main:
        w.write(0, 1)
    start = np.flatnonzero(np.concatenate([[True], argb[1:] != argb[:-1]]))
    run = np.diff(np.concatenate([start, [len(argb)]]))
    long = run > LEAST_RUN
    literal = np.ones(len(argb), bool)
    copies: list[tuple[int, int, int, int]] = []  # (place, symbol of the length, extra, bits of it)
    for s, k in zip(start[long].tolist(), run[long].tolist(), strict=True):
        literal[s + 1 : s + k] = False
        at = s + 1
        while at < s + k:
            part = min(s + k - at, 4096)
            v = part - 1
            if v < 4:
                copies.append((at, 256 + v, 0, 0))
            else:
                high = v.bit_length() - 1
                copies.append((at, 256 + 2 * high + (v >> (high - 1) & 1), v & ((1 << (high - 1)) - 1), high - 1))
            at += part
    places = np.flatnonzero(literal)
    pixel = argb[places]
    channels = [(pixel >> np.uint32(shift) & np.uint32(255)).astype(np.int64) for shift in (8, 16, 0, 24)]
    where, symbol, extra, bits = (np.array(c, np.int64) for c in (zip(*copies, strict=True) if copies else [[]] * 4))
    counts = [np.bincount(c, minlength=n) for c, n in zip(channels, (256 + LENGTH_CODES, 256, 256, 256), strict=True)]
    counts[0] += np.bincount(symbol, minlength=256 + LENGTH_CODES)
    counts.append(np.bincount(np.ones(len(copies), np.int64), minlength=DISTANCE_CODES))  # the pixel to the left
    codes = []
    for c in counts:
        if not c.any() or (np.count_nonzero(c) == 1 and c[256:].any()):
            c[0] = max(1, int(c[0]))
        lengths = code_lengths(c.tolist())
        write_code(w, lengths)
        known = canonical(lengths) if sum(n > 0 for n in lengths) > 1 else {}
        codes.append(tuple(np.array([known.get(s, (0, 0))[k] for s in range(len(c))], np.uint64) for k in (0, 1)))
    value, size = np.zeros(len(places), np.uint64), np.zeros(len(places), np.uint64)
    for c, (code, length) in zip(channels, codes, strict=False):
        value |= code[c] << size
        size += length[c]
    (g_code, g_length), (d_code, d_length) = codes[0], codes[4]
    copy_value = g_code[symbol] | extra.astype(np.uint64) << g_length[symbol] | d_code[1] << (g_length[symbol] + bits.astype(np.uint64))
    copy_size = g_length[symbol] + bits.astype(np.uint64) + d_length[1]
    order = np.argsort(np.concatenate([places, where]), kind="stable")
    w.write(*_joined(np.concatenate([value, copy_value])[order], np.concatenate([size, copy_size])[order]))


def _joined(value: np.ndarray, size: np.ndarray) -> tuple[int, int]:
    """Values of up to 64 bits, one after the other from the lowest bit, as one number, and its bits."""
    at = np.concatenate([np.zeros(1, np.uint64), np.cumsum(size, dtype=np.uint64)])
    out = np.zeros((int(at[-1]) >> 6) + 2, np.uint64)
    word, shift = (at[:-1] >> np.uint64(6)).astype(np.int64), at[:-1] & np.uint64(63)
    if len(word):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] |= np.bitwise_or.reduceat(value << shift, first)
        high = np.where(shift > 0, value >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        out[word[first] + 1] |= np.bitwise_or.reduceat(high, first)
    return int.from_bytes(out.tobytes(), "little"), int(at[-1])


def write_stream(bgra: np.ndarray, width: int, transforms: tuple[str, ...]) -> bytes:
    """A VP8L stream of (pixels, 4) bytes through ``transforms``, in this order, of "palette", "predictor", "cross", "green"."""
    w = BitWriter()
    w.write(SIGNATURE, 8)
    w.write(width - 1, 14)
    w.write(len(bgra) // width - 1, 14)
    w.write(1, 1)
    w.write(0, 3)
    argb = None
    for name in transforms:
        w.write(1, 1)
        if name == "palette":
            argb, table, _ = forward_palette(bgra, width)
            w.write(3, 2)
            w.write(len(table) - 1, 8)
            write_pixels(w, table, False)
        elif name == "green":
            w.write(2, 2)
            bgra = bgra.copy()
            bgra[:, 0] -= bgra[:, 1]
            bgra[:, 2] -= bgra[:, 1]
        else:
            kind, bits, forward = (0, PREDICTOR_BITS, forward_predictor) if name == "predictor" else (1, CROSS_BITS, forward_cross_colour)
            bgra, image = forward(bgra, width, bits)
            w.write(kind, 2)
            w.write(bits - 2, 3)
            write_pixels(w, image, False)
    w.write(0, 1)
    write_pixels(w, _argb(bgra) if argb is None else argb, True)
    return w.data()


def best_transforms(bgra: np.ndarray, width: int) -> tuple[tuple[str, ...], float]:
    """The transforms with the least estimated bits, and these."""
    found: list[tuple[float, tuple[str, ...]]] = []
    palette = forward_palette(bgra, width)
    if palette is not None:
        index = (palette[0] >> np.uint32(8) & np.uint32(255)).astype(np.int64)
        found.append((_entropy(index) + 22 * len(palette[1]) + CODES, ("palette",)))
    plain = _bits(bgra)
    # Left and top tell whether prediction is worth a trial of all modes.
    tried = min(_bits((bgra.astype(np.int16) - predicted(bgra, width, m)).astype(np.uint8)) for m in (1, 2))
    if tried < plain:
        rest, _ = forward_predictor(bgra, width)
        found.append((_bits(rest) + 2 * CODES, ("predictor",)))
        found.append((_bits(forward_cross_colour(rest, width)[0]) + 3 * CODES, ("predictor", "cross")))
    found.append((_bits(forward_cross_colour(bgra, width)[0]) + 2 * CODES, ("cross",)))
    bits, names = min(found)
    return names, bits


def _promising(bgra: np.ndarray, width: int, limit: float) -> bool:
    """Whether the first rows look as if some form took fewer than ``limit`` bits for the image; this costs little."""
    n = len(bgra)
    sample = bgra[: SAMPLE_ROWS * width]
    m = len(sample)
    share = n / m
    argb = _argb(sample)
    ordered = np.sort(argb)
    colours = 1 + int(np.count_nonzero(ordered[1:] != ordered[:-1]))
    if colours <= 256 and colours * 22 + CODES < limit:
        counts = np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])))
        if float((counts * np.log2(m / counts)).sum()) * share + 22 * colours + CODES < limit:
            return True
    channels = sample[:, :3].T.astype(np.int16)
    left = channels[:, 1:] - channels[:, :-1]
    top = channels[:, width:] - channels[:, :-width]
    green = channels - channels[1]
    # Each difference of channels in a range of its own, so one count serves all.
    for rest, codes in ((left, 2), (top, 2), (green, 2)):
        k = rest.shape[1]
        if k:
            counts = np.bincount((rest.astype(np.uint8).astype(np.int64) + _PLANES).ravel(), minlength=768)
            counts = counts[counts > 0]
            if float((counts * np.log2(k / counts)).sum()) * n / k + codes * CODES < limit:
                return True
    return False


def smaller_stream(rgb: np.ndarray, width: int, plain: bytes) -> bytes:
    """``plain``, or the stream through the best transforms where that is smaller.

    Small images keep their static codes: what they could save is less than
    reading codes of their own costs.
    """
    limit = WORTH * 8 * len(plain)
    if len(plain) < LEAST_BYTES:
        return plain
    bgra = np.empty((len(rgb), 4), np.uint8)
    bgra[:, :3], bgra[:, 3] = rgb[:, ::-1], 255
    if not _promising(bgra, width, limit):
        return plain
    names, bits = best_transforms(bgra, width)
    if bits >= limit:
        return plain
    other = write_stream(bgra, width, names)
    return other if len(other) < len(plain) else plain
