"""The WebP decoder against a plain-loop decoder of the format, on streams through every transform."""

import numpy as np
import pytest

from fundloom.llm import webp, webp_forward


def signed(v):
    return v - 256 if v > 127 else v


def loop_predictor(c, width, bits, modes):
    """Residual pixels (lists of blue, green, red, alpha) to pixels, one by one."""
    out = []
    across = -(-width // (1 << bits))
    for i, residual in enumerate(c):
        x, y = i % width, i // width
        mode = int(modes[(y >> bits) * across + (x >> bits)]) >> 8 & 15
        left = out[i - 1] if i else None
        top, right, corner = (out[i - d] if i >= d > 0 else None for d in (width, width - 1, width + 1))
        mean = lambda a, b: [(p + q) // 2 for p, q in zip(a, b)]
        if i == 0:
            p = [0, 0, 0, 255]
        elif y == 0:
            p = left
        elif x == 0:
            p = top
        elif mode == 0:
            p = [0, 0, 0, 255]
        elif mode == 11:
            guess = [a + b - k for a, b, k in zip(left, top, corner)]
            far_left = sum(abs(g - a) for g, a in zip(guess, left))
            far_top = sum(abs(g - b) for g, b in zip(guess, top))
            p = left if far_left < far_top else top
        elif mode == 12:
            p = [max(0, min(255, a + b - k)) for a, b, k in zip(left, top, corner)]
        elif mode == 13:
            p = [max(0, min(255, m + int((m - k) / 2))) for m, k in zip(mean(left, top), corner)]
        else:
            p = {1: left, 2: top, 3: right, 4: corner, 5: mean(mean(left, right), top), 6: mean(left, corner), 7: mean(left, top), 8: mean(corner, top), 9: mean(top, right), 10: mean(mean(left, corner), mean(top, right))}[mode]
        out.append([(r + q) % 256 for r, q in zip(residual, p)])
    return out


def loop_cross(c, width, bits, elements):
    out, across = [], -(-width // (1 << bits))
    for i, (b, g, r, a) in enumerate(c):
        e = int(elements[(i // width >> bits) * across + (i % width >> bits)])
        green_red, green_blue, red_blue = signed(e & 255), signed(e >> 8 & 255), signed(e >> 16 & 255)
        r = (r + (green_red * signed(g) >> 5)) % 256
        b = (b + (green_blue * signed(g) >> 5) + (red_blue * signed(r) >> 5)) % 256
        out.append([b, g, r, a])
    return out


def pictures():
    rng = np.random.default_rng(11)
    y, x = np.mgrid[0:37, 0:45]
    smooth = np.stack([x * 3 + y, x + y * 2, 255 - x * 2, np.full_like(x, 255)], axis=2)
    yield 45, (smooth + rng.integers(0, 3, smooth.shape)).astype(np.uint8).reshape(-1, 4)
    yield 45, rng.integers(0, 256, (37 * 45, 4), dtype=np.uint8)
    for n in (1, 2, 4, 13, 200):
        yield 45, rng.integers(0, 256, (n, 4), dtype=np.uint8)[rng.integers(0, n, 37 * 45)]
    yield 1, rng.integers(0, 256, (5, 4), dtype=np.uint8)


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor_mode(mode):
    rng = np.random.default_rng(mode)
    residual = rng.integers(0, 256, (9 * 11, 4), dtype=np.uint8)
    modes = np.full(4, 0xFF000000 | mode << 8, np.uint32)
    (got,) = webp._inverse_predictor([(residual, 11, 3, modes)])
    assert got.tolist() == loop_predictor(residual.tolist(), 11, 3, modes.tolist() * 4)
    forward = (got.astype(np.int16) - webp_forward.predicted(got, 11, mode)).astype(np.uint8)
    assert (forward == residual).all()


def test_transforms_invert_and_agree_with_loops():
    for width, p in pictures():
        residual, modes = webp_forward.forward_predictor(p, width)
        assert loop_predictor(residual.tolist(), width, webp_forward.PREDICTOR_BITS, modes) == p.tolist()
        rest, elements = webp_forward.forward_cross_colour(p, width, 3)
        assert loop_cross(rest.tolist(), width, 3, elements) == p.tolist()
        assert (webp._inverse_cross_colour(rest, width, 3, elements) == p).all()


@pytest.mark.parametrize("transforms", [(), ("green",), ("predictor",), ("cross",), ("predictor", "cross"), ("green", "predictor", "cross"), ("palette",)])
def test_streams_through_transforms(transforms):
    for width, p in pictures():
        if transforms == ("palette",) and webp_forward.forward_palette(p, width) is None:
            continue
        stream = webp_forward.write_stream(p, width, transforms)
        (image,) = webp.decode([stream])
        assert (image.reshape(-1, 4) == p[:, [2, 1, 0, 3]]).all()


def test_payloads_take_transforms_where_smaller():
    rng = np.random.default_rng(12)
    smooth = np.cumsum(rng.integers(-1, 2, 64 * 64 * 3), dtype=np.int64).astype(np.uint8).reshape(64, 64, 3)
    grown = (np.arange(64 * 64)[:, None] // 7 + np.array([0, 1, 2])).astype(np.uint8)
    few = rng.integers(0, 256, (6, 3), dtype=np.uint8)[rng.integers(0, 6, 4096)]
    seen = set()
    for pixels in (smooth, grown, few):
        media = webp.encode_payload(pixels.tobytes())
        assert webp.decode_payloads([media])[0].tobytes() == pixels.tobytes()
        (stream,) = webp.streams_of(media)
        seen |= {t[0] for t in webp.parse(stream).transforms}
    assert {0, 3} <= seen
    related = rng.integers(0, 256, 4096).astype(np.int64)
    cross = np.stack([related + rng.integers(0, 3, 4096), related, related + rng.integers(0, 3, 4096)], axis=1).astype(np.uint8)
    media = webp.encode_payload(cross.tobytes())
    assert 1 in {t[0] for t in webp.parse(webp.streams_of(media)[0]).transforms}
    assert webp.decode_payloads([media])[0].tobytes() == cross.tobytes()
