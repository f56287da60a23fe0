"""Pixel features in numpy, for Arrow functions over images. Images are uint8 arrays (rows, columns, RGB), masks boolean."""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np

SIZE = 512


def gray(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb.astype(float) @ (0.299, 0.587, 0.114)).clip(0, 255).astype(np.uint8)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """By area when shrinking and linearly when growing, axis by axis."""

    def weights(n: int, m: int) -> np.ndarray:
        scale, w = n / m, np.zeros((m, n))
        for i in range(m):
            if scale >= 1:
                low, high = i * scale, (i + 1) * scale
                for k in range(int(low), min(n, int(np.ceil(high)))):
                    w[i, k] = min(high, k + 1) - max(low, k)
            else:
                at = min(max((i + 0.5) * scale - 0.5, 0), n - 1)
                k = int(at)
                w[i, k] += 1 - (at - k)
                w[i, min(k + 1, n - 1)] += at - k
        return w / w.sum(1, keepdims=True)

    out = np.tensordot(weights(image.shape[0], height), image.astype(float), (1, 0))
    return np.moveaxis(np.tensordot(weights(image.shape[1], width), out, (1, 1)), 0, 1)


def orientation(data: bytes) -> int:
    """The EXIF orientation (1 to 8) that a JPEG file states; 1 where none is found."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            tiff = data[at + 10 : at + 2 + size]
            number = lambda a, n: int.from_bytes(tiff[a : a + n], "little" if tiff[:2] == b"II" else "big")  # noqa: B023, E731
            first = number(4, 4)
            for entry in range(first + 2, first + 2 + 12 * number(first, 2), 12):
                if number(entry, 2) == 0x0112:
                    return number(entry + 8, 2) if 1 <= number(entry + 8, 2) <= 8 else 1
        at += 2 + size
    return 1


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    """The image turned as its EXIF orientation asks."""
    if orientation in (5, 6, 7, 8):
        image = image.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        image = image[:, ::-1]
    if orientation in (3, 4, 7, 8):
        image = image[::-1]
    return image


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB PNG file."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)
    lines = np.concatenate([np.zeros((rgb.shape[0], 1), np.uint8), rgb.reshape(rgb.shape[0], -1)], 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def normalise(rgb: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Short side to `size`, then the square in the middle."""
    h, w = rgb.shape[:2]
    f = size / min(h, w)
    out = resize(rgb, max(size, round(h * f)), max(size, round(w * f)))
    y, x = (out.shape[0] - size) // 2, (out.shape[1] - size) // 2
    return np.rint(out[y : y + size, x : x + size]).clip(0, 255).astype(np.uint8)


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue 0-179, saturation and value 0-255."""
    x = rgb.astype(float)
    top, low = x.max(-1), x.min(-1)
    d = top - low
    safe = np.where(d == 0, 1, d)
    r, g, b = np.moveaxis(x, -1, 0)
    hue = np.where(top == r, (g - b) / safe % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) * 30
    return np.stack([np.rint(np.where(d == 0, 0, hue)) % 180, np.rint(np.where(top == 0, 0, d / np.where(top == 0, 1, top) * 255)), top], -1)


@functools.cache
def cosines(n: int) -> np.ndarray:
    """The orthonormal DCT matrix."""
    k = np.arange(n)
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def dct2(x: np.ndarray) -> np.ndarray:
    m = cosines(len(x))
    return m @ x @ m.T


def perceptual_hash(rgb: np.ndarray) -> int:
    """63 bits: low frequencies without the constant, above their median."""
    c = dct2(resize(gray(rgb), 32, 32))[:8, :8].ravel()[1:]
    out = 0
    for bit in c > np.median(c):
        out = out << 1 | int(bit)
    return out


# Masks.


def sky(rgb: np.ndarray) -> np.ndarray:
    h, s, v = np.moveaxis(hsv(rgb), -1, 0)
    return ((s < 40) & (v > 170)) | ((h > 90) & (h < 130) & (s > 40) & (v > 120))


def default_box(shape: tuple[int, int], margin: float = 0.1) -> np.ndarray:
    h, w = shape
    out = np.zeros(shape, bool)
    out[int(h * margin) : h - int(h * margin), int(w * margin) : w - int(w * margin)] = True
    return out


def dilate(mask: np.ndarray, radius: int = 2) -> np.ndarray:
    """With a disc."""
    out = np.zeros_like(mask)
    h, w = mask.shape
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dx * dx + dy * dy <= radius * radius + 1:
                out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] |= mask[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def erode(mask: np.ndarray, radius: int = 2) -> np.ndarray:
    return ~dilate(~mask, radius)


def regions(mask: np.ndarray) -> np.ndarray:
    """Number of each pixel's 8-connected region, 0 outside: runs of rows joined by union."""
    up: list[int] = []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    runs, before = [], []
    for y, line in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(np.int8), [0]])))
        here = []
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            k = len(up)
            up.append(k)
            for c, d, j in before:
                if c <= b and a <= d:
                    up[top(k)] = top(j)
            here.append((int(a), int(b), k))
        runs += [(y, *r) for r in here]
        before = here
    out, number = np.zeros(mask.shape, int), {}
    for y, a, b, k in runs:
        out[y, a:b] = number.setdefault(top(k), len(number) + 1)
    return out


def fill_holes(mask: np.ndarray) -> np.ndarray:
    outside = regions(np.pad(~mask, 1, constant_values=True))
    return ~(outside == outside[0, 0])[1:-1, 1:-1]


def clean(mask: np.ndarray, sky_mask: np.ndarray | None = None) -> np.ndarray:
    """Closed twice, opened once, without sky; the region of most area near the centre, holes filled."""
    m = mask if sky_mask is None else mask & ~sky_mask
    m = dilate(erode(erode(erode(dilate(dilate(m))))))
    r = regions(m)
    if not r.max():
        return m
    y, x = np.nonzero(r)
    h, w = m.shape
    n = np.bincount(r[y, x])
    cy, cx = (np.bincount(r[y, x], v) / np.maximum(n, 1) for v in (y, x))
    away = np.hypot(cy / h - 0.5, cx / w - 0.5)
    return fill_holes(r == int((n * (1 - 0.8 * away))[1:].argmax()) + 1)


def bounding_box(mask: np.ndarray) -> tuple[int, int, int, int]:
    """y0, y1, x0, x1; the frame for an empty mask."""
    if not mask.any():
        return 0, mask.shape[0], 0, mask.shape[1]
    y, x = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    return int(y[0]), int(y[-1]) + 1, int(x[0]), int(x[-1]) + 1


def cropped(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    y0, y1, x0, x1 = bounding_box(mask)
    return image[y0:y1, x0:x1]


def blurred(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    r = int(3 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = np.pad(x, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        x = sum(w * np.take(pad, np.arange(i, i + x.shape[axis]), axis) for i, w in enumerate(k))
    return x


def without_background(rgb: np.ndarray, outline: np.ndarray, fine: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The image on white, and the mask of its pixels: the fine mask within the widened outline, without sky, softened at the edge."""
    mask = dilate(outline, 9) & (outline if fine is None else fine) & ~sky(rgb)
    alpha = blurred(mask.astype(float))[..., None]
    return np.rint(rgb * alpha + 255 * (1 - alpha)).clip(0, 255).astype(np.uint8), mask


def overlay(rgb: np.ndarray, mask: np.ndarray, tint: tuple[int, int, int] = (255, 0, 0), share: float = 0.4) -> np.ndarray:
    return np.where(mask[..., None], (1 - share) * rgb + share * np.array(tint), rgb).astype(np.uint8)


# Colour.


def _bins(pixels: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    scaled = (pixels * np.array(shape) / np.array([180, 256, 256])).astype(int)
    return np.ravel_multi_index(np.minimum(scaled, np.array(shape) - 1).T, shape)


def hsv_histogram(pixels: np.ndarray, shape: tuple[int, int, int] = (8, 3, 3)) -> np.ndarray:
    """Shares of bins; zeros without pixels."""
    out = np.bincount(_bins(pixels, shape), minlength=int(np.prod(shape))).astype(float) if len(pixels) else np.zeros(int(np.prod(shape)))
    return out / max(out.sum(), 1)


def grid_histogram(image: np.ndarray, mask: np.ndarray, cells: int = 3) -> np.ndarray:
    x, m = cropped(image, mask), cropped(mask, mask)
    out = []
    for rows in np.array_split(np.arange(len(x)), cells):
        for columns in np.array_split(np.arange(x.shape[1]), cells):
            out.append(hsv_histogram(x[np.ix_(rows, columns)][m[np.ix_(rows, columns)]], (4, 2, 2)))
    return np.concatenate(out)


def colour_moments(pixels: np.ndarray) -> np.ndarray:
    if not len(pixels):
        return np.zeros(9)
    x = pixels / np.array([180.0, 255.0, 255.0])
    mean, std = x.mean(0), x.std(0)
    return np.concatenate([mean, std, np.tanh(((x - mean) ** 3).mean(0) / (std**3 + 1e-6))])


def cumulative_histogram(h: np.ndarray) -> np.ndarray:
    return np.cumsum(h) / len(h)


def lab(rgb: np.ndarray) -> np.ndarray:
    """CIE L*a*b* under D65."""
    x = rgb.astype(float) / 255
    x = np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)
    xyz = x @ np.array([[0.412453, 0.212671, 0.019334], [0.357580, 0.715160, 0.119193], [0.180423, 0.072169, 0.950227]]) / (0.950456, 1.0, 1.088754)
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def rgb_of(h: np.ndarray) -> np.ndarray:
    hue, s, v = h[..., 0] / 30, h[..., 1] / 255, h[..., 2]
    k = (np.array([5, 3, 1]) + hue[..., None]) % 6
    return v[..., None] * (1 - s[..., None] * np.clip(np.minimum(k, 4 - k), 0, 1))


@functools.cache
def _centres(shape: tuple[int, int, int] = (8, 3, 3)) -> np.ndarray:
    grid = np.stack(np.meshgrid(*[(np.arange(n) + 0.5) / n * top for n, top in zip(shape, (180, 256, 256), strict=True)], indexing="ij"), -1).reshape(-1, 3)
    return lab(rgb_of(grid))


def weighted_histogram(rgb_pixels: np.ndarray, most: int = 6000, near: int = 4) -> np.ndarray:
    """Each pixel spread over its nearest bin centres by closeness in L*a*b*; of many pixels evenly spaced ones."""
    centres = _centres()
    if not len(rgb_pixels):
        return np.zeros(len(centres))
    p = lab(rgb_pixels[np.linspace(0, len(rgb_pixels) - 1, min(most, len(rgb_pixels))).astype(int)])
    d = np.sqrt(((p[:, None] - centres[None]) ** 2).sum(-1))
    k = np.argpartition(d, near, 1)[:, :near]
    w = 1 / (np.take_along_axis(d, k, 1) + 1)
    out = np.bincount(k.ravel(), (w / w.sum(1, keepdims=True)).ravel(), minlength=len(centres))
    return out / out.sum()


COLOR = [("hsv_fg", 72), ("hsv_grid", 144), ("hsv_cum", 72), ("pwh", 72), ("moments", 9)]


def color(rgb: np.ndarray, mask: np.ndarray) -> np.ndarray:
    h = hsv(rgb)
    own = hsv_histogram(h[mask])
    return np.concatenate([own, grid_histogram(h, mask), cumulative_histogram(own), weighted_histogram(rgb[mask]), colour_moments(h[mask])])


# Shape.


def central(mask: np.ndarray) -> dict[tuple[int, int], float]:
    y, x = np.nonzero(mask)
    if not len(y):
        return {(p, q): 0.0 for p in range(4) for q in range(4)}
    y, x = y - y.mean(), x - x.mean()
    return {(p, q): float((x**p * y**q).sum()) for p in range(4) for q in range(4) if p + q < 4}


def hu_moments(mask: np.ndarray) -> np.ndarray:
    m = central(mask)
    n = lambda p, q: m[p, q] / m[0, 0] ** (1 + (p + q) / 2) if m[0, 0] else 0.0
    a, b, c, d = n(3, 0) + n(1, 2), n(2, 1) + n(0, 3), n(3, 0) - 3 * n(1, 2), 3 * n(2, 1) - n(0, 3)
    s, t, u = n(2, 0) + n(0, 2), n(2, 0) - n(0, 2), n(1, 1)
    h = np.array([s, t * t + 4 * u * u, c * c + d * d, a * a + b * b, c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b), t * (a * a - b * b) + 4 * u * a * b, d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b)])
    return -np.sign(h) * np.log10(np.abs(h) + 1e-12)


def hull_area(mask: np.ndarray) -> float:
    """Area of the convex hull of the pixels' corners."""
    points = set()
    for y in np.flatnonzero(mask.any(1)):
        x = np.flatnonzero(mask[y])
        points |= {(int(x[0]), int(y)), (int(x[-1]) + 1, int(y)), (int(x[0]), int(y) + 1), (int(x[-1]) + 1, int(y) + 1)}
    ordered = sorted(points)

    def half(ps):
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(ordered) + half(ordered[::-1])
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def region_measures(mask: np.ndarray) -> np.ndarray:
    """Of the largest region: share of area, height over width, extent, solidity, eccentricity, both axes and the orientation, offsets of the centre."""
    r = regions(mask)
    if not r.max():
        return np.zeros(10)
    m = r == np.bincount(r[r > 0]).argmax()
    h, w = mask.shape
    y0, y1, x0, x1 = bounding_box(m)
    n = int(m.sum())
    c = central(m)
    a, b, d = c[2, 0] / n + 1 / 12, c[1, 1] / n, c[0, 2] / n + 1 / 12
    root = np.sqrt((a - d) ** 2 + 4 * b * b)
    major, minor = (a + d + root) / 2, max((a + d - root) / 2, 0)
    y, x = np.nonzero(m)
    return np.array([n / (h * w), (y1 - y0) / (x1 - x0), n / ((y1 - y0) * (x1 - x0)), n / max(hull_area(m), 1), np.sqrt(max(0, 1 - minor / major)), 4 * np.sqrt(major) / h, 4 * np.sqrt(minor) / h, 0.5 * np.arctan2(2 * b, a - d) / np.pi, (x.mean() + 0.5) / w - 0.5, (y.mean() + 0.5) / h - 0.5])


def grid_occupancy(mask: np.ndarray, cells: int = 8, least: float = 0.15) -> np.ndarray:
    return (resize(cropped(mask, mask).astype(float), cells, cells) > least).astype(float).ravel()


def contour(mask: np.ndarray) -> np.ndarray:
    """The outer boundary of the largest region, walked round (Moore neighbours)."""
    r = regions(mask)
    if not r.max():
        return np.zeros((0, 2))
    m = np.pad(r == np.bincount(r[r > 0]).argmax(), 1)
    around = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    at = start = tuple(int(v) for v in np.argwhere(m)[0])
    out, side = [start], 0
    for _ in range(4 * m.size):
        for k in range(8):
            d = (side + k) % 8
            nxt = (at[0] + around[d][0], at[1] + around[d][1])
            if m[nxt]:
                at, side = nxt, (d + 5) % 8
                break
        else:
            break
        if at == start:
            break
        out.append(at)
    return np.array(out, float)


def fourier_descriptor(mask: np.ndarray, samples: int = 128, kept: int = 16) -> np.ndarray:
    c = contour(mask)
    if len(c) < 8:
        return np.zeros(kept)
    z = c[np.linspace(0, len(c), samples, endpoint=False).astype(int)] @ np.array([1j, 1])
    f = np.abs(np.fft.fft(z))
    return f[2 : 2 + kept] / f[1] if f[1] > 1e-9 else np.zeros(kept)


def width_profile(mask: np.ndarray, bands: int = 16) -> np.ndarray:
    m = cropped(mask, mask)
    return np.array([b.sum(1).mean() / m.shape[1] if len(b) else 0.0 for b in np.array_split(m, bands)]) if mask.any() else np.zeros(bands)


SHAPE = [("region", 10), ("hu", 7), ("grid", 64), ("fourier", 16), ("profile", 16)]


def shape(rgb: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.concatenate([region_measures(mask), hu_moments(mask), grid_occupancy(mask), fourier_descriptor(mask), width_profile(mask)])


# Texture.


def cooccurrence(g: np.ndarray, mask: np.ndarray, levels: int = 32, distances: tuple[int, ...] = (1, 3)) -> np.ndarray:
    """Contrast, dissimilarity, homogeneity, energy, correlation of gray levels at each distance, over four directions."""
    if mask.sum() < 4:
        return np.zeros(5 * len(distances))
    q = (g.astype(int) * levels) // 256
    out = []
    i, j = np.indices((levels, levels))
    for d in distances:
        props = []
        for dy, dx in ((0, d), (-d, d), (-d, 0), (-d, -d)):
            h, w = q.shape
            a = (slice(max(0, -dy), h + min(0, -dy)), slice(max(0, -dx), w + min(0, -dx)))
            b = (slice(max(0, dy), h + min(0, dy)), slice(max(0, dx), w + min(0, dx)))
            both = mask[a] & mask[b]
            p = np.bincount((q[a] * levels + q[b])[both], minlength=levels * levels).reshape(levels, levels).astype(float)
            p += p.T
            p /= max(p.sum(), 1)
            mi, mj = (p * i).sum(), (p * j).sum()
            si, sj = np.sqrt((p * (i - mi) ** 2).sum()), np.sqrt((p * (j - mj) ** 2).sum())
            corr = (p * (i - mi) * (j - mj)).sum() / (si * sj) if si * sj > 1e-12 else 1.0
            props.append([(p * (i - j) ** 2).sum() / (levels - 1) ** 2, (p * np.abs(i - j)).sum() / (levels - 1), (p / (1 + (i - j) ** 2)).sum(), np.sqrt((p * p).sum()), corr])
        out.append(np.mean(props, 0))
    return np.concatenate(out)


def binary_patterns(g: np.ndarray, mask: np.ndarray, points: int, radius: int) -> np.ndarray:
    """Uniform rotation-invariant local binary patterns: shares of points + 2 codes."""
    x = np.pad(g.astype(float), radius + 1, mode="edge")
    h, w = g.shape
    bits = []
    for k in range(points):
        dy, dx = -radius * np.sin(2 * np.pi * k / points), radius * np.cos(2 * np.pi * k / points)
        y0, x0 = int(np.floor(dy)), int(np.floor(dx))
        fy, fx = dy - y0, dx - x0
        at = lambda a, b: x[radius + 1 + a : radius + 1 + a + h, radius + 1 + b : radius + 1 + b + w]
        v = (1 - fy) * (1 - fx) * at(y0, x0) + (1 - fy) * fx * at(y0, x0 + 1) + fy * (1 - fx) * at(y0 + 1, x0) + fy * fx * at(y0 + 1, x0 + 1)
        bits.append(np.round(v - g, 9) >= 0)
    bits = np.array(bits)
    changes = (bits != np.roll(bits, 1, 0)).sum(0)
    code = np.where(changes <= 2, bits.sum(0), points + 1)
    out = np.bincount(code[mask], minlength=points + 2).astype(float)
    return out / max(out.sum(), 1)


def gradients(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel derivatives."""
    x = np.pad(g.astype(float), 1, mode="reflect")
    dx = x[:-2, 2:] + 2 * x[1:-1, 2:] + x[2:, 2:] - x[:-2, :-2] - 2 * x[1:-1, :-2] - x[2:, :-2]
    dy = x[2:, :-2] + 2 * x[2:, 1:-1] + x[2:, 2:] - x[:-2, :-2] - 2 * x[:-2, 1:-1] - x[:-2, 2:]
    return dx, dy


def edge_histogram(g: np.ndarray, mask: np.ndarray, bins: int = 8, strong: float = 60.0) -> np.ndarray:
    dx, dy = gradients(g)
    size, angle = np.hypot(dx, dy)[mask], (np.arctan2(dy, dx) % np.pi)[mask]
    out = np.bincount(np.minimum((angle / np.pi * bins).astype(int), bins - 1), size, minlength=bins)
    return np.append(out / max(out.sum(), 1e-8), (size > strong).mean() if len(size) else 0.0)


def tamura(g: np.ndarray, mask: np.ndarray, scales: int = 5) -> np.ndarray:
    """Coarseness, contrast and directionality."""
    if mask.sum() < 4:
        return np.zeros(3)
    x = g.astype(float)
    sums = np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    h, w = x.shape
    best, size = np.zeros(x.shape), np.ones(x.shape)
    yy, xx = np.indices(x.shape)

    def mean(cy, cx, k):
        y0, y1, x0, x1 = (np.clip(v, 0, n) for v, n in ((cy - k // 2, h), (cy + k // 2, h), (cx - k // 2, w), (cx + k // 2, w)))
        return (sums[y1, x1] - sums[y0, x1] - sums[y1, x0] + sums[y0, x0]) / np.maximum((y1 - y0) * (x1 - x0), 1)

    for s in range(1, scales + 1):
        k = 2**s
        e = np.maximum(np.abs(mean(yy, xx + k // 2, k) - mean(yy, xx - k // 2, k)), np.abs(mean(yy + k // 2, xx, k) - mean(yy - k // 2, xx, k)))
        better = e > best
        best[better], size[better] = e[better], k
    v = x[mask]
    var = v.var()
    contrast = var**0.5 / (((v - v.mean()) ** 4).mean() / max(var * var, 1e-8)) ** 0.25 if var > 1e-8 else 0.0
    dx, dy = gradients(g)
    strong = mask & (np.hypot(dx, dy) > 12)
    p = np.bincount(np.minimum(((np.arctan2(dy, dx) % np.pi)[strong] / np.pi * 16).astype(int), 15), minlength=16).astype(float)
    p /= max(p.sum(), 1)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    return np.array([np.log2(size[mask]).mean() / scales, contrast / 128, 1 - entropy / 4 if p.sum() else 0.0])


def dct_features(g: np.ndarray) -> np.ndarray:
    return dct2(resize(g, 64, 64))[:6, :6].ravel()[1:] / (255 * 64 / 4)


TEXTURE = [("glcm", 10), ("lbp", 28), ("edge", 9), ("tamura", 3), ("dct", 35)]


def texture(rgb: np.ndarray, mask: np.ndarray) -> np.ndarray:
    g, m = cropped(gray(rgb), mask), cropped(mask, mask)
    if not m.any():
        m = np.ones(g.shape, bool)
    return np.concatenate([cooccurrence(g, m), binary_patterns(g, m, 8, 1), binary_patterns(g, m, 16, 2), edge_histogram(g, m), tamura(g, m), dct_features(g)])


EXTRACTORS = {"color": color, "shape": shape, "texture": texture}
LAYOUTS = {"color": COLOR, "shape": SHAPE, "texture": TEXTURE}
