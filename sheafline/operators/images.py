"""Pixel operators as numpy functions for pandas UDFs.

Images are BGR arrays of unsigned bytes, height x width x 3. Decoders and encoders are
providers; binary PPM is the stand-in for both.
"""

from __future__ import annotations

import struct
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafline.shipping import ship

ship(__name__)

LEAST_SIDE = 8
#: The slope of the cubic through pixels (fixed value: what common resamplers use), and rows that are worked on at a time.
SHARP, ROWS = -0.75, 256
#: Linear light of each byte, its CIE coordinates by the white point of daylight, and where lightness turns linear (fixed values of the sRGB and CIE standards).
LINEAR = np.array([c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in np.arange(256) / 255])
TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]) / np.array([[0.950456], [1.0], [1.088754]])
DARK = 0.008856


def decode_ppm(data: bytes) -> np.ndarray | None:
    """Binary PPM or PGM with eight bits, or None."""
    fields, at = [], 0
    while len(fields) < 4 and at < len(data):
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
        elif data[at : at + 1].isspace():
            at += 1
        else:
            end = at
            while end < len(data) and not data[end : end + 1].isspace():
                end += 1
            fields.append(data[at:end])
            at = end
    if len(fields) < 4 or fields[0] not in (b"P5", b"P6") or not all(f.isdigit() for f in fields[1:]) or int(fields[3]) != 255:
        return None
    w, h, deep = int(fields[1]), int(fields[2]), 3 if fields[0] == b"P6" else 1
    pixels = np.frombuffer(data[at + 1 : at + 1 + w * h * deep], np.uint8)
    return pixels.reshape(h, w, deep)[:, :, ::-1].copy() if len(pixels) == w * h * deep and w and h else None


def encode_ppm(image: np.ndarray) -> bytes:
    """An image as binary PPM."""
    return b"P6 %d %d 255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image[:, :, ::-1]).tobytes()


def exif_orientation(data: bytes | None) -> int | None:
    """The orientation tag of a JPEG's header, for audit."""
    if not data or data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            tiff = data[at + 10 : at + 2 + size]
            order = "<" if tiff[:2] == b"II" else ">"
            try:
                start = struct.unpack(order + "I", tiff[4:8])[0]
                for k in range(struct.unpack(order + "H", tiff[start : start + 2])[0]):
                    tag, _, _, value = struct.unpack(order + "HHIH", tiff[start + 2 + 12 * k : start + 12 + 12 * k])
                    if tag == 274:
                        return value or None
            except struct.error:
                return None
        at += 2 + size
    return None


def normalize(image: np.ndarray) -> np.ndarray:
    """Three channels of bytes; gray is repeated, a fourth channel dropped."""
    if image.ndim == 2:
        image = image[:, :, None]
    if image.ndim != 3 or image.shape[2] not in (1, 3, 4):
        raise ValueError(f"no image: {image.shape}")
    image = image[:, :, :3] if image.shape[2] >= 3 else np.repeat(image, 3, axis=2)
    return image if image.dtype == np.uint8 else np.clip(image, 0, 255).astype(np.uint8)


def ingest(image: np.ndarray | None) -> tuple[np.ndarray, dict]:
    """A checked image and its sides."""
    if image is None or image.size == 0:
        raise ValueError("ingest: no image")
    image = normalize(image)
    h, w = image.shape[:2]
    if min(h, w) < LEAST_SIDE:
        raise ValueError(f"ingest: {w}x{h} is too small")
    return image, {"input_long_side": max(h, w), "input_short_side": min(h, w)}


def gray(image: np.ndarray) -> np.ndarray:
    """Luma by the usual weights, rounded."""
    b, g, r = (image[:, :, k].astype(np.float64) for k in range(3))
    return np.rint(0.114 * b + 0.587 * g + 0.299 * r).astype(np.uint8)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """By area means where sides shrink, linear where they grow."""
    def weights(n: int, m: int) -> np.ndarray:
        out = np.zeros((m, n))
        if m <= n:
            edge = np.linspace(0, n, m + 1)
            for k in range(m):
                a, b = edge[k], edge[k + 1]
                cells = np.arange(int(a), min(n, int(np.ceil(b))))
                out[k, cells] = np.minimum(cells + 1, b) - np.maximum(cells, a)
        else:
            at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
            low = np.minimum(at.astype(int), n - 1)
            out[np.arange(m), low] += 1 - (at - low)
            out[np.arange(m), np.minimum(low + 1, n - 1)] += at - low
        return out / out.sum(axis=1, keepdims=True)

    h, w = image.shape[:2]
    made = np.tensordot(weights(h, height), image.astype(np.float64), axes=(1, 0))
    made = np.moveaxis(np.tensordot(weights(w, width), made, axes=(1, 1)), 0, 1)
    return np.clip(np.rint(made), 0, 255).astype(np.uint8)


def cubic_taps(part: np.ndarray) -> np.ndarray:
    """The weights of the pixels at -1, 0, 1 and 2 for a place that lies part beyond pixel 0."""
    def near(d: np.ndarray) -> np.ndarray:
        return ((SHARP + 2) * d - (SHARP + 3)) * d * d + 1

    def far(d: np.ndarray) -> np.ndarray:
        return ((d - 5) * d + 8) * d * SHARP - 4 * SHARP

    return np.stack([far(1 + part), near(part), near(1 - part), far(2 - part)], axis=-1)


def resize_cubic(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """By a cubic through four pixels a side; border pixels are repeated. Constant images stay as they are."""
    def along(x: np.ndarray, m: int) -> np.ndarray:
        at = (np.arange(m) + 0.5) * len(x) / m - 0.5
        low = np.floor(at).astype(int)
        taps = cubic_taps(at - low)
        return sum(taps[:, k, None, None] * x[np.clip(low + k - 1, 0, len(x) - 1)] for k in range(4))

    if image.shape[:2] == (height, width):
        return image
    made = along(image.astype(np.float64), height).swapaxes(0, 1)
    return np.clip(np.rint(along(made, width).swapaxes(0, 1)), 0, 255).astype(np.uint8)


def half_even(over: int, under: int, places: int) -> float:
    """over/under rounded to places on whole numbers, a tie to the even digit: no float comes near a tie."""
    return round(Fraction(int(over) * 10**places, int(under))) / 10**places


def stats(g: np.ndarray) -> dict[str, float]:
    """Sharpness and background of a gray image: the Laplacian's variance, flat and clipped shares, the largest histogram bin."""
    n, whole = g.size, g.astype(np.int64)
    x = np.pad(whole, 1, mode="reflect" if min(g.shape) > 1 else "edge")
    lap = x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]
    share = lambda where, places: half_even(np.count_nonzero(where), n, places)
    return {
        "blur_lapvar": half_even(n * int((lap * lap).sum()) - int(lap.sum()) ** 2, n * n, 1), "brightness_mean": half_even(whole.sum(), n, 1),
        "highlight_clip_frac": share(g >= 250, 4), "shadow_clip_frac": share(g <= 5, 4), "flat_frac": share(np.abs(lap) <= 1, 3),
        "bg_peak": half_even(np.bincount(g.ravel(), minlength=256).max(), n, 3),
    }


def probe(image: np.ndarray, width: int = 1000) -> dict[str, float]:
    """stats() of an image brought to one width, so that sharpness compares."""
    h, w = image.shape[:2]
    g = gray(image)
    return stats(g if w == width else resize(g[:, :, None], width, max(1, int(h * width / w)))[:, :, 0])


def rotate_quarters(image: np.ndarray, quarters: int) -> np.ndarray:
    """Quarter turns counter-clockwise, pixel by pixel."""
    return np.ascontiguousarray(np.rot90(image, quarters))


def rotate_free(image: np.ndarray, degrees: float) -> np.ndarray:
    """A turn about the centre onto a canvas that holds the image, by cubics; border pixels are repeated."""
    h, w = image.shape[:2]
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    nw, nh = int(h * abs(s) + w * abs(c)), int(h * abs(c) + w * abs(s))
    out = np.empty((nh, nw, image.shape[2]), np.uint8)
    for top in range(0, nh, ROWS):
        y, x = np.mgrid[top : min(nh, top + ROWS), 0:nw]
        dx, dy = x - nw / 2, y - nh / 2
        sx, sy = c * dx - s * dy + w / 2, s * dx + c * dy + h / 2
        x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
        wx, wy = cubic_taps(sx - x0), cubic_taps(sy - y0)
        columns = [np.clip(x0 + k - 1, 0, w - 1) for k in range(4)]
        made = np.zeros((*x.shape, image.shape[2]))
        for j in range(4):
            row = np.clip(y0 + j - 1, 0, h - 1)
            made += wy[..., j, None] * sum(wx[..., k, None] * image[row, columns[k]] for k in range(4))
        out[top : top + ROWS] = np.clip(np.rint(made), 0, 255)
    return out


def crop(image: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    """The box's part of an image; the whole where the box is empty."""
    return image[y1:y2, x1:x2] if x2 > x1 and y2 > y1 else image


def compose_columns(image: np.ndarray, cuts: list[int], separator: int = 10, background: int = 255) -> np.ndarray:
    """The stretches between cuts side by side, black lines between, short ones padded below."""
    bounds = [0, *cuts, image.shape[0]]
    parts = [image[a:b] for a, b in zip(bounds, bounds[1:])]
    most = max(len(p) for p in parts)
    line = np.zeros((most, separator, 3), np.uint8)
    out = []
    for k, p in enumerate(parts):
        out += [line] * (k > 0) + [np.vstack([p, np.full((most - len(p), p.shape[1], 3), background, np.uint8)])]
    return np.hstack(out)


def pad(image: np.ndarray, pixels: int, background: int = 255) -> np.ndarray:
    """The shorter side made longer by pixels, half on each end."""
    a, b = pixels // 2, pixels - pixels // 2
    sides = ((0, 0), (a, b), (0, 0)) if image.shape[0] >= image.shape[1] else ((a, b), (0, 0), (0, 0))
    return np.pad(image, sides, constant_values=background)


def to_lab(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lightness and two colour axes in bytes: lightness by 255/100, axes from 128."""
    out = np.empty(image.shape, np.uint8)
    for top in range(0, len(image), ROWS):
        xyz = LINEAR[image[top : top + ROWS, :, ::-1]] @ TO_XYZ.T
        f = np.where(xyz > DARK, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
        light = np.where(xyz[..., 1] > DARK, 116 * f[..., 1] - 16, 903.3 * xyz[..., 1])
        made = np.stack([light * 2.55, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)
        out[top : top + ROWS] = np.clip(np.rint(made), 0, 255)
    return out[..., 0], out[..., 1], out[..., 2]


def from_lab(light: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Back from to_lab()."""
    out = np.empty((*light.shape, 3), np.uint8)
    for top in range(0, len(light), ROWS):
        part = slice(top, top + ROWS)
        v = light[part] / 2.55
        y = np.where(v <= 903.3 * DARK, v / 903.3, ((v + 16) / 116) ** 3)
        fy = np.where(v <= 903.3 * DARK, 7.787 * y + 16 / 116, (v + 16) / 116)
        f = np.stack([fy + (a[part] - 128.0) / 500, fy - (b[part] - 128.0) / 200], axis=-1)
        x, z = np.moveaxis(np.where(f > 7.787 * DARK + 16 / 116, f**3, (f - 16 / 116) / 7.787), -1, 0)
        rgb = np.clip(np.stack([x, y, z], axis=-1) @ np.linalg.inv(TO_XYZ).T, 0, 1)
        shown = np.where(rgb <= 0.0031308, rgb * 12.92, 1.055 * rgb ** (1 / 2.4) - 0.055)
        out[part] = np.clip(np.rint(shown[..., ::-1] * 255), 0, 255)
    return out


def local_contrast(g: np.ndarray, clip: float, grid: int) -> np.ndarray:
    """Histogram equalisation by tiles, limited in contrast (CLAHE): grid x grid tiles.

    A tile's histogram is cut at clip times its mean bin, what was cut is dealt to all bins alike, the
    remainder to bins at even steps. Its sums are the tile's table; a pixel mixes those of the four
    tiles whose centres are around it. clip 0: no limit.
    """
    h, w = g.shape
    th, tw = -(-h // grid), -(-w // grid)
    tiles = np.pad(g, [(0, th * grid - h), (0, tw * grid - w)], mode="reflect" if min(h, w) > 1 else "edge")
    tiles = tiles.reshape(grid, th, grid, tw).swapaxes(1, 2).reshape(grid * grid, th * tw)
    counts = np.bincount((np.arange(grid * grid)[:, None] * 256 + tiles).ravel(), minlength=grid * grid * 256).reshape(-1, 256)
    if clip > 0:
        limit = max(1, int(clip * th * tw / 256))
        over = np.maximum(counts - limit, 0).sum(axis=1)
        rest = (over % 256)[:, None]
        step, bins = np.maximum(256 // np.maximum(rest, 1), 1), np.arange(256)[None]
        counts = np.minimum(counts, limit) + (over // 256)[:, None] + ((bins % step == 0) & (bins // step < rest))
    tables = np.clip(np.rint(np.cumsum(counts, axis=1) * (255 / (th * tw))), 0, 255).reshape(grid, grid, 256)

    def around(n: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(n) / side - 0.5
        low = np.floor(at).astype(int)
        return np.maximum(low, 0), np.minimum(low + 1, grid - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = around(h, th), around(w, tw)
    out = np.empty_like(g)
    for top in range(0, h, ROWS):
        part = slice(top, top + ROWS)
        v, a, b, f = g[part], y0[part, None], y1[part, None], fy[part, None]
        upper = tables[a, x0, v] * (1 - fx) + tables[a, x1, v] * fx
        lower = tables[b, x0, v] * (1 - fx) + tables[b, x1, v] * fx
        out[part] = np.clip(np.rint(upper * (1 - f) + lower * f), 0, 255)
    return out


def blurred(x: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian blur, borders mirrored."""
    reach = max(1, round(3 * sigma))
    taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    taps /= taps.sum()
    for _ in range(2):  # down, then across
        padded = np.pad(x, [(reach, reach), (0, 0)], mode="reflect" if len(x) > 1 else "edge")
        x = sum(t * padded[k : k + len(x)] for k, t in enumerate(taps)).T
    return x


def even_light(image: np.ndarray, fraction: float = 0.125, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Lightness divided by that of the background, a blurred local maximum, then local_contrast; colours stay."""
    k = max(15, int(min(image.shape[:2]) * fraction)) | 1
    light, a, b = to_lab(image)

    def slide(x: np.ndarray, of: np.ufunc) -> np.ndarray:
        """of over windows of k rows: windows double in length, and two that overlap make the last one."""
        x, size = np.pad(x, [(k // 2, k // 2), (0, 0)], mode="edge"), 1
        while 2 * size <= k:
            x, size = of(x[:-size], x[size:]), 2 * size
        return of(x[: len(x) - (k - size)], x[k - size :]) if k > size else x

    high = slide(slide(light, np.maximum).T, np.maximum).T
    closed = slide(slide(high, np.minimum).T, np.minimum).T
    ground = np.maximum(np.rint(blurred(closed.astype(np.float64), k / 6)), 1)
    even = np.clip(np.rint(light * (220.0 / ground)), 0, 255).astype(np.uint8)
    return from_lab(local_contrast(even, clip, grid), a, b)


#: What stats() gives (fixed values: names and roundings are read by others).
STATS = "struct<blur_lapvar:double,brightness_mean:double,highlight_clip_frac:double,shadow_clip_frac:double,flat_frac:double,bg_peak:double>"


def byte_stats(payloads: Column, width: int) -> Column:
    """stats() of a payload's bytes read as a gray image of that width, the last row filled up; null for no bytes."""

    @F.pandas_udf(STATS)
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            g = np.frombuffer(bytes(v or b""), np.uint8)
            rows.append(stats(np.pad(g, (0, -len(g) % width), mode="edge").reshape(-1, width)) if len(g) else {})
        return pd.DataFrame(rows, columns=[f.split(":")[0] for f in STATS[7:-1].split(",")])

    return run(payloads)
