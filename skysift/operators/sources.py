"""Single-frame source extraction: an Arrow kernel a frame, and a native form of labelling for small frames."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DetectionConfig

FOOTPRINT = "array<struct<x:int,y:int,v:int>>"
FIELDS = "obj_ord int, x double, y double, total_flux double, peak_sigma double, integrated_sigma double, pixel_area double, fwhm double, elongation double, angle double, is_streak boolean"
SOURCES = f"session_id string, seq_index int, {FIELDS}, median double, sigma double, footprint {FOOTPRINT}"

#: The eight neighbours.
AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def clip_background(image: np.ndarray, config: DetectionConfig) -> tuple[float, float]:
    """(median, sigma) of a shifted image by iterative clipping of its histogram."""
    bins = np.bincount(image.ravel(), minlength=65536)[:65536].astype(np.int64)
    level = np.arange(65536, dtype=float)
    lo, hi, median, sigma = 0, 65535, 0.0, 0.0
    for _ in range(config.bg_clipping_iterations):
        part = bins[lo : hi + 1]
        total = int(part.sum())
        if not total:
            break
        median = float(lo + int(np.searchsorted(np.cumsum(part), total // 2, "left")))
        sigma = math.sqrt(float(((level[lo : hi + 1] - median) ** 2 * part).sum()) / total)
        step = config.bg_clipping_factor * sigma
        lo, hi = int(max(0, math.floor(median - step))), int(min(65535, math.ceil(median + step)))
    return median, sigma


def _merge_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            jump = root[root]
            if np.array_equal(jump, root):
                break
            root = jump
    return root


def label_components(image: np.ndarray, seed: float, grow: float) -> list[np.ndarray]:
    """Raster places of each blob, in raster order of the blobs' first seeds.

    When no seed can lie below the growth level, blobs are the 8-connected parts of ``v > grow`` that hold a seed.
    Otherwise a blob's start need only exceed the seed level and blobs are claimed in raster order."""
    height, width = image.shape
    if grow <= seed:
        mask = image > grow
        place = np.flatnonzero(mask)
        if not len(place):
            return []
        number = np.full(image.shape, -1, np.int64)
        number.ravel()[place] = np.arange(len(place))
        ends = []
        for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
            here = number[: height - dy, max(0, -dx) : width - max(0, dx)]
            there = number[dy:, max(0, dx) : width + min(0, dx)]
            both = (here >= 0) & (there >= 0)
            ends.append((here[both], there[both]))
        root = _merge_labels(len(place), *(np.concatenate(e) for e in zip(*ends, strict=True)))
        is_seed = image.ravel()[place] > seed
        leads, at = np.unique(root[is_seed], return_index=True)
        starts = np.flatnonzero(is_seed)[at]
        order = np.argsort(root, kind="stable")
        cuts = np.searchsorted(root[order], leads)
        stops = np.searchsorted(root[order], leads, "right")
        blobs = [place[order[i:j]] for i, j in zip(cuts, stops, strict=True)]
        return [blobs[k] for k in np.argsort(starts)]
    taken = np.zeros(image.shape, bool)
    blobs = []
    for start in np.flatnonzero(image > seed):
        y, x = divmod(int(start), width)
        if taken[y, x]:
            continue
        taken[y, x] = True
        todo, blob = deque([(y, x)]), []
        while todo:
            cy, cx = todo.popleft()
            blob.append(cy * width + cx)
            for dy, dx in AROUND:
                ny, nx = cy + dy, cx + dx
                if 0 <= ny < height and 0 <= nx < width and not taken[ny, nx] and image[ny, nx] > grow:
                    taken[ny, nx] = True
                    todo.append((ny, nx))
        blobs.append(np.array(blob))
    return blobs


@dataclass
class Source:
    obj_ord: int
    x: float
    y: float
    total_flux: float
    peak_sigma: float
    integrated_sigma: float
    pixel_area: float
    fwhm: float
    elongation: float
    angle: float
    is_streak: bool
    xs: np.ndarray
    ys: np.ndarray
    vs: np.ndarray


def _ratio(a: float, b: float) -> float:
    return a / b if b else (math.nan if a == 0 else math.copysign(math.inf, a))


def measure(xs: np.ndarray, ys: np.ndarray, vs: np.ndarray, median: float, sigma: float, config: DetectionConfig, obj_ord: int = 0) -> Source:
    """Flux-weighted moments; intensities at or below the background weigh 1."""
    w = vs - median
    w = np.where(w <= 0, 1.0, w)
    flux = float(w.sum())
    x, y = float((xs * w).sum()) / flux, float((ys * w).sum()) / flux
    dx, dy = xs - x, ys - y
    xx, yy, xy = (float((d * w).sum()) / flux for d in (dx * dx, dy * dy, dx * dy))
    split = math.hypot(xx - yy, 2 * xy)
    major, minor = max((xx + yy + split) / 2, 0.001), max((xx + yy - split) / 2, 0.001)
    elongation = math.sqrt(major / minor)
    streak = elongation > config.streak_min_elongation and len(xs) >= config.streak_min_pixels
    return Source(
        obj_ord, x, y, flux, _ratio(max(float(vs.max()), 0.0) - median, sigma), flux / (max(sigma, 1e-6) * math.sqrt(max(len(xs), 1))),
        float(len(xs)), 2.355 * math.sqrt(major + minor), elongation, 0.5 * math.atan2(2 * xy, xx - yy), streak, xs, ys, vs,
    )


def near_void(image: np.ndarray, x: float, y: float, radius: int, void: float) -> bool:
    """Any of eight probes around the truncated centre is outside or at most the void level."""
    height, width = image.shape
    cx, cy = int(x), int(y)
    for dy, dx in AROUND:
        py, px = cy + dy * radius, cx + dx * radius
        if not (0 <= px < width and 0 <= py < height) or image[py, px] <= void:
            return True
    return False


def extract_sources(image: np.ndarray, seed_sigma: float, min_pixels: int, config: DetectionConfig) -> tuple[list[Source], float, float]:
    """(sources, median, sigma) of one shifted image."""
    height, width = image.shape
    median, sigma = clip_background(image, config)
    out: list[Source] = []
    blobs = label_components(image, median + sigma * seed_sigma, median + sigma * config.grow_sigma_multiplier)
    flat, edge = image.ravel(), config.edge_margin_pixels
    for blob in blobs:
        if len(blob) < min_pixels:
            continue
        s = measure((blob % width).astype(float), (blob // width).astype(float), flat[blob].astype(float), median, sigma, config, len(out))
        inside = edge <= s.x < width - edge and edge <= s.y < height - edge
        if (inside or s.is_streak) and not near_void(image, s.x, s.y, config.void_proximity_radius, median * config.void_threshold_fraction):
            out.append(s)
    return out, median, sigma


def extract(rows: DataFrame, seed_sigma: float, min_pixels: int, config: DetectionConfig) -> DataFrame:
    """Row-layout frames (session_id, seq_index, y, px[, void_radius]) -> one row per source, with its footprint. One task holds
    one frame. A column ``void_radius`` goes before the configuration's radius."""
    own = ["void_radius"] if "void_radius" in rows.columns else []

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("y").to_numpy())
        px = table.column("px").to_pylist()
        image = np.array([px[i] for i in order], np.int64)
        radius = table.column("void_radius")[0].as_py() if own else config.void_proximity_radius
        found, median, sigma = extract_sources(image, seed_sigma, min_pixels, replace(config, void_proximity_radius=radius))
        names = [f.split()[0] for f in FIELDS.split(", ")]
        kinds = [pa.int32(), *[pa.float64()] * 9, pa.bool_()]
        n = len(found)
        cols = {"session_id": pa.array([key[0].as_py()] * n, pa.string()), "seq_index": pa.array([key[1].as_py()] * n, pa.int32())}
        cols |= {name: pa.array([getattr(s, name) for s in found], t) for name, t in zip(names, kinds, strict=True)}
        cols |= {"median": pa.array([median] * n, pa.float64()), "sigma": pa.array([sigma] * n, pa.float64())}
        shape = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("v", pa.int32())]))
        cols["footprint"] = pa.array([[{"x": int(x), "y": int(y), "v": int(v)} for x, y, v in zip(s.xs, s.ys, s.vs, strict=True)] for s in found], shape)
        return pa.table(cols)

    return rows.select("session_id", "seq_index", "y", "px", *own).groupBy("session_id", "seq_index").applyInArrow(run, SOURCES)


def label_native(pixels: DataFrame, keys: list[str], rounds: int = 64) -> DataFrame:
    """(keys, y, x, label): least raster place of each pixel's 8-connected part, by min-label rounds; for small frames."""
    now = pixels.select(*keys, "y", "x", (F.col("y") * 65536 + F.col("x")).alias("label"))
    shifts = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in [*AROUND, (0, 0)]])
    before = None
    for _ in range(rounds):
        sent = now.select(*keys, "y", "x", "label", F.explode(shifts).alias("s")).select(*keys, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "label")
        least = sent.groupBy(*keys, "y", "x").agg(F.min("label").alias("least"))
        now = now.join(least, [*keys, "y", "x"]).select(*keys, "y", "x", F.col("least").alias("label")).checkpoint()
        total = now.agg(F.sum("label")).first()[0]
        if total == before:
            return now
        before = total
    raise RuntimeError("labels did not settle")


# Shapes of footprints.


def _oriented(s: Source) -> tuple[np.ndarray, np.ndarray]:
    c, d = math.cos(s.angle), math.sin(s.angle)
    vx, vy = s.xs - s.x, s.ys - s.y
    return vx * c + vy * d, vy * c - vx * d


def _binned(along: np.ndarray, across: np.ndarray, step: float, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(count, width) of each bin along the axis; the width of an empty bin is 0."""
    at = np.clip(((along - along.min()) / step).astype(int), 0, bins - 1)
    hi, lo = np.full(bins, -np.inf), np.full(bins, np.inf)
    np.maximum.at(hi, at, across)
    np.minimum.at(lo, at, across)
    count = np.bincount(at, minlength=bins)
    return count, np.where(count > 0, hi - lo + 1, 0.0)


def is_binary_star_like(s: Source) -> bool:
    """A dumbbell: full at both ends, thin in the middle."""
    if len(s.xs) < 10:
        return False
    along, across = _oriented(s)
    length, width = float(np.ptp(along)) + 1, float(np.ptp(across)) + 1
    if length < 6 or width < 2 or s.pixel_area / max(1.0, length * width) < 0.35:
        return False
    bins = max(6, min(8, math.floor(length + 0.5)))
    count, wide = _binned(along, across, max(1.0, length / bins), bins)
    used = np.flatnonzero(count)
    lo, hi = used[0], used[-1]
    third = (hi - lo + 1) // 3
    if hi - lo < 4 or third < 1:
        return False
    ends = [slice(lo, lo + third), slice(hi - third + 1, hi + 1)]
    middle = slice(lo + third, hi - third + 1)
    peaks, widths = [int(count[e].max()) for e in ends], [float(wide[e].max()) for e in ends]
    if min(peaks) == 0 or max(peaks) > max(4, 2.8 * min(peaks)) or max(widths) > max(4.0, 2.8 * min(widths)):
        return False
    thin_count = count[middle].min() < 0.55 * min(peaks)
    # An empty bin sets the width to 0, but later occupied bins lower it no further.
    thin_width = wide[middle].min() < 0.72 * min(widths)
    return bool(thin_count and thin_width)


def is_irregular_streak(s: Source) -> bool:
    """Sparse, gapped or uneven along its axis."""
    if len(s.xs) < 10:
        return False
    along, across = _oriented(s)
    length, width = float(np.ptp(along)) + 1, float(np.ptp(across)) + 1
    if s.pixel_area / (length * width) < 0.35:
        return True
    if length < 10:
        return False
    _, wide = _binned(along, across, length / 5, 5)
    one, two, three = wide[1:4]
    inner = wide[1:4]
    waist = two < 0.4 * one and two < 0.4 * three
    uneven = inner.min() > 0 and inner.max() > max(4.0, 3 * inner.min())
    return bool(not inner.any() or waist or uneven)


def is_binary_star(image: np.ndarray, s: Source) -> bool:
    """Two peaks at least 4 pixels apart with a saddle below 80 % of the second; ``image`` holds stored values."""
    if len(s.xs) < 10:
        return False
    xs, ys = s.xs.astype(int), s.ys.astype(int)
    v = image[ys, xs].astype(int)
    top, low = int(np.argmax(v)), int(v.min())
    if v[top] <= low:
        return False
    far = np.flatnonzero(np.hypot(xs - xs[top], ys - ys[top]) >= 4)
    if not len(far):
        return False
    second = far[np.argmax(v[far])]
    first_signal, second_signal = float(v[top] - low), float(v[second] - low)
    dx, dy = xs[second] - xs[top], ys[second] - ys[top]
    steps = math.floor(math.hypot(dx, dy) + 0.5)
    if second_signal < 0.3 * first_signal or steps <= 1:
        return False
    t = np.arange(1, steps)
    px, py = np.floor(xs[top] + t * dx / steps + 0.5).astype(int), np.floor(ys[top] + t * dy / steps + 0.5).astype(int)
    ok = (px >= 0) & (py >= 0) & (px < image.shape[1]) & (py < image.shape[0])
    saddle = min([first_signal, *(image[py[ok], px[ok]].astype(float) - low)])
    return bool(saddle < 0.8 * second_signal)
