"""The extraction tuner: sampling, crops, jitter calibration, parameter grid, scores, winner, report."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import POLICIES, DetectionConfig, TunerPolicy
from ..functions.columns import clamp01, normalize
from .reference import tuner_radius
from .sources import Source, extract_sources


@dataclass(frozen=True)
class TunerSettings:
    sample_size: int = 5
    search_radius: float = 4.0
    min_stable: int = 15
    optimal_stars: float = 100.0
    max_objects: int = 500_000
    min_objects: int = 10
    sigmas: tuple[float, ...] = (3.5, 4.0, 5.0, 6.0, 7.0)
    min_pixels: tuple[int, ...] = (3, 5, 7, 9, 12)
    grow_deltas: tuple[float, ...] = (0.75, 1.25, 1.75)
    grow_above_master: float = 0.5
    overlaps: tuple[float, ...] = (0.65, 0.70, 0.75)
    soft_coverage: float = 0.08
    hard_coverage: float = 0.25
    lower_sigma_window: float = 8.0
    stable_cv: float = 0.25
    transient_cv: float = 0.75
    jitter_percentile: float = 0.90
    jitter_floor: float = 1.0
    jitter_safety: float = 2.0
    jitter_fallback: float = 1.5
    probe_sigma: float = 4.0
    probe_grow: float = 3.0
    probe_pixels: int = 5
    probe_elongation: float = 2.5
    probe_matches: int = 8
    border: int = 200
    crop_sizes: tuple[int, ...] = (1024, 768)
    min_crop: int = 384


def crop_regions(width: int, height: int, s: TunerSettings = TunerSettings()) -> list[tuple[int, int, int, str]]:
    """(x, y, size, label) of three square crops inside the border margin; none when they would be too small."""
    usable = (width - 2 * s.border, height - 2 * s.border)
    size = next((c for c in s.crop_sizes if min(usable) >= c), min(usable))
    if min(usable) <= 0 or size < s.min_crop:
        return []
    far = (width - s.border - size, height - s.border - size)
    middle = [max(s.border, min(f, (n - size) // 2)) for f, n in zip(far, (width, height), strict=True)]
    return [(s.border, s.border, size, "upper-left"), (*middle, size, "center"), (*far, size, "lower-right")]


def sample_ranks(n: int, size: int = 5) -> list[int]:
    """Ranks by quality score of the sampled frames: the best three, around the middle, then on from the best."""
    target = min(size, n)
    wanted = list(range(min(3, target)))
    for k in (max(0, n // 2 - 1), n // 2, min(n - 1, n // 2 + 1), min(n - 1, math.floor(n * 0.7 + 0.5)), *range(n)):
        if len(wanted) < target and k not in wanted:
            wanted.append(k)
    return wanted


def sample_frames(metrics: DataFrame, order: str, n: int, size: int = 5) -> DataFrame:
    """Rows of the sampled frames of one session of ``n``; score is noise * fwhm."""
    ranked = metrics.withColumn("score", F.col("noise") * F.col("fwhm")).withColumn("rank", F.row_number().over(Window.orderBy("score", order)) - 1)
    return ranked.filter(F.col("rank").isin(sample_ranks(n, size)))


def reciprocal_matches(stars: DataFrame, objects: DataFrame, radius: float) -> DataFrame:
    """stars(s_id, sx, sy), objects(frame, o_id, x, y): pairs that are each other's nearest within the frame, up to ``radius``."""
    from .spatial import radius_search

    found = radius_search(objects.select(F.struct("frame", "o_id").alias("q_id"), F.col("x").alias("qx"), F.col("y").alias("qy")), stars.select(F.col("s_id").alias("p_id"), F.col("sx").alias("x"), F.col("sy").alias("y")), radius)
    found = found.select("q_id.frame", "q_id.o_id", F.col("p_id").alias("s_id"), "dist")
    mine = F.row_number().over(Window.partitionBy("frame", "o_id").orderBy("dist", "s_id"))
    theirs = F.row_number().over(Window.partitionBy("frame", "s_id").orderBy("dist", "o_id"))
    return found.withColumns({"a": mine, "b": theirs}).filter("a = 1 and b = 1").drop("a", "b")


def jitter_from(matches: DataFrame, s: TunerSettings = TunerSettings(), keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, matches, jitter): the scaled percentile by index, at least the floor; the fallback with few matches."""
    d = matches.groupBy(*keys).agg(F.array_sort(F.collect_list("dist")).alias("d"))
    n = F.size("d")
    at = F.get("d", F.floor(F.lit(s.jitter_percentile) * (n - 1) + 0.5).cast("int"))
    value = F.when(n < s.probe_matches, max(s.jitter_floor, s.jitter_fallback)).otherwise(F.greatest(F.lit(s.jitter_floor), at * s.jitter_safety))
    return d.select(*keys, n.alias("matches"), value.alias("jitter"))


def grid(spark: SparkSession, master_sigma: float = 2.25, s: TunerSettings = TunerSettings()) -> DataFrame:
    """(ord, min_pix, sigma, grow_delta, overlap, grow): the grid in sweep order; points with grow >= sigma are left out."""
    rows, k = [], 0
    for pix in s.min_pixels:
        for sigma in s.sigmas:
            for delta in s.grow_deltas:
                for over in s.overlaps:
                    rows.append((k, pix, sigma, delta, over, max(1.0, sigma - delta, master_sigma + s.grow_above_master)))
                    k += 1
    return spark.createDataFrame([r for r in rows if r[5] < r[2]], "ord int, min_pix int, sigma double, grow_delta double, overlap double, grow double")


def sweet_spot(x: Column, p: TunerPolicy) -> Column:
    if p.high <= p.low:
        return F.lit(0.0)
    below, above = clamp01((p.low - x) / max(p.low, 1e-9)), clamp01((x - p.high) / max(p.high, 1e-9))
    left, right = 0.5 * clamp01((p.target - x) / max(p.target - p.low, 1e-9)), 0.5 * clamp01((x - p.target) / max(p.high - p.target, 1e-9))
    return F.when(x < p.low, below).when(x > p.high, above).when(x <= p.target, left).otherwise(right)


def low_sigma_guard(sigma: Column, min_pix: Column, p: TunerPolicy) -> Column:
    wanted = 3.0 + (p.guard_pivot - sigma) * p.guard_slope
    return F.when((sigma >= p.guard_pivot) | (min_pix >= wanted), 0.0).otherwise(clamp01((wanted - min_pix) / F.greatest(wanted, F.lit(1e-9))))


def score_column(p: TunerPolicy, s: TunerSettings = TunerSettings()) -> Column:
    """Score of a row (stable_avg, ratio, transient_avg, stable_cv, transient_cv, coverage, sigma, min_pix, grow_delta)."""
    c = F.col
    variance = 0.6 * clamp01(c("stable_cv") / s.stable_cv) + 0.4 * clamp01(c("transient_cv") / s.transient_cv)
    harsh = p.harsh_sigma * normalize(c("sigma"), s.sigmas[0], s.sigmas[-1]) + p.harsh_pixels * normalize(c("min_pix"), s.min_pixels[0], s.min_pixels[-1]) + p.harsh_grow * normalize(c("grow_delta"), s.grow_deltas[0], s.grow_deltas[-1])
    return (
        p.w_stable * clamp01(c("stable_avg") / s.optimal_stars) - p.w_over * clamp01(c("ratio") / p.max_ratio) - p.w_sweet * sweet_spot(c("transient_avg"), p) - p.w_variance * variance
        - p.w_mask * clamp01((c("coverage") - s.soft_coverage) / (s.hard_coverage - s.soft_coverage)) - p.w_harsh * harsh - p.w_guard * low_sigma_guard(c("sigma"), c("min_pix"), p)
    )


def gate_column(p: TunerPolicy, s: TunerSettings = TunerSettings()) -> Column:
    """Why a point is not scored, or null."""
    c = F.col
    return (
        F.when(~c("usable"), "crop failure").when((c("objects") > s.max_objects) | (c("objects") < s.min_objects), "object count out of bounds")
        .when((c("ratio") > p.max_ratio) | (c("stable") < s.min_stable), "too few stable or too many transient")
    )


def pick_winner(rows: list[dict], p: TunerPolicy, s: TunerSettings = TunerSettings()) -> dict | None:
    """Fold over scored points in sweep order. A higher score wins; where lower sigmas are preferred, so does a near tie
    with a lower sigma, which then sets the score to beat."""
    best = None
    for r in rows:
        near = best is not None and p.prefer_lower_sigma and best["score"] - r["score"] <= s.lower_sigma_window and r["sigma"] < best["sigma"]
        if best is None or r["score"] > best["score"] or near:
            best = r
    return best


def leaderboard(scored: DataFrame, top: int = 5) -> DataFrame:
    """The best points with their gap to the first."""
    w = Window.orderBy(F.desc("score"), "ord")
    best = scored.orderBy(F.desc("score"), "ord").limit(top)
    return best.withColumns({"place": F.row_number().over(w), "gap": F.first("score").over(w) - F.col("score")})


def _mask(stars: list[Source], radius: int, height: int, width: int) -> np.ndarray:
    mask = np.zeros((height, width), bool)
    offs = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    for s in stars:
        for dy, dx in offs:
            y, x = s.ys.astype(int) + dy, s.xs.astype(int) + dx
            ok = (y >= 0) & (x >= 0) & (y < height) & (x < width)
            mask[y[ok], x[ok]] = True
    return mask


def _upper_stack(cube: np.ndarray) -> np.ndarray:
    return np.partition(cube, len(cube) // 2, axis=0)[len(cube) // 2]


def _nearest(a: list[Source], b: list[Source]) -> np.ndarray:
    d = np.hypot(np.array([s.x for s in a])[:, None] - np.array([s.x for s in b]), np.array([s.y for s in a])[:, None] - np.array([s.y for s in b]))
    return d


def jitter_distances(cube: np.ndarray, config: DetectionConfig, s: TunerSettings) -> list[float]:
    """Distances of mutual nearest matches between one crop's stack and its frames."""
    probe = replace(config, grow_sigma_multiplier=s.probe_grow, edge_margin_pixels=5, void_proximity_radius=5)
    usable = lambda found: [q for q in found if q.pixel_area >= s.probe_pixels and q.elongation <= s.probe_elongation]
    stars = usable(extract_sources(_upper_stack(cube), config.master_sigma_multiplier, config.master_min_detection_pixels, config.for_master())[0])
    out: list[float] = []
    for image in cube:
        own = usable(extract_sources(image, s.probe_sigma, s.probe_pixels, probe)[0])
        if stars and own:
            d = _nearest(stars, own)
            mine, theirs = d.argmin(axis=1), d.argmin(axis=0)
            out += [float(d[k, j]) for k, j in enumerate(mine) if d[k, j] <= s.search_radius and theirs[j] == k]
    return out


def jitter_value(distances: list[float], s: TunerSettings) -> float:
    if len(distances) < s.probe_matches:
        return max(s.jitter_floor, s.jitter_fallback)
    d = sorted(distances)
    return max(s.jitter_floor, d[math.floor(s.jitter_percentile * (len(d) - 1) + 0.5)] * s.jitter_safety)


CROP_EVAL = "crop int, frame int, sigma double, grow double, min_pix int, overlaps array<double>, objects int, streaks int, coverage double, mask_pixels long, area long, has_stars boolean"


def evaluate_crops(crops: DataFrame, points: DataFrame, config: DetectionConfig) -> DataFrame:
    """crops(crop, frame, y, px) x grid -> one row per crop, frame and distinct (sigma, grow, min_pix), with each source's
    overlap. Stack, stars and mask do not depend on the grid: once a crop."""
    distinct = [tuple(r) for r in points.select("sigma", "grow", "min_pix").distinct().orderBy("sigma", "grow", "min_pix").collect()]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = table.sort_by([("frame", "ascending"), ("y", "ascending")])
        frames = np.unique(t.column("frame").to_numpy())
        px = np.array(t.column("px").to_pylist(), np.int64)
        cube = px.reshape(len(frames), -1, px.shape[1])
        stars = extract_sources(_upper_stack(cube), config.master_sigma_multiplier, config.master_min_detection_pixels, config.for_master())[0]
        mask = _mask(stars, tuner_radius(config.max_star_jitter), *cube.shape[1:])
        rows = []
        for sigma, grow, pix in distinct:
            own = replace(config, grow_sigma_multiplier=grow)
            for f, image in zip(frames.tolist(), cube, strict=True):
                found = extract_sources(image, sigma, pix, own)[0]
                over = [float(mask[q.ys.astype(int), q.xs.astype(int)].mean()) for q in found if not q.is_streak]
                rows.append((key[0].as_py(), f, sigma, grow, pix, over, len(found), len(found) - len(over), float(mask.mean()), int(mask.sum()), mask.size, bool(stars)))
        names = [c.split()[0] for c in CROP_EVAL.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})

    return crops.select("crop", "frame", "y", "px").groupBy("crop").applyInArrow(run, CROP_EVAL)


def sweep(evaluated: DataFrame, points: DataFrame, s: TunerSettings = TunerSettings()) -> DataFrame:
    """Counts, ratios and variations of every grid point; the overlap limit is a cheap filter on kept overlaps."""
    j = F.broadcast(points).join(evaluated, ["sigma", "grow", "min_pix"])
    stable = F.size(F.filter("overlaps", lambda o: o >= F.col("overlap")))
    j = j.withColumn("st", stable).withColumn("tr", F.size("overlaps") - F.col("st"))
    cv = lambda c: F.when(F.avg(c) <= 1e-9, 0.0).otherwise(F.stddev_pop(c) / F.avg(c))
    g = j.groupBy("ord", "min_pix", "sigma", "grow_delta", "overlap", "grow").agg(
        F.sum("objects").alias("objects"), F.sum("st").alias("stable"), F.sum("tr").alias("transient"), F.avg("st").alias("stable_avg"), F.avg("tr").alias("transient_avg"), cv("st").alias("stable_cv"), cv("tr").alias("transient_cv"),
        (F.sum("mask_pixels") / F.sum("area")).alias("coverage"), F.bool_and(F.col("has_stars") & (F.col("coverage") <= s.hard_coverage)).alias("usable"),
    )
    return g.withColumn("ratio", F.when(F.col("objects") == 0, 1.0).otherwise(F.col("transient") / F.greatest(F.col("objects"), F.lit(1))))


@dataclass
class TuneResult:
    config: DetectionConfig
    success: bool
    score: float | None
    report: str


def tune(crops: DataFrame, base: DetectionConfig = DetectionConfig(), profile: str = "BALANCED", s: TunerSettings = TunerSettings(), listener: Callable[[int, str], None] | None = None) -> TuneResult:
    """Calibrate jitter on crops(crop, frame, y, px), sweep the grid, choose and validate a winner; the base config if none."""
    tell = listener or (lambda percent, what: None)
    if crops.select("frame").distinct().count() < s.sample_size:
        return TuneResult(base, False, None, "not enough frames: the base parameters stay")
    policy = POLICIES[profile]

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("frame", "ascending"), ("y", "ascending")])
        px = np.array(t.column("px").to_pylist(), np.int64)
        cube = px.reshape(len(np.unique(t.column("frame").to_numpy())), -1, px.shape[1])
        return pa.table({"dist": pa.array(jitter_distances(cube, base, s), pa.float64())})

    distances = [r[0] for r in crops.select("crop", "frame", "y", "px").groupBy("crop").applyInArrow(run, "dist double").collect()]
    jitter = jitter_value(distances, s)
    tell(20, f"jitter {jitter:.2f} px from {len(distances)} matches")
    config = replace(base, max_star_jitter=jitter)
    points = grid(crops.sparkSession, base.master_sigma_multiplier, s)
    swept = sweep(evaluate_crops(crops, points, config), points, s).withColumn("gate", gate_column(policy, s)).persist()
    rows = [r.asDict() for r in swept.filter("gate is null").withColumn("score", score_column(policy, s)).orderBy("ord").collect()]
    best = pick_winner(rows, policy, s)
    lines = [f"profile {profile}: {len(rows)} of {swept.count()} points scored, jitter {jitter:.2f} px"]
    swept.unpersist()
    if best is None:
        return TuneResult(base, False, None, "\n".join([*lines, "no point passed: the base parameters stay"]))
    lines += [f"#{k + 1} score {r['score']:.2f} sigma {r['sigma']} grow {r['grow']:.2f} pixels {r['min_pix']} overlap {r['overlap']}" for k, r in enumerate(sorted(rows, key=lambda r: (-r["score"], r["ord"]))[:5])]
    won = replace(config, detection_sigma_multiplier=best["sigma"], grow_sigma_multiplier=best["grow"], min_detection_pixels=best["min_pix"], max_mask_overlap_fraction=best["overlap"])
    one = points.filter(F.col("ord") == best["ord"])
    again = sweep(evaluate_crops(crops, one, won), one, s).withColumn("gate", gate_column(policy, s)).first()
    lines.append(f"validation: {again['gate'] or 'passed'}, {again['stable']} stable, {again['transient']} transient")
    tell(100, "tuned")
    return TuneResult(won, again["gate"] is None, best["score"], "\n".join(lines))
