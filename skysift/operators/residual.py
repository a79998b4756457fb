"""Leftover detections: local chains, proximity clusters, their metrics, kinds and scores."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DetectionConfig
from .linking import Points, points_from
from .sources import _merge_labels

#: Fixed values of the residual search.
LIMITS = {
    "min_repeat_points": 2, "min_motion_points": 4, "max_frame_gap": 2, "max_step_per_frame": 4.0, "edge_bias": 1.25, "max_chain_radius": 18.0,
    "micro_min_move": 1.25, "micro_max_move": 32.0, "micro_max_rmse": 1.8, "micro_min_coverage": 0.55,
    "repeat_max_move": 3.0, "repeat_max_radius": 2.5, "repeat_max_mean_step": 1.75, "repeat_max_rmse": 0.9, "repeat_min_coverage": 0.4, "repeat_min_signal": 5.0, "repeat_min_multi_move": 0.35,
    "sparse_min_move": 2.0, "sparse_max_move": 10.0, "sparse_max_radius": 4.5, "sparse_max_mean_step": 2.75, "sparse_max_rmse": 0.45, "sparse_min_coverage": 0.25, "sparse_min_signal": 5.0, "sparse_max_step": 3.5,
    "match_radius": 0.75, "link_radius": 4.0,
}
KIND_PENALTY = {"MICRO_DRIFT": 0.0, "LOCAL_REPEAT": 35.0, "SPARSE_LOCAL_DRIFT": 20.0}
METRICS = ["points", "frames", "span", "gaps", "move", "mean_step", "max_step", "rmse", "radius", "signal", "coverage", "cx", "cy"]


def metrics_of(p: Points, rows: list[int]) -> dict[str, float]:
    r = np.asarray(sorted(rows, key=lambda k: (p.seq[k], p.x[k], p.y[k])))
    t, x, y = p.seq[r].astype(float), p.x[r], p.y[r]
    step = np.hypot(np.diff(x), np.diff(y))
    n, span = len(r), int(t[-1] - t[0]) + 1

    def off(v: np.ndarray) -> np.ndarray:
        spread = n * (t @ t) - t.sum() ** 2
        if abs(spread) < 1e-9:
            return v - v.mean()
        slope = (n * (t @ v) - t.sum() * v.sum()) / spread
        return v - (slope * t + (v.sum() - slope * t.sum()) / n)

    rmse = math.sqrt(float((off(x) ** 2 + off(y) ** 2).sum()) / n) if n > 1 else 0.0
    cx, cy = float(x.mean()), float(y.mean())
    gaps = int(np.maximum(np.diff(t) - 1, 0).sum())
    values = (n, len(set(t)), span, gaps, math.hypot(x[-1] - x[0], y[-1] - y[0]), float(step.mean()) if n > 1 else 0.0, float(step.max()) if n > 1 else 0.0, rmse, float(np.hypot(x - cx, y - cy).max()), float(np.maximum(p.peak[r], p.integrated[r]).mean()), n / span, cx, cy)
    return dict(zip(METRICS, values, strict=True))


def kind_of(m: dict[str, float]) -> str | None:
    c = LIMITS
    far = c["max_step_per_frame"] * c["max_frame_gap"] + c["edge_bias"]
    enough = m["points"] >= c["min_motion_points"]
    if enough and c["micro_min_move"] <= m["move"] <= c["micro_max_move"] and m["coverage"] >= c["micro_min_coverage"] and m["rmse"] <= c["micro_max_rmse"] and m["max_step"] <= far:
        return "MICRO_DRIFT"
    small = m["radius"] <= c["sparse_max_radius"] and m["mean_step"] <= c["sparse_max_mean_step"] and m["max_step"] <= c["sparse_max_step"]
    bright = m["signal"] >= c["sparse_min_signal"] and m["coverage"] >= c["sparse_min_coverage"]
    if enough and c["sparse_min_move"] <= m["move"] <= c["sparse_max_move"] and small and bright and m["rmse"] <= c["sparse_max_rmse"] and m["span"] <= 4 * m["points"]:
        return "SPARSE_LOCAL_DRIFT"
    still = m["move"] <= c["repeat_max_move"] and m["radius"] <= c["repeat_max_radius"] and m["mean_step"] <= c["repeat_max_mean_step"] and m["max_step"] <= c["repeat_max_move"]
    bright = m["signal"] >= c["repeat_min_signal"] and m["coverage"] >= c["repeat_min_coverage"]
    alive = m["points"] <= 3 or m["move"] >= c["repeat_min_multi_move"]
    if m["points"] >= c["min_repeat_points"] and still and bright and alive and m["rmse"] <= c["repeat_max_rmse"] and m["span"] <= m["points"] + c["max_frame_gap"]:
        return "LOCAL_REPEAT"
    return None


def score_of(m: dict[str, float], kind: str) -> float:
    return 100.0 * m["points"] + 0.25 * min(m["signal"] * m["points"], 300.0) - 25.0 * m["rmse"] - 10.0 * m["gaps"] - 3.0 * m["mean_step"] + min(m["move"], 12.0) - KIND_PENALTY[kind]


def grow_chain(p: Points, start: int, order: np.ndarray) -> list[int]:
    """Greedily follow the point that costs least within two frames and the reach of the chain."""
    c, chain = LIMITS, [start]
    while True:
        last = chain[-1]
        gap = p.pos[order] - p.pos[last]
        near = order[(gap > 0) & (gap <= c["max_frame_gap"])]
        gap = p.pos[near] - p.pos[last]
        step = np.hypot(p.x[near] - p.x[last], p.y[near] - p.y[last])
        reach = np.hypot(p.x[near] - p.x[chain].mean(), p.y[near] - p.y[chain].mean())
        ok = (step <= c["max_step_per_frame"] * gap + c["edge_bias"]) & (reach <= c["max_chain_radius"])
        if not ok.any():
            return chain
        ex, ey = p.x[last], p.y[last]
        if len(chain) > 1:
            frames = max(1, int(p.pos[last] - p.pos[chain[-2]]))
            ex, ey = ex + (p.x[last] - p.x[chain[-2]]) / frames, ey + (p.y[last] - p.y[chain[-2]]) / frames
        signal = np.log1p(np.maximum(p.peak[near], p.integrated[near]))
        cost = np.hypot(p.x[near] - ex, p.y[near] - ey) + 0.35 * step + 0.75 * (gap - 1) - 0.1 * signal
        chain.append(int(near[ok][np.argmin(cost[ok])]))


def proximity_clusters(x: np.ndarray, y: np.ndarray, radius: float) -> list[np.ndarray]:
    """Single-linkage groups by distance, whatever the frame; a grid of the radius keeps candidates near."""
    n = len(x)
    if not n:
        return []
    cell = max(radius, 1e-9)
    grid: dict[tuple[int, int], list[int]] = {}
    for k, (cx, cy) in enumerate(zip(np.floor(x / cell).astype(int).tolist(), np.floor(y / cell).astype(int).tolist(), strict=True)):
        grid.setdefault((cx, cy), []).append(k)
    a, b = [], []
    for (cx, cy), own in grid.items():
        near = np.array([k for dx in (-1, 0, 1) for dy in (-1, 0, 1) for k in grid.get((cx + dx, cy + dy), ())])
        for k in own:
            hit = near[(near > k) & (np.hypot(x[near] - x[k], y[near] - y[k]) <= radius)]
            a += [k] * len(hit)
            b += hit.tolist()
    root = _merge_labels(n, np.array(a, int), np.array(b, int))
    return [np.flatnonzero(root == r) for r in np.unique(root)]


def rescue_candidates(p: Points) -> list[tuple[str, list[int], dict[str, float], float]]:
    """(kind, points, metrics, score), best first, without shared points."""
    order = np.lexsort((p.y, p.x, p.pos))
    groups = [grow_chain(p, int(k), order) for k in order]
    groups += [order[g].tolist() for g in proximity_clusters(p.x[order], p.y[order], LIMITS["link_radius"])]
    found = []
    for g in groups:
        if len(g) >= LIMITS["min_repeat_points"]:
            m = metrics_of(p, g)
            if kind := kind_of(m):
                found.append((kind, sorted(g, key=lambda k: (p.seq[k], p.x[k], p.y[k])), m, score_of(m, kind)))
    found.sort(key=lambda f: (-f[3], -f[2]["points"], -f[2]["span"], f[2]["rmse"]))
    used: set[int] = set()
    kept = []
    for f in found:
        if used.isdisjoint(f[1]):
            used.update(f[1])
            kept.append(f)
    return kept


def activity_clusters(p: Points, config: DetectionConfig) -> list[tuple[list[int], dict[str, float]]]:
    order = np.lexsort((p.y, p.x, p.pos))
    groups = [(order[g].tolist(), metrics_of(p, order[g].tolist())) for g in proximity_clusters(p.x[order], p.y[order], max(0.0, config.local_activity_cluster_radius_pixels))]
    kept = [g for g in groups if g[1]["frames"] >= max(1, config.local_activity_cluster_min_frames)]
    return sorted(kept, key=lambda g: (-g[1]["points"], -g[1]["frames"], g[1]["radius"]))


RESIDUAL = "session_id string, kind string, group_id int, score double, " + ", ".join(f"{m} double" for m in METRICS) + ", members array<long>"


def analyze_residuals(detections: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Rescue candidates, then (if enabled) activity clusters of what they leave; point sources only."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        p = points_from(table)
        rows = []
        if config.enable_residual_transient_analysis and config.enable_local_rescue_candidates and len(p):
            rows = [(kind, k, score, m, p.det_id[g].tolist()) for k, (kind, g, m, score) in enumerate(rescue_candidates(p))]
        if config.enable_residual_transient_analysis and config.enable_local_activity_clusters and len(p):
            used = {d for r in rows for d in r[4]}
            left = table.filter(pa.array([d not in used for d in table.column("det_id").to_pylist()]))
            q = points_from(left)
            rows += [("ACTIVITY_CLUSTER", k, None, m, q.det_id[g].tolist()) for k, (g, m) in enumerate(activity_clusters(q, config))] if len(q) else []
        cols = {"session_id": pa.array([key[0].as_py()] * len(rows), pa.string()), "kind": pa.array([r[0] for r in rows], pa.string()), "group_id": pa.array([r[1] for r in rows], pa.int32()), "score": pa.array([r[2] for r in rows], pa.float64())}
        cols |= {m: pa.array([float(r[3][m]) for r in rows], pa.float64()) for m in METRICS}
        return pa.table(cols | {"members": pa.array([r[4] for r in rows], pa.list_(pa.int64()))})

    return detections.groupBy("session_id").applyInArrow(run, RESIDUAL)


def group_metrics(points: DataFrame, keys: list[str]) -> DataFrame:
    """The same metrics natively for points (keys, frame, x, y, signal), one row a group."""
    w = Window.partitionBy(*keys).orderBy("frame", "x", "y")
    step = points.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w), "pf": F.lag("frame").over(w)})
    step = step.withColumns({"step": F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2), "gap": F.greatest(F.col("frame") - F.col("pf") - 1, F.lit(0)), "t": F.col("frame").cast("double")})
    whole = Window.partitionBy(*keys)
    n = F.count("*").over(whole)
    sums = {"n": n, "st": F.sum("t").over(whole), "stt": F.sum(F.col("t") * F.col("t")).over(whole)}
    sums |= {f"s{a}": F.sum(a).over(whole) for a in "xy"} | {f"st{a}": F.sum(F.col("t") * F.col(a)).over(whole) for a in "xy"}
    f = step.withColumns(sums).withColumn("den", F.col("n") * F.col("stt") - F.col("st") * F.col("st"))
    flat = F.abs("den") < 1e-9
    for a in "xy":
        slope = F.when(flat, 0.0).otherwise((F.col("n") * F.col(f"st{a}") - F.col("st") * F.col(f"s{a}")) / F.when(flat, 1.0).otherwise(F.col("den")))
        f = f.withColumn(f"k{a}", slope).withColumn(f"r{a}", F.col(a) - (F.col(f"k{a}") * F.col("t") + (F.col(f"s{a}") - F.col(f"k{a}") * F.col("st")) / F.col("n")))
    f = f.withColumn("far", F.sqrt((F.col("x") - F.col("sx") / F.col("n")) ** 2 + (F.col("y") - F.col("sy") / F.col("n")) ** 2))
    ends = F.struct("frame", "x", "y")
    g = f.groupBy(*keys).agg(
        F.count("*").alias("points"), F.count_distinct("frame").alias("frames"), F.min(ends).alias("a"), F.max(ends).alias("b"), F.coalesce(F.sum("gap"), F.lit(0)).alias("gaps"), F.coalesce(F.avg("step"), F.lit(0.0)).alias("mean_step"),
        F.coalesce(F.max("step"), F.lit(0.0)).alias("max_step"), F.sqrt(F.avg(F.col("rx") ** 2 + F.col("ry") ** 2)).alias("rmse"), F.max("far").alias("radius"), F.avg("signal").alias("signal"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
    )
    span = F.col("b.frame") - F.col("a.frame") + 1
    move = F.sqrt((F.col("b.x") - F.col("a.x")) ** 2 + (F.col("b.y") - F.col("a.y")) ** 2)
    rmse = F.when(F.col("points") < 2, 0.0).otherwise(F.col("rmse"))
    return g.select(*keys, "points", "frames", span.alias("span"), "gaps", move.alias("move"), "mean_step", "max_step", rmse.alias("rmse"), "radius", "signal", (F.col("points") / span).alias("coverage"), "cx", "cy")


def kind_column(c: dict = LIMITS):
    """The kind of a row of metrics, as an expression."""
    m = F.col
    far = c["max_step_per_frame"] * c["max_frame_gap"] + c["edge_bias"]
    micro = (m("points") >= c["min_motion_points"]) & m("move").between(c["micro_min_move"], c["micro_max_move"]) & (m("coverage") >= c["micro_min_coverage"]) & (m("rmse") <= c["micro_max_rmse"]) & (m("max_step") <= far)
    sparse = (
        (m("points") >= c["min_motion_points"]) & m("move").between(c["sparse_min_move"], c["sparse_max_move"]) & (m("radius") <= c["sparse_max_radius"]) & (m("mean_step") <= c["sparse_max_mean_step"])
        & (m("rmse") <= c["sparse_max_rmse"]) & (m("coverage") >= c["sparse_min_coverage"]) & (m("signal") >= c["sparse_min_signal"]) & (m("max_step") <= c["sparse_max_step"]) & (m("span") <= m("points") * 4)
    )
    repeat = (
        (m("points") >= c["min_repeat_points"]) & (m("move") <= c["repeat_max_move"]) & (m("radius") <= c["repeat_max_radius"]) & (m("mean_step") <= c["repeat_max_mean_step"]) & (m("rmse") <= c["repeat_max_rmse"])
        & (m("coverage") >= c["repeat_min_coverage"]) & (m("signal") >= c["repeat_min_signal"]) & (m("max_step") <= c["repeat_max_move"]) & ((m("points") <= 3) | (m("move") >= c["repeat_min_multi_move"])) & (m("span") <= m("points") + c["max_frame_gap"])
    )
    return F.when(micro, "MICRO_DRIFT").when(sparse, "SPARSE_LOCAL_DRIFT").when(repeat, "LOCAL_REPEAT")


def score_column():
    m = F.col
    penalty = F.when(m("kind") == "LOCAL_REPEAT", 35.0).when(m("kind") == "SPARSE_LOCAL_DRIFT", 20.0).otherwise(0.0)
    return m("points") * 100.0 + F.least(m("signal") * m("points"), F.lit(300.0)) * 0.25 - m("rmse") * 25.0 - m("gaps") * 10.0 - m("mean_step") * 3.0 + F.least(m("move"), F.lit(12.0)) - penalty


def exclude_near(detections: DataFrame, known: DataFrame, radius: float = LIMITS["match_radius"]) -> DataFrame:
    """Detections that no known one of the same frame lies within ``radius`` of; a bucketed anti join."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    k = known.select(F.col("frame").alias("kf"), F.col("x").alias("kx"), F.col("y").alias("ky"), F.explode(around).alias("s"))
    k = k.withColumns({"gx": F.floor(F.col("kx") / radius).cast("long") + F.col("s.i"), "gy": F.floor(F.col("ky") / radius).cast("long") + F.col("s.j")})
    d = detections.withColumns({"gx": cell("x"), "gy": cell("y")})
    near = (d["frame"] == k["kf"]) & (d["gx"] == k["gx"]) & (d["gy"] == k["gy"]) & (F.sqrt((d["x"] - k["kx"]) ** 2 + (d["y"] - k["ky"]) ** 2) <= radius)
    return d.join(k, near, "left_anti").drop("gx", "gy")
