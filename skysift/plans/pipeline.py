"""The whole run over sessions of frames: extraction, quality, stacks, vetoes, linking, anomalies, residuals.

Every stage is a DataFrame keyed by session, so sessions run side by side. What later stages build upon is written once, which keeps
the plans of later stages small; the stack and what is found on it are persisted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DetectionConfig
from ..operators import background as bg
from ..operators import drift, linking, quality, reference, residual, sources, stacks, telemetry
from ..sources.frames import check_sizes, frame_rows, pixels
from ..sources.tables import materialize

Listener = Callable[[int, str], None]
SESSION = ["session_id"]


@dataclass
class RunResult:
    config: DetectionConfig
    frames: DataFrame  # quality, verdict and reason of every frame
    drift: DataFrame
    stack: DataFrame
    master_stars: DataFrame
    mask: DataFrame
    transients: DataFrame  # survivors of the veto, streaks included
    tracks: DataFrame
    anomalies: DataFrame
    unclassified: DataFrame
    residuals: DataFrame
    slow_movers: DataFrame | None
    objects: DataFrame
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Give back the storage of what the run persisted. Written tables stay under spark.checkpoint.dir."""
        for df in self.held:
            df.unpersist()

    def report(self) -> str:
        grab = lambda df, *keys: [r.asDict() for r in df.groupBy(*keys).count().orderBy(*keys).collect()]
        return telemetry.report({"frames": grab(self.frames, "session_id", "reason"), "tracks": grab(self.tracks.select("session_id", "kind", "track_id").distinct(), "session_id", "kind"), "anomalies": grab(self.anomalies, "session_id", "type"), "residuals": grab(self.residuals, "session_id", "kind")})


def _tell(listener: Listener | None, percent: int, what: str) -> None:
    if listener:
        listener(percent, what)


def analyze_drift(frames: DataFrame, config: DetectionConfig) -> tuple[DataFrame, DataFrame]:
    """Drift vectors of every frame, and (session_id, void_radius): the radius that they recommend for each session."""
    keys, size = ["session_id", "seq_index"], ["width", "height"]
    bounds = drift.valid_bounds(pixels(frames, *size), [*keys, *size], *size)
    vectors = materialize(drift.drift_vectors(bounds, [*keys, *size], *size).drop(*size), "drift")
    return vectors, drift.void_radius(vectors, config.void_proximity_radius, ("session_id",))


def session_quality(frames: DataFrame, config: DetectionConfig) -> DataFrame:
    """Frame metrics with is_rejected and reason."""
    own = ["void_radius"] if "void_radius" in frames.columns else []
    rows = frame_rows(frames, *own)
    found = sources.extract(rows, config.quality_sigma_multiplier, config.quality_min_detection_pixels, config.for_quality())
    back = bg.clipped_background(bg.histogram(pixels(frames), ["session_id", "seq_index"]), ["session_id", "seq_index"], config)
    metrics = materialize(quality.frame_quality(found, back, ["session_id", "seq_index"], config), "metrics")
    return quality.reject_frames(metrics, quality.session_thresholds(metrics, SESSION, config), SESSION)


def _kept(frames: DataFrame, verdicts: DataFrame) -> DataFrame:
    keep = quality.kept_frames(verdicts, SESSION, "seq_index").select("session_id", "seq_index", "frame_pos")
    return frames.join(keep, ["session_id", "seq_index"])


def generate_master_stack(frames: DataFrame, config: DetectionConfig = DetectionConfig(), listener: Listener | None = None) -> DataFrame:
    """Quality, rejection, median: the stack alone, without extraction of detections or drift. All rejected: ValueError."""
    check_sizes(frames)
    kept = materialize(_kept(frames, session_quality(frames, config)), "kept")
    if kept.isEmpty():
        raise ValueError("every frame was rejected")
    _tell(listener, 100, "stacked")
    return stacks.stack_rows(frame_rows(kept), config.slow_mover_stack_middle_fraction)


@dataclass
class Transients:
    config: DetectionConfig
    frames: DataFrame
    drift: DataFrame
    kept: DataFrame
    objects: DataFrame
    stack: DataFrame
    master_stars: DataFrame
    mask: DataFrame
    vetoed: DataFrame
    void_radius: DataFrame
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Give back the storage of what was persisted; the DataFrames stay usable and are computed again. Written tables stay."""
        for df in self.held:
            df.unpersist()


def detect_transients(frames: DataFrame, config: DetectionConfig = DetectionConfig(), listener: Listener | None = None, provided_stack: DataFrame | None = None) -> Transients:
    """Up to the stationary veto; a given stack replaces stacking only."""
    check_sizes(frames)
    if frames.isEmpty():
        raise ValueError("no frames")
    vectors, radius = analyze_drift(frames, config)
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return df

    radius = materialize(radius, "radius")
    frames = frames.join(radius, "session_id")
    _tell(listener, 10, "drift")
    verdicts = materialize(session_quality(frames, config), "verdicts")
    kept = materialize(_kept(frames, verdicts), "kept")
    if kept.isEmpty():
        raise ValueError("every frame was rejected")
    pos = kept.select("session_id", "seq_index", "frame_pos", "filename", "ts_ms", "exposure_ms")
    objects = sources.extract(frame_rows(kept, "void_radius"), config.detection_sigma_multiplier, config.min_detection_pixels, config).join(pos, ["session_id", "seq_index"])
    objects = materialize(objects.withColumn("det_id", (F.col("frame_pos").cast("long") * 10_000_000 + F.col("obj_ord"))), "objects")
    _tell(listener, 40, "extracted")
    stack = hold(provided_stack if provided_stack is not None else stacks.stack_rows(frame_rows(kept), config.slow_mover_stack_middle_fraction))
    stars = hold(sources.extract(stacks.stack_frame(stack, "median").join(radius, "session_id"), config.master_sigma_multiplier, config.master_min_detection_pixels, config.for_master()))
    size = kept.select("session_id", "width", "height").distinct()
    spots = reference.footprint_pixels(stars, SESSION).join(size, "session_id")
    mask = hold(reference.dilated_mask(spots, [*SESSION, "width", "height"], reference.engine_radius(config.max_star_jitter), "width", "height").drop("width", "height"))
    over = reference.overlap(reference.footprint_pixels(objects, ["session_id", "det_id"]), mask, ["session_id", "det_id"], SESSION)
    vetoed = materialize(reference.veto(objects, over, ["session_id", "det_id"], config), "vetoed")
    _tell(listener, 60, "vetoed")
    return Transients(config, verdicts, vectors, kept, objects, stack, stars, mask, vetoed, radius, held)


LINKED = "session_id string, what string, group_id int, kind string, ord int, det_id long"


def _link_session(config: DetectionConfig, compat_frame_index: bool):
    """Streak chains, point tracks, anomalies, suspected streaks and consolidation of one session, as rows."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = table.sort_by([("frame_pos", "ascending"), ("obj_ord", "ascending")])
        p = linking.points_from(t)
        streak = np.array(t.column("is_streak").to_pylist(), bool)
        shapes = {}
        for k in np.flatnonzero(streak).tolist():
            foot = t.column("footprint")[k].as_py()
            shapes[k] = sources.Source(k, p.x[k], p.y[k], p.flux[k], p.peak[k], p.integrated[k], p.area[k], p.fwhm[k], 0.0, p.angle[k], True, *(np.array([f[c] for f in foot], float) for c in "xyv"))
        out: list[tuple] = []
        n = t.column("n_frames")[0].as_py()
        if n >= 3:
            confirmed, alone = linking.chain_streaks(p, np.flatnonzero(streak).tolist(), config)
            single, _ = linking.promote_single_streaks(p, alone, shapes, config)
            confirmed += single
            points = np.flatnonzero(~streak)
            q = linking.Points(**{f: getattr(p, f)[points] for f in p.__dataclass_fields__})
            timed = []
            timestamps = linking.has_times(q)
            if timestamps:
                proposals = [(c, s, int(q.seq[c[0]])) for a in range(len(q)) for c, s in linking.timed_candidates(q, a, n, config)]
                timed = linking.pack(proposals)
            used = {k for c in timed for k in c}
            geometric = linking.geometric_tracks(q, n, config, used, timed) if config.enable_geometric_track_linking or not timestamps else []
            taken = {int(points[k]) for c in timed + geometric for k in c} | {k for tr in confirmed for k in tr.points}
            visible = [k for k in range(len(p)) if not (compat_frame_index and streak[k] and p.seq[k] >= n)]
            anomalies = [(k, a) for k in visible if k not in taken and (a := linking.anomaly_type(p.area[k], p.peak[k], p.integrated[k], config))] if config.enable_anomaly_rescue else []
            suspected = linking.suspected_streaks(p, [k for k, _ in anomalies], config)
            grouped = {k for tr in suspected for k in tr.points}
            anomalies = [(k, a) for k, a in anomalies if k not in grouped]
            tracks = [(tr.points, "streak" if tr.streak else "suspected_streak") for tr in linking.consolidate_streaks(p, confirmed, suspected, config)]
            tracks += [([int(points[k]) for k in c], kind) for group, kind in ((timed, "timed"), (geometric, "geometric")) for c in group]
            out = [("track", g, kind, o, int(p.det_id[k])) for g, (rows, kind) in enumerate(tracks) for o, k in enumerate(rows)]
            out += [("anomaly", g, kind, 0, int(p.det_id[k])) for g, (k, kind) in enumerate(anomalies)]
            used = {k for rows, _ in tracks for k in rows} | {k for k, _ in anomalies}
            out += [("unclassified", 0, None, 0, int(p.det_id[k])) for k in visible if k not in used]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64()]
        names = ["what", "group_id", "kind", "ord", "det_id"]
        return pa.table({"session_id": pa.array([key[0].as_py()] * len(out), pa.string())} | {c: pa.array([r[i] for r in out], ty) for i, (c, ty) in enumerate(zip(names, kinds, strict=True))})

    return run


def link(vetoed: DataFrame, frames: DataFrame, config: DetectionConfig, compat_frame_index: bool = False) -> DataFrame:
    """``frames``: (session_id, n_frames). Rows (session_id, what, group_id, kind, ord, det_id) of tracks, anomalies and leftovers. The greedy parts are ordered,
    so a session is one task; sessions run side by side."""
    alive = vetoed.filter(~F.col("is_purged")).join(frames, "session_id")
    alive = alive.repartition(int(alive.sparkSession.conf.get("spark.sql.shuffle.partitions")), "session_id")
    return alive.groupBy("session_id").applyInArrow(_link_session(config, compat_frame_index), LINKED)


def slow_movers(t: Transients) -> DataFrame | None:
    """Slow-mover candidates with overlap, residual flux and verdict; None when switched off."""
    config = t.config
    if not config.enable_slow_mover_detection:
        return None
    found = sources.extract(stacks.stack_frame(t.stack, "slow").join(t.void_radius, "session_id"), config.master_slow_mover_sigma_multiplier, config.master_slow_mover_min_pixels, config.for_slow_movers())
    t.held.append(found.persist())
    own = ["session_id", "obj_ord"]
    foot = reference.footprint_pixels(found, own)
    mask = reference.footprint_pixels(t.master_stars, SESSION).select("session_id", "y", "x").distinct()
    flat = t.stack.select("session_id", "y", F.posexplode(F.arrays_zip("slow", "median")).alias("x", "z")).select("session_id", "y", "x", "z.slow", "z.median")
    c = found.join(reference.overlap(foot, mask, own, SESSION), own, "left").join(reference.residual_flux(foot, flat, own, SESSION), own, "left")
    return reference.slow_mover_verdicts(c, reference.elongation_limit(found, SESSION, config), SESSION, config)


def run_pipeline(frames: DataFrame, config: DetectionConfig = DetectionConfig(), listener: Listener | None = None, provided_stack: DataFrame | None = None, compat_frame_index: bool = False) -> RunResult:
    t = detect_transients(frames, config, listener, provided_stack)
    n = t.kept.groupBy("session_id").agg((F.max("frame_pos") + 1).alias("n_frames"))
    linked = materialize(link(t.vetoed, n, t.config, compat_frame_index), "linked")
    _tell(listener, 90, "linked")
    alive = t.vetoed.filter(~F.col("is_purged"))
    what = lambda name: linked.filter(F.col("what") == name)
    tracks = what("track").select("session_id", F.col("group_id").alias("track_id"), "kind", "ord", "det_id")
    anomalies = what("anomaly").select("session_id", "det_id", F.col("kind").alias("type"))
    left = alive.join(what("unclassified").select("session_id", "det_id"), ["session_id", "det_id"], "left_semi")
    residuals = residual.analyze_residuals(left.filter(~F.col("is_streak")), t.config)
    _tell(listener, 100, "done")
    return RunResult(t.config, t.frames, t.drift, t.stack, t.master_stars, t.mask, alive, tracks, anomalies, left, residuals, slow_movers(t), t.objects, t.held)


__all__ = ["RunResult", "Transients", "analyze_drift", "detect_transients", "generate_master_stack", "link", "run_pipeline", "session_quality", "slow_movers"]
