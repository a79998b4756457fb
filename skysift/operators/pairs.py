"""Pair- and triple-level linking as joins, with ordered reject codes; scores and rhythm of given tracks natively."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DetectionConfig
from ..functions import columns as c

GATED = ["frame", "det_id", "x", "y", "flux", "area", "fwhm", "ts_ms", "exposure_ms"]


def baseline_codes(detections: DataFrame, config: DetectionConfig, frame_gap: int | None = None, session: str = "session") -> DataFrame:
    """Every pair of detections of two frames of a session (later than the first, within ``frame_gap`` if given) with a code:
    the first gate that fails (dt, jitter, profile, exposure) or ok. Frames are joined by equality: a first point is sent to
    each later frame that its session has, so the join is a hash join and never compares all rows with all."""
    a, b = (detections.select(session, *[F.col(k).alias(f"{k}{n}") for k in GATED]) for n in (1, 2))
    last = detections.groupBy(session).agg(F.max("frame").alias("last"))
    upto = F.least(F.col("last"), F.col("frame1") + frame_gap) if frame_gap else F.col("last")
    a = a.join(last, session).filter("frame1 < last").withColumn("frame2", F.explode(F.sequence(F.col("frame1") + 1, upto))).drop("last")
    p = a.join(b, [session, "frame2"])
    dt = (F.col("ts_ms2") - F.col("ts_ms1")).cast("double")
    dist = c.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    p = p.withColumns({"dt": dt, "dist": dist})
    similar = c.profile_consistent(*[F.col(k) for k in ("fwhm1", "flux1", "area1", "fwhm2", "flux2", "area2")], config)
    far = F.col("dist") > c.exposure_limit(F.col("area1"), F.col("exposure_ms1"), F.col("dt"), config)
    known = (F.col("ts_ms1") != -1) & (F.col("ts_ms2") != -1) & (F.col("exposure_ms1") > 0) & F.lit(config.strict_exposure_kinematics)
    code = F.when(F.col("dt") <= 0, "dt").when(F.col("dist") < config.max_star_jitter, "jitter").when(~similar, "profile").when(known & far, "exposure").otherwise("ok")
    return p.withColumn("code", code)


def reject_counts(codes: DataFrame) -> DataFrame:
    return codes.groupBy("code").agg(F.count("*").alias("pairs"))


def close_pairs(detections: DataFrame, config: DetectionConfig, frame_gap: int) -> DataFrame:
    """Pairs of nearby frames within the jump limit and not within the jitter: the geometric baseline gates."""
    p = baseline_codes(detections, config, frame_gap)
    return p.filter((F.col("dist") >= config.max_star_jitter) & (F.col("dist") <= config.max_jump_pixels) & (F.col("code") != "profile"))


def collinear_triples(detections: DataFrame, config: DetectionConfig, reach: float) -> DataFrame:
    """Triples of consecutive frames within ``reach`` per step and the line tolerance, turning within the cone."""
    pair = close_pairs(detections, config, 1).filter(F.col("dist") <= reach)
    first = pair.select("frame1", "det_id1", "x1", "y1", F.col("frame2"), F.col("det_id2"), F.col("x2"), F.col("y2"), F.col("dist").alias("d12"), F.col("dt").alias("dt12"))
    then = pair.select(F.col("frame1").alias("frame2"), F.col("det_id1").alias("det_id2"), F.col("det_id2").alias("det_id3"), F.col("x2").alias("x3"), F.col("y2").alias("y3"), F.col("dist").alias("d23"), F.col("dt").alias("dt23"))
    t = first.join(then, ["frame2", "det_id2"])
    error = c.line_distance(*[F.col(k) for k in ("x1", "y1", "x2", "y2", "x3", "y3")], F.col("d12"))
    turn = c.angular_difference(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")), F.atan2(F.col("y3") - F.col("y2"), F.col("x3") - F.col("x2")))
    return t.withColumns({"line_error": error, "turn": turn}).filter((F.col("line_error") <= config.prediction_tolerance) & (F.col("turn") <= math.radians(45)))


def velocity_matches(triples: DataFrame, config: DetectionConfig) -> DataFrame:
    """For each baseline the third point of least velocity error among those within the tolerance; ties by id."""
    v = triples.filter("dt12 > 0 and dt23 > 0").withColumns({"v12": F.col("d12") / F.col("dt12"), "off": F.abs(F.col("d23") / F.col("dt23") - F.col("d12") / F.col("dt12"))})
    v = v.filter(F.col("off") <= F.col("v12") * config.time_based_velocity_tolerance + F.lit(config.max_star_jitter) / F.col("dt23"))
    w = Window.partitionBy("det_id1", "det_id2").orderBy("off", "det_id3")
    return v.withColumn("k", F.row_number().over(w)).filter("k = 1").select("det_id1", "det_id2", "det_id3", "off")


def rhythm(points: DataFrame, key: str, order: str, config: DetectionConfig) -> DataFrame:
    """(key, jumps, typical, consistent, steady) of tracks given as points."""
    w = Window.partitionBy(key).orderBy(order)
    j = points.withColumn("jump", c.distance(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y")))
    g = j.groupBy(key).agg(F.count("*").alias("n"), F.collect_list("jump").alias("js")).withColumn("typical", c.upper_median(F.col("js")))
    times = lambda v: c.round_half_up(v / F.col("typical"))
    good = F.size(F.filter("js", lambda v: (times(v) > 0) & (F.abs(v - times(v) * F.col("typical")) <= times(v) * config.rhythm_allowed_variance)))
    still = (F.col("typical") < config.rhythm_stationary_threshold) | (F.col("typical") == 0)
    g = g.withColumn("consistent", F.when((F.col("n") < 3) | still, 0).otherwise(good))
    steady = F.when(F.col("n") < 3, True).when(still, False).otherwise(F.col("consistent") / F.size("js") >= config.rhythm_min_consistency_ratio)
    return g.select(key, F.size("js").alias("jumps"), "typical", "consistent", steady.alias("steady"))


def track_scores(points: DataFrame, key: str) -> DataFrame:
    """(key, points, score) of tracks given as points (frame, x, y, ts_ms), ordered by frame and det_id."""
    w = Window.partitionBy(key).orderBy("frame", "det_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = points.withColumns({f"{k}_{e}": (F.first if e == "a" else F.last)(k).over(whole) for k in ("x", "y", "ts_ms", "frame") for e in "ab"})
    p = p.withColumns({f"{k}_p": F.lag(k).over(w) for k in ("x", "y", "ts_ms", "frame")}).withColumns({"k": F.row_number().over(w), "n": F.count("*").over(whole)})
    total = c.distance(F.col("x_a"), F.col("y_a"), F.col("x_b"), F.col("y_b"))
    p = p.withColumn("total", total)
    p = p.withColumn("speed", F.col("total") / F.greatest(c.track_delta(F.col("ts_ms_a"), F.col("ts_ms_b"), F.col("frame_a"), F.col("frame_b")), F.lit(1e-4)))
    bend = c.line_distance(*[F.col(k) for k in ("x_a", "y_a", "x_b", "y_b", "x", "y")], F.greatest(F.col("total"), F.lit(1e-4)))
    step = c.distance(F.col("x_p"), F.col("y_p"), F.col("x"), F.col("y")) / c.track_delta(F.col("ts_ms_p"), F.col("ts_ms"), F.col("frame_p"), F.col("frame"))
    turn = c.angular_difference(F.atan2(F.col("y_b") - F.col("y_a"), F.col("x_b") - F.col("x_a")), F.atan2(F.col("y") - F.col("y_p"), F.col("x") - F.col("x_p")))
    seg = F.col("k") > 1
    g = p.groupBy(key).agg(
        F.first("n").alias("points"), F.first("total").alias("total"), F.first(F.greatest(F.lit(1), F.col("frame_b") - F.col("frame_a"))).alias("span"),
        F.avg(F.when(seg & (F.col("k") < F.col("n")), bend)).alias("bend"), F.avg(F.when(seg, turn)).alias("turn"),
        F.avg(F.when(seg, F.when(F.col("speed") > 0, F.abs(step - F.col("speed")) / F.when(F.col("speed") > 0, F.col("speed"))).otherwise(0.0))).alias("drift"),
    )
    z = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    score = F.col("points") * 1000.0 + F.col("points") / (F.col("span") + 1.0) * 250.0 + F.col("span") * 50.0 + F.col("total") * 5.0 - z("bend") * 150.0 - z("turn") * 250.0 - z("drift") * 400.0
    return g.select(key, "points", score.alias("score"))


def anomaly_kind(config: DetectionConfig):
    """The anomaly type of a detection (area, peak_sigma, integrated_sigma), or null."""
    deep = (F.col("area") >= config.anomaly_min_integrated_pixels) & (F.col("integrated_sigma") >= config.anomaly_min_integrated_sigma) & (F.col("peak_sigma") >= config.anomaly_min_peak_sigma_floor)
    return F.when(F.col("area") < config.anomaly_min_pixels, None).when(F.col("peak_sigma") >= config.anomaly_min_peak_sigma, "PEAK_SIGMA").when(deep, "INTEGRATED_SIGMA")


def best_lines(points: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Per key the pair whose line has most members (three at least), then the longest span, then the first ids."""
    one = points.select(key, F.col("det_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    two = points.select(key, F.col("det_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    pair = one.join(two, key).filter("a < b").withColumn("base", c.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).filter("base >= 1")
    on = pair.join(points.select(key, "x", "y"), key).filter(c.line_distance(*[F.col(k) for k in ("ax", "ay", "bx", "by", "x", "y")], F.col("base")) <= max(0.0, tolerance))
    along = (F.col("x") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("by") - F.col("ay"))
    g = on.groupBy(key, "a", "b").agg(F.count("*").alias("members"), F.min(F.struct(along.alias("t"), "x", "y")).alias("lo"), F.max(F.struct(along.alias("t"), "x", "y")).alias("hi"))
    g = g.filter("members >= 3").withColumn("span", c.distance(F.col("lo.x"), F.col("lo.y"), F.col("hi.x"), F.col("hi.y")))
    w = Window.partitionBy(key).orderBy(F.desc("members"), F.desc(F.round("span", 6)), "a", "b")
    return g.withColumn("k", F.row_number().over(w)).filter("k = 1").select(key, "a", "b", "members", "span")


def streak_samples(points: DataFrame, key: str) -> DataFrame:
    """(key, frame, x, y, ts_ms): frame means, and the least time among points that carry time and exposure, else -1."""
    timed = F.when((F.col("ts_ms") != -1) & (F.col("exposure_ms") > 0), F.col("ts_ms"))
    return points.groupBy(key, "frame").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.coalesce(F.min(timed), F.lit(-1)).cast("long").alias("ts_ms"))


def track_ends(points: DataFrame, key: str) -> DataFrame:
    """(key, x1, y1, x2, y2) of the first and last frame means, where they are a pixel apart."""
    s = streak_samples(points, key).groupBy(key).agg(F.min(F.struct("frame", "x", "y")).alias("a"), F.max(F.struct("frame", "x", "y")).alias("b"))
    s = s.select(key, F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))
    return s.filter(c.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) >= 1)


def shared_points(a: DataFrame, b: DataFrame) -> DataFrame:
    """a(t1, ids), b(t2, ids): tracks that share two points or more, found through the points."""
    left, right = a.select("t1", F.explode("ids").alias("id")), b.select("t2", F.explode("ids").alias("id"))
    return left.join(right, "id").filter("t1 < t2").groupBy("t1", "t2").agg(F.count_distinct("id").alias("shared")).filter("shared >= 2")
