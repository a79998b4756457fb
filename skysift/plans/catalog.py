"""Registered queries over the driver's tables, each with the SQL that says the same where SQL can.

Inputs are the derived pixel cube, detections and frame metrics of ``sources.derived``. Doubles are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import POLICIES, DetectionConfig
from ..functions import columns as c
from ..operators import background as bg
from ..operators import drift, linking, pairs, quality, reference, residual, sources, spatial, stacks, telemetry, tuner
from ..sources import derived as d
from ..sources.tables import materialize
from . import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BASE = DetectionConfig()
#: The cube's frames are small: lower thresholds find blobs in them.
SMALL = DetectionConfig(grow_sigma_multiplier=1.5, min_detection_pixels=2, edge_margin_pixels=2, void_proximity_radius=2, void_threshold_fraction=0.0, streak_min_elongation=3.0, streak_min_pixels=4)
SEED = 2.5


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(x: Column | str, name: str | None = None) -> Column:
    col = F.round(F.col(x) if isinstance(x, str) else x, 6)
    return col.alias(name or x)


# Scans, encoding, crops.


@query(f"WITH {d.CUBE} SELECT frame, y, x, CAST(v - 32768 AS SMALLINT) AS stored, v AS shifted FROM cube")
def pixel_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.pixel_cube(spark, sf_dir).withColumn("stored", c.encode(F.col("v")))
    return p.select("frame", "y", "x", "stored", c.decode(F.col("stored")).alias("shifted"))


@query("WITH e AS (SELECT DISTINCT CAST(epoch_ms(ts) // 86400000 AS BIGINT) AS day FROM events) SELECT day, CAST(row_number() OVER (ORDER BY day) - 1 AS INTEGER) AS frame_pos FROM e")
def frame_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = d.read(spark, sf_dir, "events").select(F.expr("unix_millis(cast(ts as timestamp)) div 86400000").alias("day")).distinct()
    return days.select("day", (F.row_number().over(Window.partitionBy(F.lit("s")).orderBy("day")) - 1).cast("int").alias("frame_pos"))


@query("SELECT vec_id, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(round(v * 1000) AS BIGINT) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE i <= 64")
def pixel_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.when(F.col("embedding").isNotNull() & (F.size("embedding") != 64), F.raise_error(F.lit("an embedding does not have 64 values, so it is no patch of 8 x 8"))).otherwise(F.col("embedding"))
    e = d.read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(whole).alias("i", "v"))
    return e.select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.round(F.col("v") * F.lit(1000).cast("float")).cast("long").alias("v"))  # of floats in float, as in the SQL


@query(f"WITH {d.CUBE} SELECT frame, CAST(y - 8 AS INTEGER) AS y, CAST(x - 10 AS INTEGER) AS x, v FROM cube WHERE y >= 8 AND y < 40 AND x >= 10 AND x < 42")
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.frames import crop as cut

    rows = cut(d.frame_rows(d.pixel_cube(spark, sf_dir)), 10, 8, 32, 32)
    return rows.select("frame", "y", F.posexplode("px").alias("x", "v"))


_SIZES = [(4096, 4096), (1500, 1300), (1000, 900), (800, 790), (500, 500), (1424, 1424), (1168, 2000), (7000, 1100)]


@query(
    f"""WITH s(w, h) AS (VALUES {', '.join(map(str, _SIZES))}),
u AS (SELECT w, h, least(w, h) - 400 AS u FROM s), z AS (SELECT w, h, CASE WHEN u >= 1024 THEN 1024 WHEN u >= 768 THEN 768 ELSE u END AS size FROM u),
g AS (SELECT * FROM z WHERE size >= 384)
SELECT w AS width, h AS height, 'upper-left' AS label, 200 AS x, 200 AS y, size FROM g
UNION ALL SELECT w, h, 'center', greatest(200, least(w - 200 - size, (w - size) // 2)), greatest(200, least(h - 200 - size, (h - size) // 2)), size FROM g
UNION ALL SELECT w, h, 'lower-right', w - 200 - size, h - 200 - size, size FROM g"""
)
def crop_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(w, h, label, x, y, size) for w, h in _SIZES for x, y, size, label in tuner.crop_regions(w, h)]
    return spark.createDataFrame(rows, "width int, height int, label string, x int, y int, size int")


# Background.

_CLIP = f"""{d.CUBE}, h AS (SELECT frame, v, count(*) AS n FROM cube GROUP BY frame, v), s0 AS (SELECT DISTINCT frame, 0::DOUBLE AS med, 0::DOUBLE AS sig, 0 AS lo, 65535 AS hi FROM h), """ + ", ".join(
    f"""a{i} AS (SELECT h.frame, v, n, lo, sum(n) OVER (PARTITION BY h.frame) AS tot, sum(n) OVER (PARTITION BY h.frame ORDER BY v) AS cum FROM h JOIN s{i} USING (frame) WHERE v BETWEEN lo AND hi),
m{i} AS (SELECT frame, tot, CASE WHEN tot // 2 = 0 THEN min(lo) ELSE min(v) FILTER (WHERE cum >= tot // 2) END::DOUBLE AS med FROM a{i} GROUP BY frame, tot),
v{i} AS (SELECT m.frame, m.med, sqrt(sum((v - m.med) * (v - m.med) * n) / any_value(m.tot)) AS sig FROM a{i} a JOIN m{i} m USING (frame) GROUP BY m.frame, m.med),
s{i + 1} AS (SELECT frame, med, sig, CAST(greatest(0, floor(med - 3.0::DOUBLE * sig)) AS INTEGER) AS lo, CAST(least(65535, ceil(med + 3.0::DOUBLE * sig)) AS INTEGER) AS hi FROM v{i})"""
    for i in range(3)
)


def _background(cube: DataFrame) -> DataFrame:
    return bg.clipped_background(bg.histogram(cube, ["frame"]), ["frame"])


@query(f"WITH {d.CUBE} SELECT frame, v, count(*) AS n FROM cube GROUP BY frame, v")
def bg_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bg.histogram(d.pixel_cube(spark, sf_dir), ["frame"])


@query(f"WITH {_CLIP} SELECT frame, med AS median, round(sig, 6) AS sigma FROM s3")
def bg_sigma_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _background(d.pixel_cube(spark, sf_dir)).select("frame", "median", r6("sigma"))


@query(f"WITH {_CLIP} SELECT frame, round(med + sig * 5.0, 6) AS seed, round(med + sig * 3.0, 6) AS grow, round(med * 0.5, 6) AS void FROM s3")
def bg_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bg.thresholds(_background(d.pixel_cube(spark, sf_dir)), 5.0, BASE).select("frame", r6("seed"), r6("grow"), r6("void"))


def _above(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    cube = d.pixel_cube(spark, sf_dir)
    return bg.above(cube, bg.thresholds(_background(cube), SEED, SMALL), ["frame"], which).select("frame", "y", "x", "v")


@query(f"WITH {_CLIP} SELECT frame, y, x, v FROM cube JOIN s3 USING (frame) WHERE v > med + sig * {SEED}")
def seed_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _above(spark, sf_dir, "seed")


@query(f"WITH {_CLIP} SELECT frame, y, x, v FROM cube JOIN s3 USING (frame) WHERE v > med + sig * 1.5")
def grow_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _above(spark, sf_dir, "grow")


# Drift.

_LEVEL = 40
_BOUNDS = f"""{d.CUBE}, ry AS (SELECT frame, y, count(*) FILTER (WHERE v > {_LEVEL}) AS ok FROM cube GROUP BY frame, y), rx AS (SELECT frame, x, count(*) FILTER (WHERE v > {_LEVEL}) AS ok FROM cube GROUP BY frame, x),
bounds AS (SELECT frame, min_y, max_y, min_x, max_x FROM
 (SELECT frame, coalesce(min(y) FILTER (WHERE ok > 3), 0) AS min_y, coalesce(max(y) FILTER (WHERE ok > 3), 63) AS max_y FROM ry GROUP BY frame) JOIN
 (SELECT frame, coalesce(min(x) FILTER (WHERE ok > 3), 0) AS min_x, coalesce(max(x) FILTER (WHERE ok > 3), 63) AS max_x FROM rx GROUP BY frame) USING (frame)),
drift AS (SELECT frame, CAST(min_x - (63 - max_x) AS INTEGER) AS dx, CAST(min_y - (63 - max_y) AS INTEGER) AS dy, CAST(greatest(min_x, 63 - max_x, min_y, 63 - max_y) AS INTEGER) AS padding FROM bounds)"""


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.valid_bounds(d.pixel_cube(spark, sf_dir), ["frame"], d.SIDE, d.SIDE, _LEVEL)


@query(f"WITH {_BOUNDS} SELECT * FROM bounds")
def drift_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holes(spark, sf_dir)


@query(f"WITH {_BOUNDS} SELECT * FROM drift")
def drift_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_vectors(_holes(spark, sf_dir), ["frame"], d.SIDE, d.SIDE)


@query(f"WITH {_BOUNDS} SELECT CAST(CASE WHEN max(padding) > 0 THEN greatest(5, max(padding) + 10) ELSE 5 END AS INTEGER) AS void_radius FROM drift")
def void_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.void_radius(drift_vectors(spark, sf_dir), 5)


# Stacks.

_STACK = f"{d.CUBE}, stk AS (SELECT y, x, s[3 + 1] AS median, s[5 + 1] AS slow, s[7] AS maximum, s[3 + 1] AS tuner_median FROM (SELECT y, x, list_sort(list(v)) AS s FROM cube GROUP BY y, x))"


@query(f"WITH {_STACK} SELECT * FROM stk")
def stack_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.stack_pixels(d.pixel_cube(spark, sf_dir), [])


@query(f"WITH {d.CUBE} SELECT y, x, s[3] AS median, s[5] AS slow, s[6] AS maximum, s[4] AS tuner_median FROM (SELECT y, x, list_sort(list(v)) AS s FROM cube WHERE frame < 6 GROUP BY y, x)")
def stack_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six frames: the conventions differ for even counts."""
    rows = d.frame_rows(d.pixel_cube(spark, sf_dir).filter("frame < 6")).withColumn("session_id", F.lit("s"))
    s = stacks.stack_rows(rows)
    z = s.select("y", F.posexplode(F.arrays_zip("median", "slow", "maximum", "tuner_median")).alias("x", "z"))
    return z.select("y", "x", "z.median", "z.slow", "z.maximum", "z.tuner_median")


# Components and shapes.

_BLOBS = f"""{_CLIP},
g AS (SELECT frame, y, x, v, v > med + sig * {SEED} AS seed, med, sig FROM cube JOIN s3 USING (frame) WHERE v > med + sig * 1.5),
reach(frame, y, x, ay, ax) AS (SELECT frame, y, x, y, x FROM g UNION SELECT r.frame, r.y, r.x, n.y, n.x FROM reach r JOIN g n ON n.frame = r.frame AND n.y BETWEEN r.ay - 1 AND r.ay + 1 AND n.x BETWEEN r.ax - 1 AND r.ax + 1),
label AS (SELECT frame, y, x, min(ay * 64 + ax) AS label FROM reach GROUP BY frame, y, x)"""
_MOMENTS = f"""{_BLOBS},
px AS (SELECT g.*, label, greatest(1.0::DOUBLE, CASE WHEN v - med <= 0 THEN 1.0 ELSE v - med END) AS w FROM g JOIN label USING (frame, y, x)),
one AS (SELECT frame, label, any_value(med) AS med, any_value(sig) AS sig, count(*) AS n, bool_or(seed) AS seeded, min(CASE WHEN seed THEN y * 64 + x END) AS first_seed, sum(w) AS flux, sum(x * w) / sum(w) AS cx, sum(y * w) / sum(w) AS cy, max(v) AS top FROM px GROUP BY frame, label),
two AS (SELECT o.*, m.xx, m.yy, m.xy, sqrt((m.xx - m.yy) * (m.xx - m.yy) + 4 * m.xy * m.xy) AS delta FROM one o JOIN (SELECT p.frame, p.label, sum((x - cx) * (x - cx) * w) / any_value(flux) AS xx, sum((y - cy) * (y - cy) * w) / any_value(flux) AS yy, sum((x - cx) * (y - cy) * w) / any_value(flux) AS xy
  FROM px p JOIN one o ON o.frame = p.frame AND o.label = p.label GROUP BY p.frame, p.label) m ON m.frame = o.frame AND m.label = o.label WHERE seeded AND n >= 2),
shp AS (SELECT *, greatest((xx + yy + delta) / 2, 0.001) AS l1, greatest((xx + yy - delta) / 2, 0.001) AS l2 FROM two),
src AS (SELECT frame, med, sig, first_seed, cx AS x, cy AS y, flux AS total_flux, (top - med) / sig AS peak_sigma, flux / (greatest(sig, 1e-6) * sqrt(n)) AS integrated_sigma, n AS pixel_area, 2.355 * sqrt(l1 + l2) AS fwhm, sqrt(l1 / l2) AS elongation,
  0.5 * atan2(2 * xy, xx - yy) AS angle, sqrt(l1 / l2) > 3.0 AND n >= 4 AS is_streak FROM shp),
inside AS (SELECT * FROM src WHERE is_streak OR (x >= 2 AND x < 62 AND y >= 2 AND y < 62)),
probes AS (SELECT s.frame, s.first_seed, bool_or(c.v IS NULL OR c.v <= s.med * 0.0) AS void FROM inside s, (VALUES (-2,-2),(-2,0),(-2,2),(0,-2),(0,2),(2,-2),(2,0),(2,2)) o(oy, ox) LEFT JOIN cube c ON c.frame = s.frame AND c.y = CAST(floor(s.y) AS INTEGER) + oy AND c.x = CAST(floor(s.x) AS INTEGER) + ox GROUP BY s.frame, s.first_seed),
fin AS (SELECT i.*, CAST(row_number() OVER (PARTITION BY i.frame ORDER BY i.first_seed) - 1 AS INTEGER) AS obj_ord FROM inside i JOIN probes p ON p.frame = i.frame AND p.first_seed = i.first_seed WHERE NOT p.void)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.frame_rows(d.pixel_cube(spark, sf_dir)).select(F.lit("s").alias("session_id"), F.col("frame").alias("seq_index"), "y", "px")


def _found(spark: SparkSession, sf_dir: str, config: DetectionConfig = SMALL) -> DataFrame:
    return sources.extract(_rows(spark, sf_dir), SEED, config.min_detection_pixels, config)


@query(
    f"WITH RECURSIVE {_MOMENTS} SELECT frame, obj_ord, round(x, 6) AS x, round(y, 6) AS y, round(total_flux, 6) AS total_flux, round(peak_sigma, 6) AS peak_sigma, round(integrated_sigma, 6) AS integrated_sigma, CAST(pixel_area AS DOUBLE) AS pixel_area, round(fwhm, 6) AS fwhm, round(elongation, 6) AS elongation, is_streak FROM fin"
)
def detect_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _found(spark, sf_dir)
    return s.select(F.col("seq_index").alias("frame"), "obj_ord", *[r6(k) for k in ("x", "y", "total_flux", "peak_sigma", "integrated_sigma")], "pixel_area", r6("fwhm"), r6("elongation"), "is_streak")


@query(f"WITH RECURSIVE {_BLOBS} SELECT frame, label, count(*) AS pixels FROM label GROUP BY frame, label")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts above the growth level, with or without a seed, from the labelling kernel."""
    import numpy as np
    import pyarrow as pa

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = table.sort_by("y")
        image = np.array(t.column("px").to_pylist(), np.int64)
        median, sigma = sources.clip_background(image, SMALL)
        level = median + 1.5 * sigma
        blobs = sources.label_components(image, level, level)
        return pa.table({"frame": pa.array([key[0].as_py()] * len(blobs), pa.int32()), "label": pa.array([int(b.min()) for b in blobs], pa.int32()), "pixels": pa.array([len(b) for b in blobs], pa.int64())})

    return d.frame_rows(d.pixel_cube(spark, sf_dir)).groupBy("frame").applyInArrow(run, "frame int, label int, pixels long")


@query(f"WITH RECURSIVE {_MOMENTS} SELECT frame, count(*) AS objects, count(*) FILTER (WHERE is_streak) AS streaks, any_value(med) AS median, round(any_value(sig), 6) AS sigma FROM fin GROUP BY frame")
def extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.extraction_stats(_found(spark, sf_dir).withColumnRenamed("seq_index", "frame"), ["frame"]).select("frame", "objects", "streaks", "median", r6("sigma"))


@query()
def shape_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumbbell and irregular-streak tests of every blob (kernels on footprints)."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = []
            for foot, x, y, angle in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                s = sources.Source(0, x, y, 0, 0, 0, float(len(foot)), 0, 0, angle, True, *(np.array([p[k] for p in foot], float) for k in "xyv"))
                rows.append((sources.is_binary_star_like(s), sources.is_irregular_streak(s)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.bool_())], names=["frame", "obj_ord", "dumbbell", "irregular"])

    s = _found(spark, sf_dir).select(F.col("seq_index").alias("frame"), "obj_ord", "footprint", "x", "y", "angle")
    return s.mapInArrow(run, "frame int, obj_ord int, dumbbell boolean, irregular boolean")


# Quality.

_KTH = "list_sort(list({0}))[len(list({0})) // 2 + 1]"
_STATS = (
    f"{d.METRICS}, md AS (SELECT "
    + ", ".join(f"list_sort(list({k}::DOUBLE) FILTER (WHERE {k} IS NOT NULL)) AS l_{k}" for k in ("stars", "fwhm", "ecc", "background", "bright_ecc"))
    + " FROM metrics), mm AS (SELECT *, "
    + ", ".join(f"l_{k}[len(l_{k}) // 2 + 1] AS {k}_med" for k in ("stars", "fwhm", "ecc", "background", "bright_ecc"))
    + " FROM md), ms AS (SELECT *, "
    + ", ".join(f"list_sort(list_transform(l_{k}, lambda q: abs(q - {k}_med)))[len(l_{k}) // 2 + 1] * 1.4826 AS {k}_raw" for k in ("stars", "fwhm", "ecc", "background", "bright_ecc"))
    + " FROM mm), st AS (SELECT "
    + ", ".join(f"{k}_med, CASE WHEN {k}_raw = 0 THEN 0.001 ELSE {k}_raw END AS {k}_sig, len(l_{k}) AS {k}_n" for k in ("stars", "fwhm", "ecc", "background", "bright_ecc"))
    + " FROM ms), lim AS (SELECT stars_med - 2.0 * stars_sig AS min_stars, greatest(fwhm_med + 2.5 * fwhm_sig, fwhm_med + 0.5) AS max_fwhm, greatest(ecc_med + 3.0 * ecc_sig, ecc_med + 0.1) AS max_ecc, "
    "CASE WHEN bright_ecc_n >= 3 THEN greatest(bright_ecc_med + 3.0 * bright_ecc_sig, bright_ecc_med + 0.1) END AS max_bright_ecc, background_med AS base_background, greatest(3.0 * background_sig, 10.0) AS max_background_off FROM st WHERE stars_n >= 3), "
    "rej AS (SELECT metrics.*, CASE WHEN stars < min_stars THEN 'Star Count dropped anomalously low' WHEN fwhm > max_fwhm THEN 'FWHM spiked (Blurry image)' WHEN ecc > max_ecc THEN 'Eccentricity spiked (Tracking error/Wind)' "
    "WHEN bright_ecc > max_bright_ecc THEN 'Bright-star eccentricity spiked (Tracking error/Wind)' WHEN abs(background - base_background) > max_background_off THEN 'Background deviation (Clouds/Light leak)' ELSE 'OK' END AS reason FROM metrics, lim)"
)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.frame_metrics(spark, sf_dir).withColumn("session_id", F.lit("s"))


def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    return quality.reject_frames(m, quality.session_thresholds(m, ["session_id"]), ["session_id"])


@query(f"WITH {_STATS} SELECT round(stars_med, 6) AS stars_med, round(stars_sig, 6) AS stars_sig, round(fwhm_med, 6) AS fwhm_med, round(fwhm_sig, 6) AS fwhm_sig, round(background_med, 6) AS background_med, round(background_sig, 6) AS background_sig FROM st")
def robust_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = quality.robust_stats(_metrics(spark, sf_dir), ["session_id"], ["stars", "fwhm", "background"])
    return s.select(*[r6(f"{k}_{e}") for k in ("stars", "fwhm", "background") for e in ("med", "sig")])


_LIMITS = ("min_stars", "max_fwhm", "max_ecc", "max_bright_ecc", "base_background", "max_background_off")


@query(f"WITH {_STATS} SELECT {', '.join(f'round({k}, 6) AS {k}' for k in _LIMITS)} FROM lim")
def session_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.session_thresholds(_metrics(spark, sf_dir), ["session_id"]).select(*[r6(k) for k in _LIMITS])


@query(f"WITH {_STATS} SELECT month, reason <> 'OK' AS is_rejected, reason FROM rej")
def reject_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rejected(spark, sf_dir).select("month", "is_rejected", "reason")


@query(f"WITH {_STATS} SELECT reason, count(*) AS frames FROM rej GROUP BY reason")
def rejection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.rejection_stats(_rejected(spark, sf_dir), ["session_id"]).select("reason", "frames")


@query(f"WITH {_STATS} SELECT month, CAST(row_number() OVER (ORDER BY month) - 1 AS INTEGER) AS frame_pos FROM rej WHERE reason = 'OK'")
def kept_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.kept_frames(_rejected(spark, sf_dir), ["session_id"], "month").select("month", F.col("frame_pos").cast("int").alias("frame_pos"))


_BRIGHT = "peak_sigma >= 8"


@query(
    f"""WITH {d.DETECTIONS}, f AS (SELECT DISTINCT frame FROM det), q AS (SELECT frame, count(*) AS stars, count(*) FILTER (WHERE NOT s) AS shape_stars, count(*) FILTER (WHERE NOT s AND {_BRIGHT}) AS bright_stars, count(*) FILTER (WHERE NOT s AND elongation < 1.5) AS fwhm_stars,
 median(fwhm) FILTER (WHERE NOT s AND elongation < 1.5) AS f, median(elongation) FILTER (WHERE NOT s) AS e, median(elongation) FILTER (WHERE NOT s AND {_BRIGHT}) AS b FROM (SELECT *, elongation > 3.5 AS s FROM det) GROUP BY frame)
SELECT frame, round(coalesce(f, 999.0), 6) AS fwhm, round(coalesce(e, 999.0), 6) AS ecc, round(CASE WHEN bright_stars >= 3 THEN b END, 6) AS bright_ecc, stars, shape_stars, bright_stars, fwhm_stars FROM q"""
)
def frame_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    obj = d.detections(spark, sf_dir).withColumn("is_streak", F.col("elongation") > 3.5)
    config = DetectionConfig(quality_sigma_multiplier=5.0, quality_bright_star_peak_sigma_offset=3.0, quality_bright_star_min_stars=3)
    back = obj.select("frame").distinct().withColumns({"median": F.lit(0.0), "sigma": F.lit(1.0)})
    q = quality.frame_quality(obj, back, ["frame"], config)
    return q.select("frame", r6("fwhm"), r6("ecc"), r6("bright_ecc"), "stars", "shape_stars", "bright_stars", "fwhm_stars")


# Masks and vetoes. The mask: stack pixels above 60, dilated; objects: 3 x 3 patches around hashed places.

_MASK = f"""{_STACK}, star AS (SELECT y, x FROM stk WHERE median > 60), disc AS (SELECT a.range AS dy, b.range AS dx FROM range(-2, 3) a, range(-2, 3) b WHERE a.range * a.range + b.range * b.range <= 4),
mask AS (SELECT DISTINCT CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x FROM star, disc WHERE y + dy BETWEEN 0 AND 63 AND x + dx BETWEEN 0 AND 63)"""
_PATCH = f"""{d.DETECTIONS}, place AS (SELECT session, frame, det_id, elongation, elongation > 3.5 AS is_streak, CAST(det_id * 7 % 66 - 1 AS INTEGER) AS cx, CAST(det_id * 13 % 66 - 1 AS INTEGER) AS cy FROM det),
foot AS (SELECT frame, det_id, CAST(cy + oy AS INTEGER) AS y, CAST(cx + ox AS INTEGER) AS x FROM place, (VALUES (-1), (0), (1)) a(oy), (VALUES (-1), (0), (1)) b(ox))"""
_OVER = f"{_MASK}, {_PATCH}, ov AS (SELECT f.det_id, count(m.y) / count(*)::DOUBLE AS overlap FROM foot f LEFT JOIN mask m ON m.y = f.y AND m.x = f.x GROUP BY f.det_id)"


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.dilated_mask(stack_all(spark, sf_dir).filter("median > 60"), [], 2, d.SIDE, d.SIDE)


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    cx, cy = (F.col("det_id") * 7 % 66 - 1).cast("int"), (F.col("det_id") * 13 % 66 - 1).cast("int")
    spots = F.array(*[F.struct((cx + i).alias("x"), (cy + j).alias("y"), F.lit(0).alias("v")) for j in (-1, 0, 1) for i in (-1, 0, 1)])
    return d.detections(spark, sf_dir).select(F.col("session").alias("session_id"), "frame", "det_id", "elongation", (F.col("elongation") > 3.5).alias("is_streak"), spots.alias("footprint"))


def _overlaps(spark: SparkSession, sf_dir: str, bounds: tuple[int, int] | None = None) -> DataFrame:
    return reference.overlap(reference.footprint_pixels(_patches(spark, sf_dir), ["det_id"]), _mask(spark, sf_dir), ["det_id"], [], bounds)


_VETO = DetectionConfig(max_mask_overlap_fraction=0.25)


def _vetoed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.veto(_patches(spark, sf_dir), _overlaps(spark, sf_dir), ["det_id"], _VETO)


@query(f"WITH {_MASK} SELECT y, x FROM mask")
def mask_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mask(spark, sf_dir)


@query(f"WITH {_OVER} SELECT det_id, round(overlap, 6) AS overlap FROM ov")
def mask_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).select("det_id", r6("overlap"))


@query(f"WITH {_OVER} SELECT f.det_id, round(count(m.y) / count(*)::DOUBLE, 6) AS overlap FROM foot f LEFT JOIN mask m ON m.y = f.y AND m.x = f.x WHERE f.x BETWEEN 0 AND 63 AND f.y BETWEEN 0 AND 63 GROUP BY f.det_id")
def mask_overlap_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tuner's variant: only pixels on the sensor count."""
    return _overlaps(spark, sf_dir, (d.SIDE, d.SIDE)).select("det_id", r6("overlap"))


@query(f"WITH {_OVER} SELECT frame, det_id, is_streak FROM place JOIN ov USING (det_id) WHERE NOT overlap > 0.25")
def veto_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point and streak veto, and the union of what survives."""
    v = _vetoed(spark, sf_dir).filter(~F.col("is_purged"))
    return v.filter(~F.col("is_streak")).unionByName(v.filter("is_streak")).select("frame", "det_id", "is_streak")


@query(f"WITH {_OVER} SELECT frame, count(*) AS initial, count(*) FILTER (WHERE overlap <= 0.25) AS surviving, count(*) FILTER (WHERE overlap > 0.25) AS purged FROM place JOIN ov USING (det_id) WHERE NOT is_streak GROUP BY frame")
def star_map_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.star_map(_vetoed(spark, sf_dir), ["frame"])


@query(f"WITH {d.DETECTIONS} SELECT frame, det_id FROM det WHERE det_id % 5 <> 0 AND NOT (area >= 15 AND (peak_sigma >= 8 OR (area >= 25 AND integrated_sigma >= 12 AND peak_sigma >= 3)))")
def unclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections that neither a track (every fifth id here) nor an anomaly has."""
    det = d.detections(spark, sf_dir)
    in_tracks = det.filter("det_id % 5 = 0").select("det_id")
    left = det.join(in_tracks, "det_id", "left_anti")
    odd = left.withColumn("type", pairs.anomaly_kind(BASE)).filter("type is not null").select("det_id")
    return left.join(odd, "det_id", "left_anti").select("frame", "det_id")


# Slow movers.

_SLOW = f"""{_OVER}, e AS (SELECT session, list_sort(list(elongation)) AS l FROM place GROUP BY session), e2 AS (SELECT session, l, l[len(l) // 2 + 1] AS med FROM e), e3 AS (SELECT session, len(l) AS n, med, greatest(0.1, list_sort(list_transform(l, lambda q: abs(q - med)))[len(l) // 2 + 1]) AS mad FROM e2),
thr AS (SELECT session, n, med, mad, CASE WHEN n >= 10 THEN med + mad * 0.5 ELSE 3.0 END AS threshold FROM e3),
rf AS (SELECT det_id, sum(greatest(slow - median, 0)) AS residual, sum(slow) AS slow_flux, sum(median) AS median_flux, count(*) AS pixels FROM foot JOIN stk USING (y, x) GROUP BY det_id),
fr AS (SELECT *, CASE WHEN slow_flux > 0 THEN residual / slow_flux::DOUBLE ELSE 0.0 END AS fraction FROM rf),
ver AS (SELECT p.session, p.det_id, overlap, fraction, CASE WHEN elongation < threshold THEN 'elongation' WHEN overlap < 0.1 THEN 'low_support' WHEN overlap > 0.65 THEN 'high_support' WHEN coalesce(fraction, 0.0) < 0.3 THEN 'residual' ELSE 'accepted' END AS verdict FROM place p JOIN ov USING (det_id) LEFT JOIN fr USING (det_id) JOIN thr ON thr.session = p.session)"""
_SLOW_CONFIG = DetectionConfig(slow_mover_baseline_mad_multiplier=0.5, slow_mover_median_support_overlap_fraction=0.1, slow_mover_residual_footprint_min_flux_fraction=0.3)


def _flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.residual_flux(reference.footprint_pixels(_patches(spark, sf_dir), ["det_id"]), stack_all(spark, sf_dir), ["det_id"], [])


def _limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.elongation_limit(_patches(spark, sf_dir), ["session_id"], _SLOW_CONFIG)


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _patches(spark, sf_dir).join(_overlaps(spark, sf_dir), "det_id").join(_flux(spark, sf_dir), "det_id", "left")
    return reference.slow_mover_verdicts(rows, _limit(spark, sf_dir), ["session_id"], _SLOW_CONFIG)


@query(f"WITH {_SLOW} SELECT session AS session_id, CAST(n AS INTEGER) AS n, round(med, 6) AS med, round(mad, 6) AS mad, round(threshold, 6) AS threshold FROM thr")
def slow_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _limit(spark, sf_dir).select("session_id", "n", r6("med"), r6("mad"), r6("threshold"))


@query(f"WITH {_SLOW} SELECT det_id, CAST(residual AS BIGINT) AS residual, CAST(slow_flux AS BIGINT) AS slow_flux, CAST(median_flux AS BIGINT) AS median_flux, pixels, round(fraction, 6) AS fraction FROM fr")
def residual_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flux(spark, sf_dir).select("det_id", "residual", "slow_flux", "median_flux", "pixels", r6("fraction"))


@query(f"WITH {_SLOW} SELECT det_id, verdict FROM ver")
def slow_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("det_id", "verdict")


@query(
    f"""WITH {_SLOW} SELECT session AS session_id, count(*) AS raw, count(*) FILTER (WHERE verdict <> 'elongation') AS evaluated, count(*) FILTER (WHERE verdict = 'low_support') AS low_support, count(*) FILTER (WHERE verdict = 'high_support') AS high_support,
count(*) FILTER (WHERE verdict = 'residual') AS low_residual, count(*) FILTER (WHERE verdict = 'accepted') AS accepted, round(coalesce(avg(overlap) FILTER (WHERE verdict <> 'elongation'), 0), 6) AS mean_overlap, round(coalesce(avg(fraction) FILTER (WHERE verdict = 'accepted'), 0), 6) AS mean_fraction FROM ver GROUP BY session"""
)
def slow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reference.slow_mover_summary(_verdicts(spark, sf_dir), ["session_id"])
    return s.withColumns({k: F.round(k, 6) for k in ("mean_overlap", "mean_fraction")})


# Pairs, triples, scores.

_LINK = DetectionConfig(max_jump_pixels=60.0)
_PAIRS = f"""{d.DETECTIONS}, pr AS (SELECT a.frame AS frame1, b.frame AS frame2, a.det_id AS det_id1, b.det_id AS det_id2, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, CAST(b.ts_ms - a.ts_ms AS DOUBLE) AS dt, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS dist,
 greatest(a.fwhm, b.fwhm) <= 2 * least(a.fwhm, b.fwhm) AND greatest(a.flux / a.area, b.flux / b.area) / least(a.flux / a.area, b.flux / b.area) <= 2 AS alike, a.exposure_ms AS e1, a.area AS area1 FROM det a JOIN det b ON b.session = a.session AND b.frame > a.frame),
coded AS (SELECT *, CASE WHEN dt <= 0 THEN 'dt' WHEN dist < 1.5 THEN 'jitter' WHEN NOT alike THEN 'profile' WHEN e1 > 0 AND dist > ((sqrt(area1) + 1.5) / e1) * dt * 1.5 + 1.5 THEN 'exposure' ELSE 'ok' END AS code FROM pr)"""


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.baseline_codes(d.detections(spark, sf_dir), _LINK)


@query(f"WITH {_PAIRS} SELECT det_id1, det_id2, round(dt, 6) AS dt, round(dist, 6) AS dist FROM coded WHERE code = 'ok'")
def baseline_pairs_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).filter("code = 'ok'").select("det_id1", "det_id2", r6("dt"), r6("dist"))


@query(f"WITH {_PAIRS} SELECT code, count(*) AS pairs FROM coded GROUP BY code")
def baseline_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.reject_counts(_codes(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT det_id1, det_id2, round(dist, 6) AS dist FROM coded WHERE frame2 <= frame1 + 2 AND dist >= 1.5 AND dist <= 60 AND code <> 'profile'")
def baseline_pairs_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.close_pairs(d.detections(spark, sf_dir), _LINK, 2).select("det_id1", "det_id2", r6("dist"))


_TRIPLES = f"""{_PAIRS}, cl AS (SELECT * FROM coded WHERE frame2 = frame1 + 1 AND dist >= 1.5 AND dist <= 60 AND code <> 'profile'),
t0 AS (SELECT a.det_id1, a.det_id2, b.det_id2 AS det_id3, a.dist AS d12, b.dist AS d23, a.dt AS dt12, b.dt AS dt23, abs((a.x2 - a.x1) * (a.y1 - b.y2) - (a.x1 - b.x2) * (a.y2 - a.y1)) / a.dist AS line_error,
 abs(atan2(a.y2 - a.y1, a.x2 - a.x1) - atan2(b.y2 - b.y1, b.x2 - b.x1)) AS turn0 FROM cl a JOIN cl b ON b.det_id1 = a.det_id2 AND b.frame1 = a.frame2),
tri AS (SELECT * FROM t0 WHERE line_error <= 3.0 AND CASE WHEN turn0 > pi() THEN 2 * pi() - turn0 ELSE turn0 END <= radians(45))"""


@query(f"WITH {_TRIPLES} SELECT det_id1, det_id2, det_id3, round(line_error, 6) AS line_error FROM tri")
def collinear_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.collinear_triples(d.detections(spark, sf_dir), _LINK, 60.0).select("det_id1", "det_id2", "det_id3", r6("line_error"))


_LOOSE = DetectionConfig(max_jump_pixels=60.0, time_based_velocity_tolerance=1.0)


@query(
    f"""WITH {_TRIPLES}, v AS (SELECT *, d12 / dt12 AS v12, abs(d23 / dt23 - d12 / dt12) AS off FROM tri WHERE dt12 > 0 AND dt23 > 0)
SELECT det_id1, det_id2, det_id3 FROM (SELECT *, row_number() OVER (PARTITION BY det_id1, det_id2 ORDER BY off, det_id3) AS k FROM v WHERE off <= v12 * 1.0 + 1.5 / dt23) WHERE k = 1"""
)
def velocity_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.velocity_matches(pairs.collinear_triples(d.detections(spark, sf_dir), _LOOSE, 60.0), _LOOSE).select("det_id1", "det_id2", "det_id3")


#: Given tracks for scoring: a session's detections by id modulo 40.
_TRACKS = f"{d.DETECTIONS}, tr AS (SELECT session * 40 + det_id % 40 AS t, * FROM det)"


def _given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.detections(spark, sf_dir).withColumn("t", F.col("session") * 40 + F.col("det_id") % 40)


_RHYTHM = DetectionConfig(rhythm_allowed_variance=60.0)


@query(
    f"""WITH {_TRACKS}, j AS (SELECT t, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS jump FROM tr WINDOW w AS (PARTITION BY t ORDER BY det_id)),
g AS (SELECT t, count(*) AS n, list_sort(list(jump) FILTER (WHERE jump IS NOT NULL)) AS js FROM j GROUP BY t), h AS (SELECT *, js[len(js) // 2 + 1] AS typical FROM g),
k AS (SELECT *, CASE WHEN n < 3 OR typical < 0.5 OR typical = 0 THEN 0 ELSE len(list_filter(js, lambda v: floor(v / typical + 0.5) > 0 AND abs(v - floor(v / typical + 0.5) * typical) <= floor(v / typical + 0.5) * 60.0)) END AS consistent FROM h)
SELECT t, CAST(coalesce(len(js), 0) AS INTEGER) AS jumps, round(typical, 6) AS typical, CAST(consistent AS INTEGER) AS consistent, CASE WHEN n < 3 THEN true WHEN typical < 0.5 OR typical = 0 THEN false ELSE consistent / len(js)::DOUBLE >= 0.7 END AS steady FROM k"""
)
def steady_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.rhythm(_given(spark, sf_dir), "t", "det_id", _RHYTHM).select("t", "jumps", r6("typical"), "consistent", "steady")


_DELTA = "CASE WHEN {1}.ts_ms > {0}.ts_ms THEN CAST({1}.ts_ms - {0}.ts_ms AS DOUBLE) ELSE CAST(greatest(1, {1}.frame - {0}.frame) AS DOUBLE) END"


@query(
    f"""WITH {_TRACKS}, o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY frame, det_id) AS k, count(*) OVER (PARTITION BY t) AS n FROM tr),
e AS (SELECT a.t, a.n, greatest(1, b.frame - a.frame) AS span, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS total, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, {_DELTA.format('a', 'b')} AS delta FROM o a JOIN o b ON a.t = b.t AND a.k = 1 AND b.k = b.n),
s AS (SELECT q.t, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) / ({_DELTA.format('p', 'q')}) AS sp, atan2(q.y - p.y, q.x - p.x) AS ang FROM o p JOIN o q ON p.t = q.t AND q.k = p.k + 1),
ln AS (SELECT o.t, avg(abs((bx - ax) * (ay - y) - (ax - x) * (by_ - ay)) / greatest(total, 1e-4)) AS bend FROM o JOIN e USING (t) WHERE o.k > 1 AND o.k < o.n GROUP BY o.t),
sg AS (SELECT s.t, avg(CASE WHEN abs(atan2(by_ - ay, bx - ax) - ang) > pi() THEN 2 * pi() - abs(atan2(by_ - ay, bx - ax) - ang) ELSE abs(atan2(by_ - ay, bx - ax) - ang) END) AS turn,
  avg(CASE WHEN total > 0 THEN abs(sp - total / greatest(delta, 1e-4)) / (total / greatest(delta, 1e-4)) ELSE 0 END) AS drift FROM s JOIN e USING (t) GROUP BY s.t)
SELECT e.t, e.n AS points, round(n * 1000.0 + n / (span + 1.0::DOUBLE) * 250.0 + span * 50.0 + total * 5.0 - coalesce(bend, 0) * 150.0 - coalesce(turn, 0) * 250.0 - coalesce(drift, 0) * 400.0, 4) AS score FROM e LEFT JOIN ln USING (t) LEFT JOIN sg USING (t)"""
)
def track_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.track_scores(_given(spark, sf_dir), "t").select("t", "points", F.round("score", 4).alias("score"))


@query(f"WITH {_TRACKS} SELECT t, frame, round(avg(x), 6) AS x, round(avg(y), 6) AS y, coalesce(min(ts_ms) FILTER (WHERE ts_ms <> -1 AND exposure_ms > 0), -1) AS ts_ms FROM tr GROUP BY t, frame")
def streak_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.streak_samples(_given(spark, sf_dir), "t").select("t", "frame", r6("x"), r6("y"), "ts_ms")


@query(f"WITH {_TRACKS}, s AS (SELECT t, frame, avg(x) AS x, avg(y) AS y FROM tr GROUP BY t, frame), e AS (SELECT t, arg_min(x, frame) AS x1, arg_min(y, frame) AS y1, arg_max(x, frame) AS x2, arg_max(y, frame) AS y2 FROM s GROUP BY t) SELECT t, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM e WHERE sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) >= 1")
def line_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.track_ends(_given(spark, sf_dir), "t").select("t", *[r6(k) for k in ("x1", "y1", "x2", "y2")])


@query(f"WITH {d.DETECTIONS}, a AS (SELECT session * 200 + det_id % 9 AS t, det_id FROM det UNION SELECT session * 200 + 100 + det_id % 11, det_id FROM det) SELECT p.t AS t1, q.t AS t2, count(DISTINCT p.det_id) AS shared FROM a p JOIN a q ON p.det_id = q.det_id AND p.t < q.t GROUP BY 1, 2 HAVING count(DISTINCT p.det_id) >= 2")
def duplicate_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = d.detections(spark, sf_dir)
    t = det.groupBy((F.col("session") * 200 + F.col("det_id") % 9).alias("t")).agg(F.collect_list("det_id").alias("ids")).unionByName(det.groupBy((F.col("session") * 200 + F.col("det_id") % 11 + 100).alias("t")).agg(F.collect_list("det_id").alias("ids")))
    return pairs.shared_points(t.withColumnRenamed("t", "t1"), t.withColumnRenamed("t", "t2"))


@query(f"WITH {d.DETECTIONS}, f AS (SELECT session, count(DISTINCT frame) AS frames, bool_and(ts_ms <> -1) AS timed FROM det WHERE (frame, det_id) IN (SELECT (frame, min(det_id)) FROM det GROUP BY frame) GROUP BY session) SELECT session, frames, timed, CAST(least(5, greatest(3, ceil(frames / 3.0))) AS INTEGER) AS min_points FROM f")
def timestamp_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, whether each frame's first detection carries a time, and the points that a track needs."""
    first = d.detections(spark, sf_dir).groupBy("session", "frame").agg(F.min(F.struct("det_id", "ts_ms")).alias("f"))
    g = first.groupBy("session").agg(F.count("*").alias("frames"), F.bool_and(F.col("f.ts_ms") != -1).alias("timed"))
    return g.select("session", "frames", "timed", F.least(F.lit(BASE.absolute_max_points_required), F.greatest(F.lit(3), F.ceil(F.col("frames") / BASE.track_min_frame_ratio))).cast("int").alias("min_points"))


@query(f"WITH {d.DETECTIONS} SELECT det_id, area < 15 AS small, CASE WHEN area < 15 THEN NULL WHEN peak_sigma >= 8 THEN 'PEAK_SIGMA' WHEN area >= 25 AND integrated_sigma >= 12 AND peak_sigma >= 3 THEN 'INTEGRATED_SIGMA' END AS type FROM det")
def anomaly_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.detections(spark, sf_dir).select("det_id", (F.col("area") < 15).alias("small"), pairs.anomaly_kind(BASE).alias("type"))


@query(
    f"""WITH {d.DETECTIONS}, p AS (SELECT a.frame, a.det_id AS a, b.det_id AS b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS base FROM det a JOIN det b ON a.frame = b.frame AND a.det_id < b.det_id),
m AS (SELECT p.*, d.x, d.y, (d.x - ax) * (bx - ax) + (d.y - ay) * (by_ - ay) AS along FROM p JOIN det d USING (frame) WHERE base >= 1 AND abs((bx - ax) * (ay - d.y) - (ax - d.x) * (by_ - ay)) / base <= 6.0),
g AS (SELECT frame, a, b, count(*) AS members, min({{'t': along, 'x': x, 'y': y}}) AS lo, max({{'t': along, 'x': x, 'y': y}}) AS hi FROM m GROUP BY frame, a, b HAVING count(*) >= 3),
s AS (SELECT *, sqrt((hi.x - lo.x) * (hi.x - lo.x) + (hi.y - lo.y) * (hi.y - lo.y)) AS span FROM g)
SELECT frame, a, b, members, round(span, 4) AS span FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY members DESC, round(span, 6) DESC, a, b) AS k FROM s) WHERE k = 1"""
)
def best_line_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.best_lines(d.detections(spark, sf_dir), "frame", BASE.suspected_streak_line_tolerance).withColumn("span", F.round("span", 4))


# Residuals. Groups: a session's detections by id modulo 60 with places folded into a small field.

_GROUPS = f"""{d.DETECTIONS}, gp AS (SELECT session * 60 + det_id % 60 AS g, frame, x % 7 AS x, floor(y) % 7 AS y, greatest(peak_sigma, integrated_sigma) AS signal FROM det),
o AS (SELECT *, frame::DOUBLE AS tt, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(frame) OVER w AS pf FROM gp WINDOW w AS (PARTITION BY g ORDER BY frame, x, y)),
f AS (SELECT g, count(*) AS n, sum(tt) AS st, sum(tt * tt) AS stt, sum(x) AS sx, sum(y) AS sy, sum(tt * x) AS stx, sum(tt * y) AS sty FROM o GROUP BY g),
l AS (SELECT *, CASE WHEN abs(n * stt - st * st) < 1e-9 THEN 0 ELSE (n * stx - st * sx) / (n * stt - st * st) END AS kx, CASE WHEN abs(n * stt - st * st) < 1e-9 THEN 0 ELSE (n * sty - st * sy) / (n * stt - st * st) END AS ky FROM f),
r AS (SELECT o.*, n, x - (kx * tt + (sx - kx * st) / n) AS rx, y - (ky * tt + (sy - ky * st) / n) AS ry, sqrt((x - sx / n) * (x - sx / n) + (y - sy / n) * (y - sy / n)) AS far FROM o JOIN l USING (g)),
me0 AS (SELECT g, count(*) AS points, count(DISTINCT frame) AS frames, min({{'f': frame, 'x': x, 'y': y}}) AS a, max({{'f': frame, 'x': x, 'y': y}}) AS b, coalesce(sum(greatest(frame - pf - 1, 0)), 0) AS gaps, coalesce(avg(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0) AS mean_step,
 coalesce(max(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0) AS max_step, CASE WHEN count(*) < 2 THEN 0 ELSE sqrt(avg(rx * rx + ry * ry)) END AS rmse, max(far) AS radius, avg(signal) AS signal FROM r GROUP BY g),
me AS (SELECT *, b.f - a.f + 1 AS span, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS move, points / (b.f - a.f + 1)::DOUBLE AS coverage FROM me0),
kd AS (SELECT *, CASE WHEN points >= 4 AND move >= 1.25 AND move <= 32 AND coverage >= 0.55 AND rmse <= 1.8 AND max_step <= 9.25 THEN 'MICRO_DRIFT'
 WHEN points >= 4 AND move >= 2 AND move <= 10 AND radius <= 4.5 AND mean_step <= 2.75 AND rmse <= 0.45 AND coverage >= 0.25 AND signal >= 5 AND max_step <= 3.5 AND span <= points * 4 THEN 'SPARSE_LOCAL_DRIFT'
 WHEN points >= 2 AND move <= 3 AND radius <= 2.5 AND mean_step <= 1.75 AND rmse <= 0.9 AND coverage >= 0.4 AND signal >= 5 AND max_step <= 3 AND (points <= 3 OR move >= 0.35) AND span <= points + 2 THEN 'LOCAL_REPEAT' END AS kind FROM me)"""


def _groups(spark: SparkSession, sf_dir: str, fold: int = 60) -> DataFrame:
    det = d.detections(spark, sf_dir)
    pts = det.select((F.col("session") * fold + F.col("det_id") % fold).alias("g"), "frame", (F.col("x") % 7).alias("x"), (F.floor("y") % 7).cast("double").alias("y"), F.greatest("peak_sigma", "integrated_sigma").alias("signal"))
    return residual.group_metrics(pts, ["g"])


@query(f"WITH {_GROUPS} SELECT g, points, frames, CAST(span AS INTEGER) AS span, CAST(gaps AS BIGINT) AS gaps, round(move, 6) AS move, round(mean_step, 6) AS mean_step, round(max_step, 6) AS max_step, round(rmse, 5) AS rmse, round(radius, 6) AS radius, round(signal, 6) AS signal, round(coverage, 6) AS coverage FROM me")
def residual_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _groups(spark, sf_dir)
    return m.select("g", "points", "frames", F.col("span").cast("int").alias("span"), F.col("gaps").cast("long").alias("gaps"), r6("move"), r6("mean_step"), r6("max_step"), F.round("rmse", 5).alias("rmse"), r6("radius"), r6("signal"), r6("coverage"))


_PAIRED = _GROUPS.replace("session * 60 + det_id % 60 AS g", "frame // 3 * 100 + det_id % 6 AS g")


@query(f"WITH {_PAIRED} SELECT g, kind, round(CASE WHEN kind IS NOT NULL THEN points * 100.0 + least(signal * points, 300.0) * 0.25 - rmse * 25.0 - gaps * 10.0 - mean_step * 3.0 + least(move, 12.0) - CASE kind WHEN 'LOCAL_REPEAT' THEN 35.0 WHEN 'SPARSE_LOCAL_DRIFT' THEN 20.0 ELSE 0.0 END END, 4) AS score FROM kd")
def rescue_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = d.detections(spark, sf_dir)
    pts = det.select((F.expr("frame div 3") * 100 + F.col("det_id") % 6).cast("long").alias("g"), "frame", (F.col("x") % 7).alias("x"), (F.floor("y") % 7).cast("double").alias("y"), F.greatest("peak_sigma", "integrated_sigma").alias("signal"))
    m = residual.group_metrics(pts, ["g"]).withColumn("kind", residual.kind_column())
    return m.select("g", "kind", F.round(F.when(F.col("kind").isNotNull(), residual.score_column()), 4).alias("score"))


@query(
    f"""WITH RECURSIVE {d.DETECTIONS}, n AS (SELECT session, det_id, x * 0.8 AS x, y * 0.8 AS y FROM det), e AS (SELECT a.det_id AS a, b.det_id AS b FROM n a JOIN n b ON a.session = b.session AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 4.0),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b) SELECT a AS det_id, min(b) AS cluster FROM reach GROUP BY a"""
)
def proximity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = table.sort_by("det_id")
        ids = t.column("det_id").to_numpy()
        groups = residual.proximity_clusters(t.column("x").to_numpy() * 0.8, t.column("y").to_numpy() * 0.8, residual.LIMITS["link_radius"])
        rows = np.concatenate(groups)
        return pa.table({"det_id": ids[rows], "cluster": np.concatenate([np.full(len(g), ids[g].min()) for g in groups])})

    return d.detections(spark, sf_dir).select("session", "det_id", "x", "y").groupBy("session").applyInArrow(run, "det_id long, cluster long")


@query(f"WITH {d.DETECTIONS} SELECT frame, det_id FROM det a WHERE det_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM det b WHERE b.det_id % 3 = 0 AND b.frame = a.frame AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 25.0)")
def exclude_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = d.detections(spark, sf_dir)
    return residual.exclude_near(det.filter("det_id % 3 <> 0"), det.filter("det_id % 3 = 0"), 25.0).select("frame", "det_id")


# Spatial queries: detections of even ids ask, odd ones answer.

_SPACE = f"{d.DETECTIONS}, q AS (SELECT det_id AS q_id, x AS qx, y AS qy FROM det WHERE det_id % 2 = 0), p AS (SELECT det_id AS p_id, x, y FROM det WHERE det_id % 2 = 1), near AS (SELECT q_id, p_id, sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)) AS dist FROM q, p WHERE sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)) <= 30.0)"


def _space(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    det = d.detections(spark, sf_dir)
    return det.filter("det_id % 2 = 0").select(F.col("det_id").alias("q_id"), F.col("x").alias("qx"), F.col("y").alias("qy")), det.filter("det_id % 2 = 1").select(F.col("det_id").alias("p_id"), "x", "y")


@query(f"WITH {_SPACE} SELECT q_id, p_id, round(dist, 6) AS dist FROM near")
def radius_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.radius_search(*_space(spark, sf_dir), 30.0).select("q_id", "p_id", r6("dist"))


@query(f"WITH {_SPACE} SELECT q_id, q_id IN (SELECT q_id FROM near) AS found FROM q")
def exists_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.exists_within(*_space(spark, sf_dir), 30.0)


@query(f"WITH {_SPACE} SELECT q_id, p_id, round(dist, 6) AS dist, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, p_id) AS k FROM near) WHERE k <= 3")
def k_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.k_nearest(*_space(spark, sf_dir), 30.0, 3).select("q_id", "p_id", r6("dist"), "rank")


@query(f"WITH {_SPACE} SELECT q.q_id, round(coalesce(min(dist), -1.0), 6) AS dist FROM q LEFT JOIN near ON near.q_id = q.q_id GROUP BY q.q_id")
def nearest_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest_distance(*_space(spark, sf_dir), 30.0).select("q_id", r6("dist"))


@query(f"WITH {_SPACE} SELECT CAST(floor(x / 8.0) AS BIGINT) AS cell_x, CAST(floor(y / 8.0) AS BIGINT) AS cell_y, count(*) AS points FROM p GROUP BY 1, 2")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.with_cell(_space(spark, sf_dir)[1], 8.0).groupBy("cell_x", "cell_y").agg(F.count("*").alias("points"))


# Tuner.


@query(f"WITH {d.METRICS}, s AS (SELECT month, round(noise * fwhm, 6) AS score, row_number() OVER (ORDER BY noise * fwhm, month) - 1 AS k, count(*) OVER () AS n FROM metrics) SELECT month, score FROM s WHERE k < 3 OR k = n // 2 - 1 OR k = n // 2")
def sample_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = d.frame_metrics(spark, sf_dir)
    return tuner.sample_frames(m, "month", m.count()).select("month", r6("score"))


_MATCH = f"""{d.DETECTIONS}, s AS (SELECT det_id AS s_id, x AS sx, y AS sy FROM det WHERE frame % {d.DAYS} = 0), o AS (SELECT frame, det_id AS o_id, x, y FROM det WHERE frame % {d.DAYS} > 0),
n AS (SELECT frame, o_id, s_id, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS dist FROM o, s WHERE sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) <= 40),
mt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, o_id ORDER BY dist, s_id) AS a, row_number() OVER (PARTITION BY frame, s_id ORDER BY dist, o_id) AS b FROM n) WHERE a = 1 AND b = 1)"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = d.detections(spark, sf_dir)
    return tuner.reciprocal_matches(det.filter(F.col("frame") % d.DAYS == 0).select(F.col("det_id").alias("s_id"), F.col("x").alias("sx"), F.col("y").alias("sy")), det.filter(F.col("frame") % d.DAYS > 0).select("frame", F.col("det_id").alias("o_id"), "x", "y"), 40.0)


@query(f"WITH {_MATCH} SELECT frame, o_id, s_id, round(dist, 6) AS dist FROM mt")
def reciprocal_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("frame", "o_id", "s_id", r6("dist"))


@query(f"WITH {_MATCH}, l AS (SELECT frame // {d.DAYS} AS session, list_sort(list(dist)) AS l FROM mt GROUP BY 1) SELECT CAST(session AS BIGINT) AS session, CAST(len(l) AS INTEGER) AS matches, round(CASE WHEN len(l) < 8 THEN 1.5 ELSE greatest(1.0, 2.0 * l[CAST(floor(0.9 * (len(l) - 1) + 0.5) AS INTEGER) + 1]) END, 6) AS jitter FROM l")
def jitter_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _matches(spark, sf_dir).withColumn("session", F.expr(f"frame div {d.DAYS}"))
    return tuner.jitter_from(found, keys=("session",)).select("session", "matches", r6("jitter"))


_GRID = """g AS (SELECT CAST(row_number() OVER (ORDER BY p, s, gd, o) - 1 AS INTEGER) AS ord, p AS min_pix, s AS sigma, gd AS grow_delta, o AS overlap, greatest(1.0, s - gd, 2.75)::DOUBLE AS grow
 FROM (VALUES (3), (5), (7), (9), (12)) a(p), (VALUES (3.5::DOUBLE), (4.0), (5.0), (6.0), (7.0)) b(s), (VALUES (0.75::DOUBLE), (1.25), (1.75)) c(gd), (VALUES (0.65::DOUBLE), (0.70), (0.75)) e(o)), grid AS (SELECT * FROM g WHERE grow < sigma)"""


@query(f"WITH {_GRID} SELECT * FROM grid")
def tuner_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuner.grid(spark)


#: Made-up measurements for scoring: simple functions of a point's place.
_FAKE = f"{_GRID}, fk AS (SELECT *, (ord * 7 % 150)::DOUBLE AS stable_avg, (ord % 13) / 100.0::DOUBLE AS ratio, (ord % 29) / 20.0::DOUBLE AS transient_avg, (ord % 11) / 30.0::DOUBLE AS stable_cv, (ord % 17) / 16.0::DOUBLE AS transient_cv, (ord % 19) / 80.0::DOUBLE AS coverage FROM grid)"


def _fake(spark: SparkSession) -> DataFrame:
    o = F.col("ord")
    return tuner.grid(spark).withColumns({"stable_avg": (o * 7 % 150).cast("double"), "ratio": (o % 13) / 100.0, "transient_avg": (o % 29) / 20.0, "stable_cv": (o % 11) / 30.0, "transient_cv": (o % 17) / 16.0, "coverage": (o % 19) / 80.0})


def _score_sql(name: str) -> str:
    p = POLICIES[name]
    cl = lambda e: f"greatest(0.0, least(1.0, {e}))"
    sweet = f"CASE WHEN transient_avg < {p.low} THEN {cl(f'({p.low} - transient_avg) / {p.low}')} WHEN transient_avg > {p.high} THEN {cl(f'(transient_avg - {p.high}) / {p.high}')} WHEN transient_avg <= {p.target} THEN 0.5 * {cl(f'({p.target} - transient_avg) / {p.target - p.low}')} ELSE 0.5 * {cl(f'(transient_avg - {p.target}) / {p.high - p.target}')} END"
    want = f"(3.0 + ({p.guard_pivot} - sigma) * {p.guard_slope})"
    guard = f"CASE WHEN sigma >= {p.guard_pivot} OR min_pix >= {want} THEN 0.0 ELSE {cl(f'({want} - min_pix) / {want}')} END"
    harsh = f"{p.harsh_sigma} * {cl('(sigma - 3.5) / 3.5')} + {p.harsh_pixels} * {cl('(min_pix - 3) / 9.0')} + {p.harsh_grow} * {cl('(grow_delta - 0.75) / 1.0')}"
    return f"{p.w_stable} * {cl('stable_avg / 100.0')} - {p.w_over} * {cl(f'ratio / {p.max_ratio}')} - {p.w_sweet} * ({sweet}) - {p.w_variance} * (0.6 * {cl('stable_cv / 0.25')} + 0.4 * {cl('transient_cv / 0.75')}) - {p.w_mask} * {cl('(coverage - 0.08) / 0.17')} - {p.w_harsh} * ({harsh}) - {p.w_guard} * ({guard})"


@query(f"WITH {_FAKE} SELECT ord, " + ", ".join(f"round({_score_sql(n)}, 5) AS {n.lower()}" for n in POLICIES) + " FROM fk")
def tuner_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fake(spark).select("ord", *[F.round(tuner.score_column(p), 5).alias(n.lower()) for n, p in POLICIES.items()])


@query(f"WITH {_FAKE}, s AS (SELECT ord, {_score_sql('BALANCED')} AS score FROM fk) SELECT ord, CAST(k AS INTEGER) AS place, round(top - score, 5) AS gap FROM (SELECT *, row_number() OVER (ORDER BY score DESC, ord) AS k, max(score) OVER () AS top FROM s) WHERE k <= 5")
def tuner_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuner.leaderboard(_fake(spark).withColumn("score", tuner.score_column(POLICIES["BALANCED"]))).select("ord", "place", F.round("gap", 5).alias("gap"))


# Whole stages: sequential or greedy, so rows only; their kernels are tested on small cases.


def _session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of a session's detections as a session of its own: candidates grow with the square of a session."""
    det = d.detections(spark, sf_dir)
    return det.select(
        F.concat(F.lit("s"), "session", F.lit("-"), F.col("det_id") % 5).alias("session_id"), (F.col("frame") % d.DAYS).alias("frame_pos"), (F.col("frame") % d.DAYS).alias("seq_index"), F.col("det_id").cast("int").alias("obj_ord"), "det_id", "x", "y", "ts_ms", "exposure_ms",
        F.col("area").alias("pixel_area"), "fwhm", F.col("flux").alias("total_flux"), "peak_sigma", "integrated_sigma", ((F.col("det_id") % 31) / 10.0).alias("angle"),
    )


@query()
def time_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.timed_tracks(_session(spark, sf_dir), 30, DetectionConfig(time_based_velocity_tolerance=0.3, max_fwhm_ratio=0, max_surface_brightness_ratio=0), parts=2)


@query()
def geo_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.geometric_tracks_of(_session(spark, sf_dir), 30, DetectionConfig(max_fwhm_ratio=0, max_surface_brightness_ratio=0, max_jump_pixels=40, angle_tolerance_degrees=10))


@query()
def residual_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = _session(spark, sf_dir).withColumns({"x": F.col("x") % 40, "y": F.col("y") % 40})
    return residual.analyze_residuals(folded, DetectionConfig(enable_local_activity_clusters=True)).drop("members")


def cube_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel cube as frames of stored values."""
    rows = d.frame_rows(d.pixel_cube(spark, sf_dir)).withColumn("px", F.transform("px", lambda v: c.encode(v)))
    g = rows.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("y", "px"))).alias("s"))
    return g.select(F.lit("s").alias("session_id"), F.col("frame").alias("seq_index"), F.concat(F.lit("f"), "frame").alias("filename"), F.lit(d.SIDE).alias("height"), F.lit(d.SIDE).alias("width"), (F.col("frame").cast("long") * 60000).alias("ts_ms"), F.lit(30000).cast("long").alias("exposure_ms"), F.col("s.px").alias("px"))


_RUN = DetectionConfig(detection_sigma_multiplier=SEED, grow_sigma_multiplier=1.5, min_detection_pixels=2, edge_margin_pixels=2, void_proximity_radius=2, void_threshold_fraction=0.0, quality_sigma_multiplier=2.5, quality_grow_sigma_multiplier=1.5, quality_min_detection_pixels=2, star_count_sigma_deviation=50, anomaly_min_pixels=4, anomaly_min_peak_sigma=3.0)


@query()
def pipeline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run over the cube's frames: what it found, by kind."""
    run = pipeline.run_pipeline(materialize(cube_frames(spark, sf_dir), "frames"), _RUN)
    parts = [run.tracks.select(F.concat(F.lit("track:"), "kind").alias("what"), "det_id"), run.anomalies.select(F.concat(F.lit("anomaly:"), "type").alias("what"), "det_id"), run.unclassified.select(F.lit("unclassified").alias("what"), "det_id")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("what").agg(F.count("*").alias("detections"))


@query()
def master_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.generate_master_stack(cube_frames(spark, sf_dir), _RUN)
