import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.config import POLICIES, DetectionConfig
from skysift.functions import columns as c
from skysift.operators import drift, quality, reference, tuner
from skysift.plans import pipeline
from skysift.sources import frames as fr


def test_encode_wraps_and_medians(spark):
    df = spark.createDataFrame([(0,), (32768,), (65535,), (65536,), (-1,)], "v int")
    assert [r[0] for r in df.select(c.encode(F.col("v"))).collect()] == [-32768, 0, 32767, -32768, 32767]
    row = spark.createDataFrame([([4.0, 1.0, 3.0, 2.0],)], "a array<double>").select(c.lower_median(F.col("a")), c.upper_median(F.col("a")), c.round_half_up(F.lit(-0.5))).first()
    assert tuple(row) == (2.0, 3.0, 0)


def test_profile_zero_cases(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 2.0), (1.0, 2.1)], "a double, b double")
    one = F.lit(1.0)
    got = df.select(c.profile_consistent(one, F.col("a"), one, one, F.col("b"), one, DetectionConfig())).collect()
    assert [r[0] for r in got] == [True, False, True, False]


def test_session_rejection_numbers(spark):
    rows = [("s", k, 1000.0, 10.0, 3.0, e, b, 100) for k, (e, b) in enumerate([(1.12, 1.18), (1.11, 1.20), (1.13, 1.19), (1.12, 2.10), (1.10, 1.17)])]
    m = spark.createDataFrame(rows, "session_id string, k int, background double, noise double, fwhm double, ecc double, bright_ecc double, stars int")
    lim = quality.session_thresholds(m, ["session_id"])
    t = lim.first()
    assert t.min_stars == pytest.approx(99.998) and t.max_fwhm == pytest.approx(3.5) and t.max_ecc == pytest.approx(1.22) and t.max_bright_ecc == pytest.approx(1.29)
    assert (t.base_background - t.max_background_off, t.base_background + t.max_background_off) == (990, 1010)
    out = quality.reject_frames(m, lim, ["session_id"]).orderBy("k").collect()
    assert [r.is_rejected for r in out] == [False, False, False, True, False] and out[3].reason == quality.REASONS["bright"]
    few = quality.reject_frames(m.limit(2), quality.session_thresholds(m.limit(2), ["session_id"]), ["session_id"]).collect()
    assert {r.reason for r in few} == {"OK"}


@pytest.mark.parametrize("size,pads,want", [(40, (4, 2, 3, 1), (2, 2)), (60, (12, 1, 2, 7), (11, -5))])
def test_drift_vectors(spark, size, pads, want):
    left, right, top, bottom = pads
    image = np.full((size, size), -32768, np.int16)
    image[top : size - bottom, left : size - right] = -32600
    px = fr.pixels(fr.frames_from_arrays(spark, [image]))
    v = drift.drift_vectors(drift.valid_bounds(px, ["session_id", "seq_index"], size, size), ["session_id", "seq_index"], size, size)
    row = v.first()
    assert (row.dx, row.dy) == want
    assert drift.void_radius(v, 5).first()[0] == max(pads) + 10


def test_mask_and_overlap(spark):
    px = spark.createDataFrame([(0, 0), (5, 5)], "y int, x int")
    mask = reference.dilated_mask(px, [], 1, 8, 8)
    assert mask.count() == 3 + 5
    foot = spark.createDataFrame([(1, 5, 5, 0), (1, 6, 5, 0), (1, 7, 7, 0), (1, 9, 9, 0)], "id int, x int, y int, v int")
    assert reference.overlap(foot, mask, ["id"], []).first().overlap == 0.5
    assert reference.overlap(foot, mask, ["id"], [], (8, 8)).first().overlap == pytest.approx(2 / 3)


def test_slow_mover_elongation_limit(spark):
    few = spark.createDataFrame([("s", 1.0)] * 9, "session_id string, elongation double")
    assert reference.elongation_limit(few, ["session_id"], DetectionConfig()).first().threshold == 3.0
    many = spark.createDataFrame([("s", e) for e in (1.0, 1.4, 1.6, 1.8, 2.0, 2.0, 2.2, 2.4, 4.6, 4.9, 5.1)], "session_id string, elongation double")
    t = reference.elongation_limit(many, ["session_id"], DetectionConfig()).first()
    assert t.med == 2.0 and t.mad == pytest.approx(0.4) and t.threshold == pytest.approx(3.8)


def test_winner_fold_prefers_lower_sigma_within_the_window():
    rows = [{"score": 50.0, "sigma": 5.0}, {"score": 44.0, "sigma": 4.0}, {"score": 45.0, "sigma": 6.0}]
    assert tuner.pick_winner(rows, POLICIES["BALANCED"])["score"] == 50.0
    assert tuner.pick_winner(rows, POLICIES["AGGRESSIVE"]) == rows[2]
    assert tuner.pick_winner([], POLICIES["BALANCED"]) is None


def test_sample_ranks_and_crops():
    assert tuner.sample_ranks(4) == [0, 1, 2, 3] and tuner.sample_ranks(20) == [0, 1, 2, 9, 10]
    assert tuner.crop_regions(700, 700) == [] and tuner.crop_regions(1000, 900)[1] == (250, 200, 500, "center")


def session(spark, frames=6):
    rng = np.random.default_rng(5)
    base = 1000 + rng.integers(-6, 7, (96, 96))
    for y, x in ((30, 30), (30, 60), (60, 45), (65, 65), (45, 28), (50, 60)):
        base[y - 2 : y + 3, x - 2 : x + 3] += 300
    images = []
    for k in range(frames):
        image = base + rng.integers(-3, 4, base.shape)
        x = 30 + 6 * k
        image[40:44, x : x + 4] += 400
        images.append(image - 32768)
    return fr.frames_from_arrays(spark, images, ts_ms=[60_000 * k for k in range(frames)])


CONFIG = DetectionConfig(edge_margin_pixels=4, void_proximity_radius=4, anomaly_min_pixels=10)


def test_pipeline_finds_the_mover_and_partitions_detections(spark):
    frames = session(spark)
    run = pipeline.run_pipeline(frames, CONFIG)
    tracks = run.tracks.collect()
    moving = [t for t in tracks if t.kind == "timed"]
    assert len({t.track_id for t in moving}) == 1 and len(moving) >= 4
    ids = [t.det_id for t in tracks] + [a.det_id for a in run.anomalies.collect()] + [u.det_id for u in run.unclassified.collect()]
    assert sorted(ids) == sorted(r.det_id for r in run.transients.select("det_id").collect())
    assert "tracks" in run.report()


def test_plans_of_a_run_stay_small_and_outlive_its_release(spark):
    run = pipeline.run_pipeline(session(spark, 4), CONFIG)
    parts = [run.tracks, run.anomalies, run.unclassified, run.transients, run.residuals]
    whole = [sorted(map(str, part.collect())) for part in parts]
    assert [len(part._jdf.queryExecution().executedPlan().toString().splitlines()) < 100 for part in parts] == [True] * 5
    run.release()
    assert [sorted(map(str, part.collect())) for part in parts] == whole and any(whole)


def test_master_stack_and_its_reuse(spark):
    frames = session(spark)
    stack = pipeline.generate_master_stack(frames, CONFIG)
    assert stack.count() == 96
    t = pipeline.detect_transients(frames, CONFIG, provided_stack=stack)
    assert t.master_stars.count() >= 4 and t.vetoed.filter("is_purged").count() > 0


def test_sizes_must_agree(spark):
    bad = fr.frames_from_arrays(spark, [np.zeros((4, 4)), np.zeros((5, 4))])
    with pytest.raises(ValueError):
        fr.check_sizes(bad)


def test_grey_maps(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.pgm").write_bytes(b"P5\n# note\n3 2\n65535\n" + np.arange(6, dtype=">u2").tobytes())
    rows = fr.read_pgm(spark, str(tmp_path / "*.pgm")).orderBy("seq_index").collect()
    assert [r.seq_index for r in rows] == [0, 1] and rows[0].px[0][0] == -32768 and (rows[0].height, rows[0].width) == (2, 3)


def test_stream_of_frames(spark, tmp_path):
    from skysift.streaming.frames import extract_batch, read_frames

    session(spark, 2).write.parquet(str(tmp_path / "in"))
    seen = []
    q = read_frames(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda df, _: seen.append(extract_batch(df, CONFIG).count())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(seen) > 5


def test_pixel_explode_cuts_nothing(spark, tmp_path):
    from skysift.plans import catalog

    for name, size in (("whole", 64), ("long", 65)):
        spark.createDataFrame([(1, [k / 10 for k in range(size)])], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / name / "embeddings.parquet"))
    got = {(r.y, r.x): r.v for r in catalog.pixel_explode(spark, str(tmp_path / "whole")).collect()}
    assert got == {(k // 8, k % 8): k * 100 for k in range(64)}
    with pytest.raises(Exception, match="64 values"):
        catalog.pixel_explode(spark, str(tmp_path / "long")).collect()


def test_pixel_explode_rounds_as_its_sql(spark, tmp_path):
    import duckdb
    import numpy as np

    from skysift.plans import catalog

    near = np.nextafter(np.arange(-32, 32, dtype="float32") / 1000 + np.float32(0.0005), np.float32(-1), dtype="float32")
    for kind in ("float", "double"):
        path = str(tmp_path / kind / "embeddings.parquet")
        spark.createDataFrame([(1, [float(v) for v in near])], f"vec_id long, embedding array<{kind}>").write.parquet(path)
        got = sorted(map(tuple, catalog.pixel_explode(spark, str(tmp_path / kind)).collect()))
        db = duckdb.connect()
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
        assert got == sorted(db.sql(catalog.ORACLES["pixel_explode"]).fetchall())


def test_sessions_of_different_length_are_linked_apart(spark):
    def points(session, frames, step):
        return [(session, k, k, 0, k * 1000 + len(session), 10.0 + step * k, 20.0, k * 60_000, 1_000, 4.0, 2.0, 100.0, 6.0, 6.0, 0.0, False, [], False) for k in range(frames)]

    schema = "session_id string, frame_pos int, seq_index int, obj_ord int, det_id long, x double, y double, ts_ms long, exposure_ms long, pixel_area double, fwhm double, total_flux double, peak_sigma double, integrated_sigma double, angle double, is_streak boolean, footprint array<struct<x:int,y:int,v:int>>, is_purged boolean"
    config = DetectionConfig(strict_exposure_kinematics=False)

    def linked(rows, lengths):
        out = pipeline.link(spark.createDataFrame(rows, schema), spark.createDataFrame(lengths, "session_id string, n_frames int"), config).collect()
        return sorted((r.session_id, r.what, r.kind or "", r.group_id, r.ord, r.det_id) for r in out)

    # Three points are enough for a session of four frames, not for one of fifteen.
    short, long_ = points("a", 3, 12), points("bb", 3, 12)
    alone = linked(short, [("a", 4)])
    both = linked(short + long_, [("a", 4), ("bb", 15)])
    assert [r for r in both if r[0] == "a"] == alone and any(r[1] == "track" for r in alone)
    assert not any(r[1] == "track" for r in both if r[0] == "bb")


def test_drift_of_sessions_of_different_size(spark):
    def frame(session, side, pad):
        px = np.full((side, side), -32768)
        px[pad : side - 2, 3 : side - 1] = -32600
        return (session, 0, "f", side, side, 0, 1, px.tolist())

    rows = [frame("a", 30, 4), frame("b", 50, 12)]
    make = lambda r: spark.createDataFrame(r, fr.SCHEMA)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    both, radius = pipeline.analyze_drift(make(rows), DetectionConfig())
    single = [pipeline.analyze_drift(make([r]), DetectionConfig()) for r in rows]
    assert key(both) == sorted(x for v, _ in single for x in key(v))
    assert key(radius) == sorted(x for _, r in single for x in key(r)) == [("a", 20), ("b", 22)]  # the given radius is 20
