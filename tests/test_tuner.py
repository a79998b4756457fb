import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.config import DetectionConfig
from skysift.operators import tuner

S = tuner.TunerSettings(sigmas=(4.0, 6.0), min_pixels=(5,), grow_deltas=(1.25,), overlaps=(0.65, 0.75), min_stable=5)


def crops(spark, frames=5, shift=0.0):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(frames):
        image = 1000 + rng.integers(-4, 5, (96, 96))
        for y, x in ((20, 20), (20, 70), (48, 48), (70, 25), (72, 74), (45, 80)):
            dx = int(round(shift * (k - 2)))
            image[y - 2 : y + 3, x - 2 + dx : x + 3 + dx] += 500
        rows += [(0, k, y, image[y].tolist()) for y in range(96)]
    return spark.createDataFrame(rows, "crop int, frame int, y int, px array<int>")


def test_tune_finds_a_point_and_reports(spark):
    out = tuner.tune(crops(spark), DetectionConfig(edge_margin_pixels=5, void_proximity_radius=5), "BALANCED", S)
    assert out.success and out.config.detection_sigma_multiplier in S.sigmas and out.config.max_star_jitter >= 1.0
    assert "validation: passed" in out.report


def test_too_few_frames_fall_back(spark):
    base = DetectionConfig()
    out = tuner.tune(crops(spark, 3), base, "BALANCED", S)
    assert not out.success and out.config is base


def test_jitter_follows_the_shift():
    rng = np.random.default_rng(0)
    cube = 1000 + rng.integers(-2, 3, (5, 64, 64))
    for k in range(5):
        for y, x in ((16, 16), (16, 46), (46, 16), (46, 46)):
            cube[k, y - 2 : y + 3, x - 4 + k : x + 1 + k] += 2200
    d = tuner.jitter_distances(cube, DetectionConfig(), tuner.TunerSettings())
    assert tuner.jitter_value(d, tuner.TunerSettings()) == pytest.approx(4.0, abs=0.5)
    assert tuner.jitter_value([1.0] * 3, tuner.TunerSettings()) == 1.5


def test_gates(spark):
    row = spark.createDataFrame([(True, 5, 0.0, 20), (True, 50, 0.5, 20), (False, 50, 0.0, 20), (True, 50, 0.0, 20)], "usable boolean, objects int, ratio double, stable int")
    got = [r[0] for r in row.select(tuner.gate_column(tuner.POLICIES["BALANCED"])).collect()]
    assert got[3] is None and got[2] == "crop failure" and "bounds" in got[0] and "transient" in got[1]
    assert row.select(F.lit(1)).count() == 4
