import math
from collections import deque
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skysift.config import DetectionConfig
from skysift.operators import sources as s
from skysift.operators.reference import engine_radius, tuner_radius
from skysift.operators.stacks import slow_index


def plain_blobs(image, seed, grow):
    taken, out = set(), []
    h, w = image.shape
    for y in range(h):
        for x in range(w):
            if image[y, x] > seed and (y, x) not in taken:
                taken.add((y, x))
                todo, blob = deque([(y, x)]), []
                while todo:
                    cy, cx = todo.popleft()
                    blob.append(cy * w + cx)
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            n = (cy + dy, cx + dx)
                            if 0 <= n[0] < h and 0 <= n[1] < w and n not in taken and image[n] > grow:
                                taken.add(n)
                                todo.append(n)
                out.append(sorted(blob))
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 12), st.integers(0, 9), st.integers(0, 9))
def test_components_match_plain_search(seed, h, w, hi, lo):
    image = np.random.default_rng(seed).integers(0, 10, (h, w))
    assert [sorted(b.tolist()) for b in s.label_components(image, hi, lo)] == plain_blobs(image, hi, lo)


def test_background_of_a_known_histogram():
    image = np.array([[10] * 50 + [12] * 49 + [60000]])
    median, sigma = s.clip_background(image, DetectionConfig())
    assert median == 10 and sigma == pytest.approx(math.sqrt(49 * 4 / 99))
    assert s.clip_background(np.zeros((4, 4), int), DetectionConfig()) == (0.0, 0.0)


def blob(points, value=200.0, median=100.0, sigma=5.0, config=DetectionConfig()):
    xs, ys = np.array(points, float).T
    return s.measure(xs, ys, np.full(len(xs), value), median, sigma, config)


def test_moments_of_a_square_and_a_line():
    square = blob([(x, y) for x in range(3) for y in range(3)])
    assert (square.x, square.y, square.total_flux) == (1.0, 1.0, 900.0)
    assert square.elongation == pytest.approx(1.0) and square.fwhm == pytest.approx(2.355 * math.sqrt(4 / 3))
    assert square.peak_sigma == 20.0 and square.integrated_sigma == pytest.approx(900 / (5 * 3))
    line = blob([(x, 5) for x in range(30)])
    assert line.is_streak and line.angle == pytest.approx(0.0) and line.elongation == pytest.approx(math.sqrt((30**2 - 1) / 12 / 0.001))
    diagonal = blob([(k, k) for k in range(5)])
    assert diagonal.angle == pytest.approx(math.pi / 4)
    dim = blob([(0, 0), (1, 0)], value=90.0)
    assert dim.total_flux == 2.0
    assert math.isinf(blob([(0, 0)], sigma=0.0).peak_sigma)


def test_void_ring_rejects_borders_and_dark_probes():
    image = np.full((50, 50), 100)
    assert not s.near_void(image, 25.9, 25.2, 20, 50.0)
    assert s.near_void(image, 19.9, 25, 20, 50.0)
    image[5, 25] = 50
    assert s.near_void(image, 25, 25, 20, 50.0) and not s.near_void(image, 25, 25, 20, 49.0)


def test_edge_margin_spares_streaks():
    config = DetectionConfig(edge_margin_pixels=6, void_proximity_radius=1, void_threshold_fraction=0.0, streak_min_pixels=8, streak_min_elongation=3)
    image = np.full((40, 40), 100) + (np.arange(1600).reshape(40, 40) % 5)
    image[2, 5:20] = 900
    image[3:5, 30:32] = 900
    image[20:23, 20:23] = 900
    found, _, _ = s.extract_sources(image, 5.0, 4, config)
    assert [(f.is_streak, len(f.xs)) for f in found] == [(True, 15), (False, 9)]
    assert [f.obj_ord for f in found] == [0, 1]


def test_grow_above_seed_claims_start_only():
    image = np.zeros((5, 5), int)
    image[2, 1:4] = 10
    assert [b.tolist() for b in s.label_components(image, 5, 20)] == [[11], [12], [13]]


def dumbbell():
    ends = [(x, y) for x0 in (0, 12) for x in range(x0, x0 + 5) for y in range(-2, 3)]
    return blob(ends + [(x, 0) for x in range(5, 12)])


def test_shapes():
    assert s.is_binary_star_like(dumbbell())
    assert not s.is_binary_star_like(blob([(x, y) for x in range(18) for y in range(3)]))
    assert not s.is_binary_star_like(blob([(x, 10) for x in range(14)]))
    assert not s.is_irregular_streak(blob([(x, y) for x in range(20) for y in range(2)]))
    assert s.is_irregular_streak(blob([(x, 0) for x in range(20)] + [(x, 12) for x in range(20)]))
    image = np.full((20, 40), 100)
    for x0 in (10, 20):
        image[9:12, x0 - 1 : x0 + 2] = 900
    image[10, 11:20] = 200
    ys, xs = np.nonzero(image > 150)
    pair = s.measure(xs.astype(float), ys.astype(float), image[ys, xs].astype(float), 100, 5, DetectionConfig())
    assert s.is_binary_star(image, pair)
    image[10, 11:20] = 900
    assert not s.is_binary_star(image, pair)


def test_dilation_radii_and_stack_indices():
    assert [engine_radius(j) for j in (0.5, 1.5, 3.0)] == [1, 1, 2]
    assert [tuner_radius(j) for j in (0.5, 1.5, 3.0)] == [1, 2, 3]
    assert [slow_index(n, 0.75) for n in range(1, 7)] == [0, 1, 2, 2, 4, 4]


def test_extract_in_spark(spark):
    from skysift.sources.frames import frame_rows, frames_from_arrays

    image = np.full((64, 64), 1000) + (np.arange(4096).reshape(64, 64) % 7)
    image[30:34, 30:34] += 400
    frames = frames_from_arrays(spark, [image - 32768, image - 32768])
    config = DetectionConfig(edge_margin_pixels=5, void_proximity_radius=5)
    rows = s.extract(frame_rows(frames), 5.0, 10, config).orderBy("seq_index").collect()
    assert [(r.seq_index, r.x, r.y, r.pixel_area, len(r.footprint)) for r in rows] == [(0, pytest.approx(31.5, abs=0.05), pytest.approx(31.5, abs=0.05), 16.0, 16), (1, pytest.approx(31.5, abs=0.05), pytest.approx(31.5, abs=0.05), 16.0, 16)]
    assert s.extract_sources(image, 5.0, 17, replace(config, grow_sigma_multiplier=4.0))[0] == []
