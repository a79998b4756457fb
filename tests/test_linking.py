import math
import time

import numpy as np

from skysift.config import DetectionConfig
from skysift.operators import linking as k
from skysift.operators import residual as r


def points(rows, **more):
    """rows of (frame, x, y); time in ms if given."""
    f, x, y = zip(*rows, strict=True)
    return k.Points.build(pos=f, x=x, y=y, **more)


BASE = DetectionConfig()


def test_no_timed_track_when_speed_changes_and_geometric_without_times():
    rows = [(0, 10, 10), (1, 20, 10), (2, 30, 10)]
    timed = points(rows, ts=[0, 1000, 5000])
    assert [c for a in range(3) for c, _ in k.timed_candidates(timed, a, 3, BASE)] == []
    assert k.has_times(timed) and not k.has_times(points(rows))
    assert k.geometric_tracks(points(rows), 3, BASE, set(), []) == [[0, 1, 2]]


def plain_geometric_tracks(p, frames, config, used):
    """The same by one pair at a time."""
    by_frame, need, cone = k.frames_of(p, frames), k.min_points(frames, config), math.radians(config.angle_tolerance_degrees)
    free, out = np.ones(len(p), bool), []
    free[list(used)] = False
    for a in np.flatnonzero(p.pos < frames - 2).tolist():
        for b in [int(b) for f in by_frame[p.pos[a] + 1 : frames - 1] for b in f]:
            if not (free[a] and free[b] and config.max_star_jitter <= k._dist(p, a, b) <= config.max_jump_pixels and k.similar_profiles(p, a, b, config)):
                continue
            chain = [a, b]
            for later in by_frame[p.pos[b] + 1 :]:
                c, last = later[free[later]], chain[-1]
                error = k.line_error(p.x[a], p.y[a], p.x[last], p.y[last], p.x[c], p.y[c])
                ok = (k._dist(p, last, c) <= config.max_jump_pixels) & (error <= config.prediction_tolerance) & (k.turn(k._bearing(p, a, last), k._bearing(p, last, c)) <= cone)
                ok &= k.similar_profiles(p, last, c, config)
                if ok.any():
                    chain.append(int(c[ok][np.argmin(error[ok])]))
            kept = chain[:1]
            for c in chain[1:] if len(chain) >= need else []:
                kept += [c] if k._dist(p, kept[-1], c) > config.max_star_jitter else []
            if len(kept) >= need and k.steady_rhythm(p.x[kept], p.y[kept], config):
                out.append(kept)
                free[kept] = False
    return out


def test_geometric_tracks_are_the_plain_ones_and_quicker(monkeypatch):
    rng, tracks, seconds = np.random.default_rng(3), 0, [0.0, 0.0]
    for case in range(24):
        n, frames = (160, 30) if case < 4 else (int(rng.integers(0, 60)), int(rng.integers(1, 9)))
        xy = rng.integers(0, 12, (2, n)) if case % 3 == 0 else rng.random((2, n)) * 40  # with ties, and without
        p = k.Points.build(n, pos=np.sort(rng.integers(0, frames, n)), x=xy[0], y=xy[1], area=rng.integers(1, 9, n), fwhm=rng.integers(1, 6, n))
        config = DetectionConfig(max_jump_pixels=[5, 40][case % 2], angle_tolerance_degrees=[5, 30, 180][case % 3], max_star_jitter=[0, 1.5][case // 2 % 2])
        used = set(rng.choice(n, n // 8, replace=False).tolist()) if n else set()
        monkeypatch.setattr(k, "CELLS", 1 << 20 if case < 4 else [50, 1 << 20][case % 2])
        found = []
        for which, run in enumerate((lambda: plain_geometric_tracks(p, frames, config, used), lambda: k.geometric_tracks(p, frames, config, used, []))):
            began = time.process_time()
            found.append(run())
            seconds[which] += time.process_time() - began
        assert found[0] == found[1]
        tracks += len(found[0])
    assert tracks > 20 and seconds[1] < seconds[0] / 4


def test_accepted_timed_track_and_packing():
    p = points([(0, 10, 10), (0, 50, 50), (1, 20, 10), (2, 30, 10), (3, 40, 10)], ts=[0, 0, 1000, 2000, 3000])
    found = [(c, s, 0) for a in range(5) for c, s in k.timed_candidates(p, a, 4, BASE)]
    assert k.pack(found) == [[0, 2, 3, 4]]
    assert k.track_score(p, [0, 2, 3, 4]) == 4000 + 250 * 4 / 4 + 50 * 3 + 5 * 30


def test_exposure_limits_the_baseline():
    p = points([(0, 10, 10), (1, 20, 10), (2, 30, 10)], ts=[0, 1000, 2000], exposure=[1000] * 3)
    assert k.timed_candidates(p, 0, 3, BASE) == []
    assert len(k.timed_candidates(p, 0, 3, DetectionConfig(strict_exposure_kinematics=False))) == 1


def test_jitter_equality_is_accepted_and_gates_are_strict():
    p = points([(0, 0, 0), (1, 1.5, 0), (2, 3, 0)], ts=[0, 1000, 2000])
    assert [c for c, _ in k.timed_candidates(p, 0, 3, BASE)] == [[0, 1, 2]]


def test_profiles():
    p = points([(0, 0, 0), (1, 9, 0), (1, 9, 9)], flux=[0, 0, 5], fwhm=[1, 2, 2.1])
    assert bool(k.similar_profiles(p, 0, 1, BASE)) and not bool(k.similar_profiles(p, 0, 2, BASE))


def test_rhythm():
    x = np.array([0, 10, 20, 40, 50.0])
    assert k.steady_rhythm(x, np.zeros(5), BASE)
    assert not k.steady_rhythm(x * 0.01, np.zeros(5), BASE)
    assert k.steady_rhythm(x[:2], np.zeros(2), BASE)


def streaks(rows, **more):
    p = points(rows, flux=[500] * len(rows), area=[25] * len(rows), exposure=[120_000] * len(rows), peak=[9] * len(rows), **more)
    return p


def test_streaks_chain_and_backtracking_splits():
    p = streaks([(0, 10, 10), (1, 40, 10), (2, 70, 10)], ts=[0, 60000, 120000])
    tracks, alone = k.chain_streaks(p, [0, 1, 2], BASE)
    assert [t.points for t in tracks] == [[0, 1, 2]] and not alone
    back = streaks([(0, 10, 10), (1, 40, 10), (2, 20, 10)], ts=[0, 60000, 120000])
    assert k.merge_streaks(back, k.Track([0, 1], streak=True), k.Track([2], streak=True), BASE) is None


def test_single_streak_promotion_threshold():
    p = streaks([(0, 10, 10), (0, 30, 30)])
    p.peak[:] = [7.0, 6.9]
    assert [t.points for t in k.promote_single_streaks(p, [0, 1], {}, BASE)[0]] == [[0]]


def test_consolidation_takes_suspected_parts():
    p = streaks([(0, 10, 10), (0, 22, 10), (0, 34, 10), (1, 60, 10)], ts=[0, 0, 0, 60000])
    out = k.consolidate_streaks(p, [k.Track([3], streak=True)], [k.Track([0, 1, 2], suspected=True)], BASE)
    assert [sorted(t.points) for t in out] == [[0, 1, 2, 3]] and out[0].streak


def test_anomaly_boundaries():
    cases = [(20, 9, 6), (30, 4, 14), (30, 2.5, 14), (20, 4, 14), (8, 9, 20)]
    assert [k.anomaly_type(*c, BASE) for c in cases] == ["PEAK_SIGMA", "INTEGRATED_SIGMA", None, None, None]


def test_suspected_lines_are_disjoint_and_within_one_frame():
    p = points([(0, 10, 10), (0, 22, 14), (0, 34, 10)])
    assert len(k.suspected_streaks(p, [0, 1, 2], BASE)) == 1
    two = points([(0, x, 10) for x in (10, 22, 34)] + [(0, x, 30) for x in (10, 22, 34, 46)])
    found = k.suspected_streaks(two, list(range(7)), DetectionConfig(suspected_streak_line_tolerance=3.0))
    assert sorted(map(len, (t.points for t in found))) == [3, 4]
    across = points([(0, 10, 10), (1, 22, 10), (2, 34, 10)])
    assert k.suspected_streaks(across, [0, 1, 2], BASE) == []


def test_micro_drift_repeat_and_sparse_drift():
    bright = {"peak": None}
    drift = points([(f, 100 + f, 50) for f in range(5)], peak=[6] * 5)
    assert [(c[0], len(c[1])) for c in r.rescue_candidates(drift)] == [("MICRO_DRIFT", 5)]
    rng = np.random.default_rng(0)
    rep = points([(f, 200 + d, 50) for f, d in zip((0, 1, 2, 4, 5), rng.uniform(-0.1, 0.1, 5), strict=True)], peak=[6] * 5)
    assert r.kind_of(r.metrics_of(rep, [0, 1, 2])) == "LOCAL_REPEAT"
    sparse = points([(f, 300 + d, 60) for f, d in ((2, 0), (5, 0.9), (12, 3.0), (16, 4.2))], peak=[6] * 4)
    assert [(c[0], len(c[1])) for c in r.rescue_candidates(sparse)] == [("SPARSE_LOCAL_DRIFT", 4)]
    assert bright


def test_activity_cluster():
    p = points([(1, 300, 300), (3, 306, 306), (5, 312, 309)], peak=[6] * 3)
    (rows, m), = r.activity_clusters(p, DetectionConfig())
    assert sorted(rows) == [0, 1, 2] and m["frames"] == 3


def test_clusters_match_plain_search():
    rng = np.random.default_rng(3)
    x, y = rng.uniform(-20, 20, (2, 120))
    got = sorted(sorted(g.tolist()) for g in r.proximity_clusters(x, y, 3.0))
    label = list(range(120))
    for _ in range(120):
        for i in range(120):
            for j in range(120):
                if math.hypot(x[i] - x[j], y[i] - y[j]) <= 3.0:
                    label[i] = label[j] = min(label[i], label[j])
    want = {}
    for i, v in enumerate(label):
        want.setdefault(v, []).append(i)
    assert got == sorted(want.values())


def test_line_error_of_a_zero_baseline_is_huge():
    assert k.line_error(1, 1, 1, 1, np.array([2.0]), np.array([3.0]))[0] == np.finfo(float).max
