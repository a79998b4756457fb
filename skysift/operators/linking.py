"""Linking detections into tracks: kernels over one session's points, and the Spark operators that run them.

Kernels work on a ``Points`` table of arrays ordered by (frame position, order within the frame) and name points by their
row. Candidate generation for timed tracks runs in parallel over first points; packing is one ordered pass a session.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DetectionConfig
from .sources import Source, is_binary_star_like


@dataclass
class Points:
    det_id: np.ndarray
    pos: np.ndarray  # place among kept frames
    seq: np.ndarray  # the frame's own sequence number
    x: np.ndarray
    y: np.ndarray
    ts: np.ndarray
    exposure: np.ndarray
    area: np.ndarray
    fwhm: np.ndarray
    flux: np.ndarray
    peak: np.ndarray
    integrated: np.ndarray
    angle: np.ndarray

    def __len__(self) -> int:
        return len(self.x)

    @classmethod
    def build(cls, n: int | None = None, **cols) -> Points:
        """Missing columns get neutral values: times and exposures unknown, area and fwhm 1, flux 100."""
        n = n if n is not None else len(cols["x"])
        base = {"det_id": np.arange(n), "pos": np.zeros(n), "ts": np.full(n, -1), "exposure": np.full(n, -1), "area": np.ones(n), "fwhm": np.ones(n), "flux": np.full(n, 100.0), "peak": np.zeros(n), "integrated": np.zeros(n), "angle": np.zeros(n)}
        base |= cols
        base.setdefault("seq", base["pos"])
        ints = {"det_id", "pos", "seq", "ts", "exposure"}
        return cls(**{f.name: np.asarray(base[f.name], np.int64 if f.name in ints else float) for f in fields(cls)})


def _dist(p: Points, i, j):
    return np.sqrt((p.x[j] - p.x[i]) ** 2 + (p.y[j] - p.y[i]) ** 2)


def _bearing(p: Points, i, j):
    return np.arctan2(p.y[j] - p.y[i], p.x[j] - p.x[i])


def line_error(x1, y1, x2, y2, x, y):
    base = math.hypot(x2 - x1, y2 - y1)
    far = np.full(np.shape(x), np.finfo(float).max)
    return far if base == 0 else np.abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / base


def turn(a, b):
    """Angle between two directions."""
    d = np.abs(a - b)
    return np.where(d > math.pi, 2 * math.pi - d, d)


def same_line(a: float, b: float, tolerance: float) -> bool:
    d = abs(a - b) % math.pi
    return d <= tolerance or math.pi - d <= tolerance


def similar_profiles(p: Points, i, j, config: DetectionConfig):
    ok = np.ones(np.broadcast_shapes(np.shape(i), np.shape(j)), bool)
    if config.max_fwhm_ratio > 0:
        a, b = np.maximum(p.fwhm[i], 0.1), np.maximum(p.fwhm[j], 0.1)
        ok &= np.maximum(a, b) / np.minimum(a, b) <= config.max_fwhm_ratio
    if config.max_surface_brightness_ratio > 0:
        a, b = p.flux[i] / np.maximum(p.area[i], 1), p.flux[j] / np.maximum(p.area[j], 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ok &= ~(np.maximum(a, b) / np.minimum(a, b) > config.max_surface_brightness_ratio)
    return ok


def _within_exposure(p: Points, i, j, dt, dist, config: DetectionConfig):
    if not config.strict_exposure_kinematics:
        return np.ones(np.shape(dist), bool)
    known = (p.ts[i] != -1) & (p.ts[j] != -1) & (p.exposure[i] > 0)
    speed = (np.sqrt(p.area[i]) + config.max_star_jitter) / np.where(p.exposure[i] > 0, p.exposure[i], 1)
    return ~known | (dist <= speed * dt * 1.5 + config.max_star_jitter)


def min_points(frames: int, config: DetectionConfig) -> int:
    return min(config.absolute_max_points_required, max(3, math.ceil(frames / config.track_min_frame_ratio)))


def has_times(p: Points) -> bool:
    """Whether the first point of every frame that has points carries a time."""
    _, first = np.unique(p.pos, return_index=True)
    return bool(len(p)) and bool(np.all(p.ts[first] != -1))


def frames_of(p: Points, count: int) -> list[np.ndarray]:
    cuts = np.searchsorted(p.pos, np.arange(count + 1))
    return [np.arange(cuts[k], cuts[k + 1]) for k in range(count)]


#: Elements of the tables of (second points x candidates) that one step works on.
CELLS = 1 << 20


def timed_chains(p: Points, by_frame: list[np.ndarray], a: int, second: np.ndarray, config: DetectionConfig) -> list[list[int]]:
    """One chain from each baseline a-b, b in ``second``, all extended together frame by frame: each takes the point of
    least velocity error among those that pass all gates, then re-anchors speed and heading at a."""
    cone = math.radians(config.angle_tolerance_degrees)
    last = second.copy()
    speed, heading = _dist(p, a, last) / (p.ts[last] - p.ts[a]), _bearing(p, a, last)
    taken = np.full((len(second), len(by_frame)), -1)
    for f, c in enumerate(by_frame):
        row = np.flatnonzero(p.pos[second] < f)
        if not len(c) or not len(row):
            continue
        i, j = last[row][:, None], c[None, :]
        dt = (p.ts[j] - p.ts[i]).astype(float)
        ok = dt > 0
        dt = np.where(ok, dt, 1.0)
        d = _dist(p, i, j)
        off = np.abs(d / dt - speed[row][:, None])
        ok &= _within_exposure(p, i, j, dt, d, config) & (off <= speed[row][:, None] * config.time_based_velocity_tolerance + config.max_star_jitter / dt)
        base = _dist(p, a, i)
        area = np.abs((p.x[i] - p.x[a]) * (p.y[a] - p.y[j]) - (p.x[a] - p.x[j]) * (p.y[i] - p.y[a]))
        ok &= (base > 0) & (area <= config.prediction_tolerance * np.where(base > 0, base, 1.0))
        ok &= turn(heading[row][:, None], _bearing(p, i, j)) <= np.maximum(cone, np.arctan2(config.max_star_jitter + 1, d))
        ok &= similar_profiles(p, i, j, config)
        pick = np.argmin(np.where(ok, off, np.inf), axis=1)
        hit = ok[np.arange(len(row)), pick]
        row, new = row[hit], c[pick[hit]]
        taken[row, f] = last[row] = new
        speed[row], heading[row] = _dist(p, a, new) / (p.ts[new] - p.ts[a]), _bearing(p, a, new)
    return [[a, int(b), *t[t >= 0].tolist()] for b, t in zip(second, taken, strict=True)]


def timed_candidates(p: Points, a: int, frames: int, config: DetectionConfig) -> list[tuple[list[int], float]]:
    """Every chain that starts at point ``a``, with its score, in the order of its second point."""
    by_frame, need = frames_of(p, frames), min_points(frames, config)
    if p.pos[a] >= frames - 2:
        return []
    second = np.concatenate(by_frame[p.pos[a] + 1 : frames - 1] or [np.zeros(0, int)]).astype(int)
    dt = p.ts[second] - p.ts[a]
    d = _dist(p, a, second)
    ok = (dt > 0) & (d >= config.max_star_jitter) & similar_profiles(p, a, second, config) & _within_exposure(p, a, second, dt, d, config)
    second = second[ok]
    step = max(1, CELLS // max(1, max(map(len, by_frame), default=1)))
    chains = [c for k in range(0, len(second), step) for c in timed_chains(p, by_frame, a, second[k : k + step], config)]
    return [(c, track_score(p, c)) for c in chains if len(c) >= need]


def track_score(p: Points, chain: list[int]) -> float:
    c = np.asarray(chain)
    i, j = c[:-1], c[1:]
    span = max(1, int(p.seq[c[-1]] - p.seq[c[0]]))
    total = float(_dist(p, c[0], c[-1]))

    def delta(a, b):
        timed = (p.ts[a] != -1) & (p.ts[b] != -1) & (p.ts[b] > p.ts[a])
        return np.where(timed, p.ts[b] - p.ts[a], np.maximum(1, p.seq[b] - p.seq[a])).astype(float)

    speed = total / max(float(delta(c[0], c[-1])), 1e-4)
    base = max(total, 1e-4)
    inner = c[1:-1]
    x1, y1, x2, y2 = p.x[c[0]], p.y[c[0]], p.x[c[-1]], p.y[c[-1]]
    bend = np.abs((x2 - x1) * (y1 - p.y[inner]) - (x1 - p.x[inner]) * (y2 - y1)) / base
    drift = np.abs(_dist(p, i, j) / delta(i, j) - speed) / speed if speed > 0 else np.zeros(len(i))
    mean = lambda v: float(np.mean(v)) if len(v) else 0.0
    return 1000.0 * len(c) + 250.0 * len(c) / (span + 1) + 50.0 * span + 5.0 * total - 150.0 * mean(bend) - 250.0 * mean(turn(_bearing(p, c[0], c[-1]), _bearing(p, i, j))) - 400.0 * mean(drift)


def pack(candidates: list[tuple[list[int], float, int]]) -> list[list[int]]:
    """Candidates (chain, score, first sequence number) in generation order: the best first, no shared points."""
    used: set[int] = set()
    kept = []
    for chain, _, _ in sorted(candidates, key=lambda t: (-len(t[0]), -t[1], t[2])):
        if used.isdisjoint(chain):
            used.update(chain)
            kept.append(chain)
    return kept


def steady_rhythm(x: np.ndarray, y: np.ndarray, config: DetectionConfig) -> bool:
    if len(x) < 3:
        return True
    jumps = np.sqrt(np.diff(x) ** 2 + np.diff(y) ** 2)
    typical = float(np.sort(jumps)[len(jumps) // 2])
    if typical < config.rhythm_stationary_threshold or typical == 0:
        return False
    times = np.floor(jumps / typical + 0.5)
    good = (times > 0) & (np.abs(jumps - times * typical) <= config.rhythm_allowed_variance * times)
    return good.sum() / len(jumps) >= config.rhythm_min_consistency_ratio


def geometric_chains(p: Points, by_frame: list[np.ndarray], first: np.ndarray, second: np.ndarray, free: np.ndarray, need: int, config: DetectionConfig) -> np.ndarray:
    """One chain a row from each baseline first-second, all extended together frame by frame over the free points: each takes the
    point nearest its line among those that pass all gates. Gaps are -1; a chain that cannot get ``need`` points any more stops."""
    cone = math.radians(config.angle_tolerance_degrees)
    out = np.full((len(first), 2 + len(by_frame)), -1)
    out[:, 0], out[:, 1] = first, second
    hypot = lambda a, b: np.array(list(map(math.hypot, (p.x[b] - p.x[a]).tolist(), (p.y[b] - p.y[a]).tolist())), float)
    last, size, base, heading = second.copy(), np.full(len(first), 2), hypot(first, second), _bearing(p, first, second)
    for f, c in enumerate(by_frame):
        c = c[free[c]]
        row = np.flatnonzero((p.pos[second] < f) & (size + len(by_frame) - f >= need))
        if not len(c) or not len(row):
            continue
        r, k = np.nonzero(_dist(p, last[row][:, None], c[None, :]) <= config.max_jump_pixels)
        at = row[r]
        a, i, j = first[at], last[at], c[k]
        error = np.abs((p.x[i] - p.x[a]) * (p.y[a] - p.y[j]) - (p.x[a] - p.x[j]) * (p.y[i] - p.y[a]))
        flat = base[at] == 0
        error = np.where(flat, np.finfo(float).max, error / np.where(flat, 1.0, base[at]))
        near = np.flatnonzero(error <= config.prediction_tolerance)
        near = near[turn(heading[at[near]], _bearing(p, i[near], j[near])) <= cone]
        near = near[similar_profiles(p, i[near], j[near], config)]
        near = near[np.lexsort((k[near], error[near], r[near]))]
        near = near[np.diff(r[near], prepend=-1) > 0]  # the best of each row
        row, new = at[near], j[near]
        out[row, 2 + f] = last[row] = new
        size[row] += 1
        base[row], heading[row] = hypot(first[row], new), _bearing(p, first[row], new)
    return out


def geometric_tracks(p: Points, frames: int, config: DetectionConfig, used: set[int], found: list[list[int]]) -> list[list[int]]:
    """Order-dependent linking without times: a track takes its points as soon as it is accepted.

    Chains are made for many baselines at once and looked at in order. A track that is accepted changes only the chains that hold
    one of its points, since the others would not choose anew; only these are made again."""
    by_frame, need = frames_of(p, frames), min_points(frames, config)
    free = np.ones(len(p), bool)
    free[list(used)] = False
    out: list[list[int]] = []
    step = max(1, CELLS // max(1, max(map(len, by_frame), default=1)))

    def chains(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        parts = [geometric_chains(p, by_frame, first[k : k + step], second[k : k + step], free, need, config) for k in range(0, len(first), step)]
        return np.concatenate(parts) if parts else np.zeros((0, 2 + frames), int)

    def moving(chain: list[int]) -> list[int]:
        kept = chain[:1]
        for k in chain[1:]:
            if _dist(p, kept[-1], k) > config.max_star_jitter:
                kept.append(k)
        return kept

    def accepted(chain: list[int]) -> list[int]:
        """What is left of a chain, or nothing."""
        good = len(chain := moving(chain)) >= need and steady_rhythm(p.x[chain], p.y[chain], config)
        return chain if good and not any(len(set(chain) & set(t)) >= 2 for t in found + out) else []

    begins = np.flatnonzero(p.pos < frames - 2)
    ends = np.concatenate(by_frame or [np.zeros(0, int)]).astype(int)
    ends = ends[p.pos[ends] < frames - 1]
    block = max(1, 8 * CELLS // max(1, len(ends) * (2 + frames)))  # chains are as wide as there are frames
    for k in range(0, len(begins), block):
        a = begins[k : k + block]
        a, b = a[free[a]], ends[free[ends]]
        d = _dist(p, a[:, None], b[None, :])
        r, c = np.nonzero((p.pos[b] > p.pos[a][:, None]) & (config.max_star_jitter <= d) & (d <= config.max_jump_pixels))
        a, b = a[r], b[c]
        alike = similar_profiles(p, a, b, config)
        a, b = a[alike], b[alike]
        made, at = chains(a, b), 0
        while True:
            long = at + np.flatnonzero((made[at:] >= 0).sum(axis=1) >= need)
            track, at = next(((t, n) for n in long.tolist() if (t := accepted(made[n][made[n] >= 0].tolist()))), ([], 0))
            if not track:
                break
            out.append(track)
            free[track] = False
            gone = np.zeros(len(p) + 1, bool)  # the last for gaps
            gone[track] = True
            left = np.flatnonzero(free[a] & free[b] & (np.arange(len(a)) > at))
            a, b, made, at = a[left], b[left], made[left], 0
            again = np.flatnonzero(gone[made].any(axis=1))
            made[again] = chains(a[again], b[again])
    return out


# Streaks.


@dataclass
class Track:
    points: list[int]
    streak: bool = False
    suspected: bool = False
    timed: bool = False
    samples: list = field(default_factory=list, repr=False)


def frame_samples(p: Points, rows: list[int]) -> list[tuple[int, int, float, float]]:
    """(sequence number, time or -1, mean x, mean y) of each frame a track touches."""
    r = np.asarray(rows)
    out = []
    for s in np.unique(p.seq[r]):
        own = r[p.seq[r] == s]
        times = p.ts[own][(p.ts[own] != -1) & (p.exposure[own] > 0)]
        out.append((int(s), int(times.min()) if len(times) else -1, float(p.x[own].mean()), float(p.y[own].mean())))
    return out


def endpoints(p: Points, rows: list[int]) -> tuple[float, float, float, float] | None:
    """First and last frame means if a pixel apart, else the farthest two points if a pixel apart."""
    s = frame_samples(p, rows)
    if len(s) >= 2 and math.hypot(s[-1][2] - s[0][2], s[-1][3] - s[0][3]) >= 1:
        return s[0][2], s[0][3], s[-1][2], s[-1][3]
    if len(rows) < 2:
        return None
    i, j = np.triu_indices(len(rows), 1)
    r = np.asarray(rows)
    d = _dist(p, r[i], r[j])
    k = int(np.argmax(d))
    return None if d[k] < 1 else (p.x[r[i[k]]], p.y[r[i[k]]], p.x[r[j[k]]], p.y[r[j[k]]])


def steady_motion(p: Points, rows: list[int], line: tuple[float, float, float, float], config: DetectionConfig) -> bool:
    """Frame means advance along the line, one way, at about one speed."""
    s = frame_samples(p, rows)
    if len(s) <= 1:
        return True
    x0, y0, x1, y1 = line
    along = np.array([(x - x0) * (x1 - x0) + (y - y0) * (y1 - y0) for _, _, x, y in s])
    step = np.diff(along)
    if np.any(np.abs(step) < max(0.5, config.max_star_jitter / 2)) or len(set(np.sign(step))) > 1:
        return False
    times = np.array([t for _, t, _, _ in s])
    timed = (times[1:] != -1) & (times[:-1] != -1)
    dt = np.diff(times)[timed]
    if np.any(dt <= 0):
        return False
    if len(dt) >= 2:
        speeds = np.abs(step[timed]) / dt
        typical = float(np.sort(speeds)[len(speeds) // 2])
        near = np.abs(speeds - typical) <= typical * max(0.0, config.streak_time_consistency_tolerance)
        return typical > 0 and near.sum() / len(speeds) >= config.rhythm_min_consistency_ratio
    if not len(dt) and len(s) >= 3:
        return steady_rhythm(np.array([q[2] for q in s]), np.array([q[3] for q in s]), config)
    return True


def _keeps_time(p: Points, rows: list[int], config: DetectionConfig) -> bool:
    line = endpoints(p, rows) if len(rows) >= 2 else None
    return line is None or steady_motion(p, rows, line, config)


def chain_streaks(p: Points, rows: list[int], config: DetectionConfig) -> tuple[list[Track], list[int]]:
    """(tracks of two or more streaks, streaks left alone), greedily from the first streak on."""
    tolerance = math.radians(config.angle_tolerance_degrees)
    left, tracks, alone = list(rows), [], []
    while left:
        base = left.pop(0)
        chain, heading = [base], None
        while True:
            best = None
            for k in left:
                gap = int(p.seq[k] - p.seq[chain[-1]])
                if gap < 0 or not same_line(p.angle[base], p.angle[k], tolerance):
                    continue
                way = float(_bearing(p, chain[-1], k))
                fits = same_line(p.angle[base], way, tolerance) if heading is None else turn(heading, way) <= tolerance
                if not fits or not _keeps_time(p, [*chain, k], config):
                    continue
                rank = (gap, float(_dist(p, chain[-1], k)))
                if best is None or rank < best[0]:
                    best = (rank, k, way)
            if best is None:
                break
            chain.append(best[1])
            left.remove(best[1])
            heading = best[2] if heading is None else heading
        if len(chain) > 1 and _keeps_time(p, chain, config):
            tracks.append(Track(chain, streak=True))
        else:
            alone.append(base)
    return tracks, alone


def promote_single_streaks(p: Points, alone: list[int], shapes: dict[int, Source], config: DetectionConfig) -> tuple[list[Track], int]:
    """Bright lone streaks become tracks unless they look like a close pair of stars; also the number of those."""
    vetoed = {k for k in alone if config.enable_binary_star_like_streak_shape_veto and k in shapes and is_binary_star_like(shapes[k])}
    return [Track([k], streak=True) for k in alone if k not in vetoed and p.peak[k] >= config.single_streak_min_peak_sigma], len(vetoed)


def best_line(p: Points, rows: list[int], config: DetectionConfig) -> list[int] | None:
    """The line through two of ``rows`` with most members (three at least), then the longest; members along the line."""
    r = np.asarray(rows)
    best: tuple[int, float, list[int]] | None = None
    for a in range(len(r) - 1):
        for b in range(a + 1, len(r)):
            i, j = r[a], r[b]
            if _dist(p, i, j) < 1:
                continue
            on = r[line_error(p.x[i], p.y[i], p.x[j], p.y[j], p.x[r], p.y[r]) <= max(0.0, config.suspected_streak_line_tolerance)]
            if len(on) < 3:
                continue
            on = on[np.argsort((p.x[on] - p.x[i]) * (p.x[j] - p.x[i]) + (p.y[on] - p.y[i]) * (p.y[j] - p.y[i]), kind="stable")]
            span = float(_dist(p, on[0], on[-1]))
            if best is None or len(on) > best[0] or (len(on) == best[0] and span > best[1] + 1e-6):
                best = (len(on), span, on.tolist())
    return best[2] if best else None


def suspected_streaks(p: Points, rows: list[int], config: DetectionConfig) -> list[Track]:
    """Disjoint lines of rescued anomalies within single frames."""
    out = []
    for s in sorted({int(p.seq[k]) for k in rows if p.seq[k] >= 0}):
        left = [k for k in rows if p.seq[k] == s]
        while len(left) >= 3 and (line := best_line(p, left, config)):
            out.append(Track(line, suspected=True))
            left = [k for k in left if k not in set(line)]
    return out


def _frames(p: Points, t: Track) -> set[int]:
    return set(p.seq[t.points].tolist())


def _priority(p: Points):
    return lambda t: (not t.streak, -len(_frames(p, t)), -len(t.points), -float(p.peak[t.points].max()))


def _in_order(p: Points, t: Track) -> Track:
    line = endpoints(p, t.points) if len(t.points) > 1 else None
    if line:
        x0, y0, x1, y1 = line
        t.points = sorted(t.points, key=lambda k: (p.seq[k], (p.x[k] - x0) * (x1 - x0) + (p.y[k] - y0) * (y1 - y0)))
    return t


def _orientation(p: Points, t: Track) -> float:
    line = endpoints(p, t.points) if len(t.points) > 1 else None
    return math.atan2(line[3] - line[1], line[2] - line[0]) if line else float(p.angle[t.points[0]])


def merge_streaks(p: Points, a: Track, b: Track, config: DetectionConfig) -> tuple[int, float, Track] | None:
    """(frame gap, largest line error, merged track) if the two can be one streak."""
    fa, fb = _frames(p, a), _frames(p, b)
    gap = max(0, min(fb) - max(fa), min(fa) - max(fb))
    if gap > (1 if len(fa) == len(fb) == 1 else 2):
        return None
    rows = list(dict.fromkeys(a.points + b.points))
    line = endpoints(p, rows)
    if line is None:
        return None
    tolerance = max(math.radians(config.angle_tolerance_degrees), math.radians(5.0 if fa & fb else 4.0))
    angle = math.atan2(line[3] - line[1], line[2] - line[0])
    if not all(same_line(_orientation(p, t), angle, tolerance) for t in (a, b)):
        return None
    error = float(line_error(*line, p.x[rows], p.y[rows]).max())
    if error > max(config.suspected_streak_line_tolerance, 0.0, 2 * config.prediction_tolerance) or not steady_motion(p, rows, line, config):
        return None
    streak = a.streak or b.streak or len(fa | fb) > 1
    return gap, error, _in_order(p, Track(rows, streak=streak, suspected=not streak and (a.suspected or b.suspected)))


def consolidate_streaks(p: Points, confirmed: list[Track], suspected: list[Track], config: DetectionConfig) -> list[Track]:
    """Confirmed tracks first, then suspected ones, each merged into the best track so far that takes it."""
    out: list[Track] = []
    for t in sorted(confirmed, key=_priority(p)) + sorted(suspected, key=_priority(p)):
        t = _in_order(p, Track(list(t.points), t.streak, t.suspected, t.timed))
        best = None
        for k, other in enumerate(out):
            m = merge_streaks(p, other, t, config)
            if m is None:
                continue
            if best is None or m[0] < best[1][0] or (m[0] == best[1][0] and (m[1] < best[1][1] - 1e-6 or (abs(m[1] - best[1][1]) <= 1e-6 and len(m[2].points) > len(best[1][2].points)))):
                best = (k, m)
        if best:
            out[best[0]] = best[1][2]
        else:
            out.append(t)
    return sorted(out, key=_priority(p))


# Anomalies.


def anomaly_type(area: float, peak: float, integrated: float, config: DetectionConfig) -> str | None:
    if area < config.anomaly_min_pixels:
        return None
    if peak >= config.anomaly_min_peak_sigma:
        return "PEAK_SIGMA"
    deep = area >= config.anomaly_min_integrated_pixels and integrated >= config.anomaly_min_integrated_sigma and peak >= config.anomaly_min_peak_sigma_floor
    return "INTEGRATED_SIGMA" if deep else None


# Spark operators.

COLUMNS = {"det_id": "det_id", "pos": "frame_pos", "seq": "seq_index", "x": "x", "y": "y", "ts": "ts_ms", "exposure": "exposure_ms", "area": "pixel_area", "fwhm": "fwhm", "flux": "total_flux", "peak": "peak_sigma", "integrated": "integrated_sigma", "angle": "angle"}


def points_from(table: pa.Table) -> Points:
    """A session's detections as arrays, in (frame position, order) order."""
    table = table.sort_by([("frame_pos", "ascending"), ("obj_ord", "ascending")])
    return Points.build(**{k: table.column(c).to_numpy() for k, c in COLUMNS.items()})


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by key over all shuffle partitions: kernels are slow for their bytes, so small partitions must not be merged."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


TRACKS = "session_id string, track_id int, kind string, ord int, det_id long"


def timed_tracks(detections: DataFrame, frames: int, config: DetectionConfig = DetectionConfig(), parts: int = 16) -> DataFrame:
    """(session_id, track_id, kind, ord, det_id). First points are dealt over ``parts`` tasks a session, each holding the
    session's points; what they propose is packed in one ordered pass a session."""
    own = detections.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def propose(key: tuple, table: pa.Table) -> pa.Table:
        p = points_from(table)
        rows = []
        if has_times(p):
            for a in range(key[1].as_py(), len(p), parts):
                rows += [(a, k, p.det_id[c].tolist(), s, int(p.seq[c[0]])) for k, (c, s) in enumerate(timed_candidates(p, a, frames, config))]
        return pa.table({"session_id": pa.array([key[0].as_py()] * len(rows), pa.string()), "gen": pa.array([r[0] for r in rows], pa.int32()), "gen2": pa.array([r[1] for r in rows], pa.int32()), "chain": pa.array([r[2] for r in rows], pa.list_(pa.int64())), "score": pa.array([r[3] for r in rows], pa.float64()), "first": pa.array([r[4] for r in rows], pa.int32())})

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("gen", "ascending"), ("gen2", "ascending")])
        kept = pack(list(zip(table.column("chain").to_pylist(), table.column("score").to_pylist(), table.column("first").to_pylist(), strict=True)))
        rows = [(t, o, d) for t, c in enumerate(kept) for o, d in enumerate(c)]
        return pa.table({"session_id": pa.array([key[0].as_py()] * len(rows), pa.string()), "track_id": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array(["timed"] * len(rows), pa.string()), "ord": pa.array([r[1] for r in rows], pa.int32()), "det_id": pa.array([r[2] for r in rows], pa.int64())})

    found = _dealt(own, "session_id", "_part").groupBy("session_id", "_part").applyInArrow(propose, "session_id string, gen int, gen2 int, chain array<long>, score double, first int")
    return found.groupBy("session_id").applyInArrow(choose, TRACKS)


def geometric_tracks_of(detections: DataFrame, frames: int, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Tracks without times; order-dependent, so one task a session."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        p = points_from(table)
        rows = [(t, o, int(p.det_id[k])) for t, c in enumerate(geometric_tracks(p, frames, config, set(), [])) for o, k in enumerate(c)]
        return pa.table({"session_id": pa.array([key[0].as_py()] * len(rows), pa.string()), "track_id": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array(["geometric"] * len(rows), pa.string()), "ord": pa.array([r[1] for r in rows], pa.int32()), "det_id": pa.array([r[2] for r in rows], pa.int64())})

    return _dealt(detections, "session_id").groupBy("session_id").applyInArrow(run, TRACKS)
