"""Column helpers: index medians, rounding, geometry, gates. The single home of the arithmetic conventions.

Pixel values live in the shifted domain (stored + 32768) as INT. Division is guarded, because ANSI mode raises.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DetectionConfig

HUGE = 1.7976931348623157e308


def encode(shifted: Column) -> Column:
    """Shifted 0..65535 to a stored signed 16-bit value; other values wrap like a 16-bit store."""
    low = F.pmod(shifted.cast("int") - 32768, F.lit(65536))
    return F.when(low >= 32768, low - 65536).otherwise(low).cast("smallint")


def decode(stored: Column) -> Column:
    return stored.cast("int") + 32768


def kth(values: Column, k: Column) -> Column:
    """Element ``k`` (from 0) of the sorted array; null when it is empty."""
    return F.get(F.array_sort(values), k.cast("int"))


def upper_median(values: Column) -> Column:
    """Sorted index n/2: sessions, rhythm, slow movers."""
    return kth(values, F.floor(F.size(values) / 2))


def lower_median(values: Column) -> Column:
    """Sorted index (n-1)/2: stacks."""
    return kth(values, F.floor((F.size(values) - 1) / 2))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def normalize(x: Column, lo: float, hi: float) -> Column:
    return F.lit(0.0) if hi <= lo else clamp01((x - lo) / (hi - lo))


def ratio(a: Column, b: Column, when_zero: Column) -> Column:
    return F.when(b == 0, when_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def line_distance(x1: Column, y1: Column, x2: Column, y2: Column, x3: Column, y3: Column, base: Column) -> Column:
    """Distance of point 3 from the line 1-2 of length ``base``; a zero base is as far as can be."""
    area = F.abs((x2 - x1) * (y1 - y3) - (x1 - x3) * (y2 - y1))
    return ratio(area, base, F.lit(HUGE))


def angles_match(a: Column, b: Column, tolerance: float | Column) -> Column:
    """Equal as undirected lines."""
    diff = F.abs(a - b) % math.pi
    return (diff <= tolerance) | (math.pi - diff <= tolerance)


def angular_difference(a: Column, b: Column) -> Column:
    diff = F.abs(a - b)
    return F.when(diff > math.pi, 2 * math.pi - diff).otherwise(diff)


def profile_consistent(fwhm1: Column, flux1: Column, area1: Column, fwhm2: Column, flux2: Column, area2: Column, config: DetectionConfig) -> Column:
    """FWHM and surface-brightness ratios; a limit of 0 is off; 0/0 passes, x/0 fails."""
    ok = F.lit(True)
    if config.max_fwhm_ratio > 0:
        a, b = F.greatest(fwhm1, F.lit(0.1)), F.greatest(fwhm2, F.lit(0.1))
        ok = ok & (F.greatest(a, b) <= F.least(a, b) * config.max_fwhm_ratio)
    if config.max_surface_brightness_ratio > 0:
        a, b = flux1 / F.greatest(area1, F.lit(1.0)), flux2 / F.greatest(area2, F.lit(1.0))
        hi, lo = F.greatest(a, b), F.least(a, b)
        ok = ok & F.when(lo == 0, hi == 0).otherwise(ratio(hi, lo, F.lit(0.0)) <= config.max_surface_brightness_ratio)
    return ok


def exposure_limit(area: Column, exposure_ms: Column, dt: Column, config: DetectionConfig) -> Column:
    """Longest jump that the length of a trail within one exposure allows; null when the exposure is unknown."""
    speed = (F.sqrt(area) + config.max_star_jitter) / F.when(exposure_ms > 0, exposure_ms)
    return speed * dt * 1.5 + config.max_star_jitter


def track_delta(ts1: Column, ts2: Column, frame1: Column, frame2: Column) -> Column:
    """Milliseconds between points when both are known and ordered, else frames, at least one."""
    timed = (ts1 != -1) & (ts2 != -1) & (ts2 > ts1)
    return F.when(timed, (ts2 - ts1).cast("double")).otherwise(F.greatest(F.lit(1), frame2 - frame1).cast("double"))
