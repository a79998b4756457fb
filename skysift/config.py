"""Parameters. Everything is immutable; derive variants with ``dataclasses.replace``."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class DetectionConfig:
    # extraction, border, streak
    bg_clipping_iterations: int = 3
    bg_clipping_factor: float = 3.0
    detection_sigma_multiplier: float = 5.0
    grow_sigma_multiplier: float = 3.0
    min_detection_pixels: int = 10
    edge_margin_pixels: int = 15
    void_threshold_fraction: float = 0.5
    void_proximity_radius: int = 20
    streak_min_elongation: float = 6.0
    streak_min_pixels: int = 25
    single_streak_min_peak_sigma: float = 7.0
    enable_binary_star_like_streak_shape_veto: bool = True
    # stacks, slow movers
    master_sigma_multiplier: float = 2.25
    master_min_detection_pixels: int = 3
    enable_slow_mover_detection: bool = True
    slow_mover_stack_middle_fraction: float = 0.75
    master_slow_mover_min_pixels: int = 15
    master_slow_mover_sigma_multiplier: float = 4.0
    master_slow_mover_grow_sigma_multiplier: float = 3.5
    slow_mover_baseline_mad_multiplier: float = 4.5
    slow_mover_median_support_overlap_fraction: float = 0.0
    slow_mover_median_support_max_overlap_fraction: float = 0.65
    enable_slow_mover_residual_footprint_filtering: bool = True
    slow_mover_residual_footprint_min_flux_fraction: float = 0.10
    # frame quality
    quality_sigma_multiplier: float = 5.0
    quality_grow_sigma_multiplier: float = 3.0
    quality_min_detection_pixels: int = 5
    quality_bright_star_peak_sigma_offset: float = 30.0
    quality_bright_star_min_stars: int = 8
    quality_max_elongation_for_fwhm: float = 1.5
    error_fallback_value: float = 999.0
    min_background_deviation_adu: float = 10.0
    min_eccentricity_envelope: float = 0.10
    min_bright_star_eccentricity_envelope: float = 0.10
    min_fwhm_envelope: float = 0.5
    # tracking, mask
    max_star_jitter: float = 1.5
    max_mask_overlap_fraction: float = 0.75
    max_jump_pixels: float = 400.0
    prediction_tolerance: float = 3.0
    angle_tolerance_degrees: float = 2.0
    time_based_velocity_tolerance: float = 0.10
    streak_time_consistency_tolerance: float = 0.50
    strict_exposure_kinematics: bool = True
    enable_geometric_track_linking: bool = False
    track_min_frame_ratio: float = 3.0
    absolute_max_points_required: int = 5
    max_fwhm_ratio: float = 2.0
    max_surface_brightness_ratio: float = 2.0
    rhythm_stationary_threshold: float = 0.5
    rhythm_allowed_variance: float = 8.0
    rhythm_min_consistency_ratio: float = 0.70
    # session rejection
    min_frames_for_analysis: int = 3
    star_count_sigma_deviation: float = 2.0
    fwhm_sigma_deviation: float = 2.5
    eccentricity_sigma_deviation: float = 3.0
    enable_bright_star_eccentricity_filter: bool = True
    bright_star_eccentricity_sigma_deviation: float = 3.0
    background_sigma_deviation: float = 3.0
    zero_sigma_fallback: float = 0.001
    # anomaly rescue
    enable_anomaly_rescue: bool = True
    anomaly_min_pixels: int = 15
    anomaly_min_peak_sigma: float = 8.0
    anomaly_min_integrated_pixels: int = 25
    anomaly_min_integrated_sigma: float = 12.0
    anomaly_min_peak_sigma_floor: float = 3.0
    anomaly_suspected_streak_min_elongation: float = 3.5  # kept for old parameter files; nothing reads it
    suspected_streak_line_tolerance: float = 6.0
    # residual
    enable_residual_transient_analysis: bool = True
    enable_local_rescue_candidates: bool = True
    enable_local_activity_clusters: bool = False
    local_activity_cluster_radius_pixels: float = 10.0
    local_activity_cluster_min_frames: int = 3

    def for_master(self) -> DetectionConfig:
        """Extraction on a stacked reference."""
        return replace(self, grow_sigma_multiplier=self.master_sigma_multiplier, edge_margin_pixels=5, void_proximity_radius=5)

    def for_slow_movers(self) -> DetectionConfig:
        return replace(self, grow_sigma_multiplier=self.master_slow_mover_grow_sigma_multiplier)

    def for_quality(self) -> DetectionConfig:
        return replace(self, grow_sigma_multiplier=self.quality_grow_sigma_multiplier)


#: Old names in parameter files.
ALIASES = {"maxElongationForFwhm": "qualityMaxElongationForFwhm"}


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join("ADU" if p == "adu" else p.capitalize() for p in rest)


def config_from_json(text: str) -> DetectionConfig:
    """Read camelCase or snake_case keys; unknown keys raise ValueError."""
    names = {_camel(f.name): f.name for f in fields(DetectionConfig)} | {f.name: f.name for f in fields(DetectionConfig)}
    names |= {old: names[new] for old, new in ALIASES.items()}
    given = json.loads(text)
    if unknown := set(given) - set(names):
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return DetectionConfig(**{names[k]: v for k, v in given.items()})


def config_to_json(config: DetectionConfig) -> str:
    return json.dumps({_camel(f.name): getattr(config, f.name) for f in fields(config)})


@dataclass(frozen=True)
class TunerPolicy:
    max_ratio: float
    target: float
    low: float
    high: float
    w_stable: float
    w_over: float
    w_sweet: float
    w_variance: float
    w_mask: float
    w_harsh: float
    harsh_sigma: float
    harsh_pixels: float
    harsh_grow: float
    w_guard: float
    guard_pivot: float
    guard_slope: float
    prefer_lower_sigma: bool = False


#: Fixed values of the three tuning profiles.
POLICIES = {
    "CONSERVATIVE": TunerPolicy(0.05, 0.20, 0.05, 0.50, 100, 120, 20, 60, 50, 22, 0.40, 0.35, 0.25, 10, 4, 3),
    "BALANCED": TunerPolicy(0.05, 0.35, 0.15, 0.80, 100, 120, 25, 60, 50, 20, 0.55, 0.20, 0.25, 18, 4, 4),
    "AGGRESSIVE": TunerPolicy(0.12, 1.00, 0.40, 2.00, 100, 70, 35, 50, 50, 34, 0.90, 0.00, 0.15, 22, 4, 3, True),
}
