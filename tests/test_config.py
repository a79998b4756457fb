import dataclasses
import json

import pytest

from skysift.config import POLICIES, DetectionConfig, config_from_json, config_to_json


def test_defaults_and_overrides_do_not_mutate():
    base = DetectionConfig()
    master = base.for_master()
    assert (master.grow_sigma_multiplier, master.edge_margin_pixels, master.void_proximity_radius) == (2.25, 5, 5)
    assert base.grow_sigma_multiplier == 3.0 and base.for_quality().grow_sigma_multiplier == 3.0
    assert base.strict_exposure_kinematics and not base.enable_local_activity_clusters
    with pytest.raises(dataclasses.FrozenInstanceError):
        base.max_star_jitter = 2


def test_json_round_trip_and_alias():
    assert config_from_json('{"maxElongationForFwhm": 1.7}').quality_max_elongation_for_fwhm == 1.7
    changed = dataclasses.replace(DetectionConfig(), max_star_jitter=3.25)
    assert config_from_json(config_to_json(changed)) == changed
    assert "minBackgroundDeviationADU" in json.loads(config_to_json(changed))
    with pytest.raises(ValueError):
        config_from_json('{"nope": 1}')


def test_policies():
    assert set(POLICIES) == {"CONSERVATIVE", "BALANCED", "AGGRESSIVE"}
    assert POLICIES["AGGRESSIVE"].prefer_lower_sigma and POLICIES["AGGRESSIVE"].max_ratio == 0.12
