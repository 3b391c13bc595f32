import datetime as dt

import pytest

from cellpulse import CITY_2013, PanelSpec, SplitRange
from cellpulse.settings import SpecError


def test_published_geometry():
    assert (CITY_2013.n_days, CITY_2013.n_steps) == (62, 8928)
    assert CITY_2013.t0 == dt.datetime(2013, 10, 31, 23)
    assert [p.days * 144 for p in CITY_2013.splits] == [5472, 1008, 1008, 1440]


def test_overlapping_and_gapped_splits_are_refused():
    with pytest.raises(SpecError, match="overlap"):
        CITY_2013.but(splits=(SplitRange("a", dt.date(2013, 11, 1), dt.date(2013, 11, 9)), SplitRange("b", dt.date(2013, 11, 9), dt.date(2013, 11, 12))))
    with pytest.raises(SpecError, match="missing"):
        CITY_2013.but(splits=(SplitRange("a", dt.date(2013, 11, 1), dt.date(2013, 11, 9)), SplitRange("b", dt.date(2013, 11, 11), dt.date(2013, 11, 12))))
    with pytest.raises(SpecError, match="leaves"):
        CITY_2013.but(splits=(SplitRange("a", dt.date(2013, 10, 1), dt.date(2013, 11, 9)),))


def test_inconsistent_periods_are_refused():
    with pytest.raises(SpecError):
        CITY_2013.but(daily=100)
    with pytest.raises(SpecError):
        CITY_2013.but(weekly=1000)


def test_mapping_with_unknown_or_missing_keys():
    good = {"start": "2024-01-01", "end": "2024-01-30", "step_seconds": 3600, "daily": 24, "weekly": 168, "n_areas": 5, "splits": {"train": ["2024-01-01", "2024-01-10"]}}
    assert PanelSpec.from_mapping(good).splits[0].days == 10
    with pytest.raises(SpecError, match="unknown"):
        PanelSpec.from_mapping({**good, "colour": 1})
    with pytest.raises(SpecError, match="missing"):
        PanelSpec.from_mapping({k: v for k, v in good.items() if k != "daily"})
