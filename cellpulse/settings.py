"""The typed parameter tree every operator reads.

One frozen dataclass holds the panel geometry, so the same operators run on 10-minute call records,
hourly events or daily orders. Inconsistent geometry is refused when the object is built, which is
before any Spark job starts.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any


class SpecError(ValueError):
    """A parameter is unknown, missing or contradicts another one."""


@dataclass(frozen=True)
class SplitRange:
    """A named range of local dates, both ends included."""

    name: str
    start: dt.date
    end: dt.date

    def __post_init__(self) -> None:
        if self.end < self.start:
            raise SpecError(f"split {self.name}: {self.end} is before {self.start}")

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1


@dataclass(frozen=True)
class PanelSpec:
    """Geometry of a dense area x time panel."""

    start: dt.date
    end: dt.date
    step_seconds: int
    daily: int
    weekly: int
    n_areas: int
    tz: str = "UTC"
    origin: dt.datetime | None = None
    grid_side: int = 100
    null_fill: float = 0.0
    max_gap: int = 3
    mape_floor: float = 1.0
    splits: tuple[SplitRange, ...] = ()
    fixed_areas: tuple[int, ...] = ()
    lags: tuple[int, ...] = (1,)
    rolling: tuple[int, ...] = ()
    seeds: tuple[int, ...] = (0, 1, 2)
    holidays: tuple[tuple[dt.date, str, str, str], ...] = field(default=(), repr=False)

    def __post_init__(self) -> None:
        if self.end < self.start:
            raise SpecError("the period ends before it starts")
        if min(self.step_seconds, self.daily, self.weekly, self.n_areas) < 1:
            raise SpecError("step, periods and area count must be positive")
        if self.weekly % self.daily:
            raise SpecError(f"weekly period {self.weekly} is not a multiple of the daily period {self.daily}")
        if self.weekly != self.daily * 7 and self.daily > 1:
            raise SpecError("a week must hold seven days")
        if self.step_seconds * self.daily != 86_400:
            raise SpecError(f"{self.daily} steps of {self.step_seconds} s do not make a day")
        self._check_splits()

    def _check_splits(self) -> None:
        previous: SplitRange | None = None
        for part in self.splits:
            if part.start < self.start or part.end > self.end:
                raise SpecError(f"split {part.name} leaves the period {self.start}..{self.end}")
            if previous and part.start <= previous.end:
                raise SpecError(f"splits {previous.name} and {part.name} overlap")
            if previous and part.start != previous.end + dt.timedelta(days=1):
                raise SpecError(f"days are missing between {previous.name} and {part.name}")
            previous = part

    @property
    def n_days(self) -> int:
        return (self.end - self.start).days + 1

    @property
    def n_steps(self) -> int:
        return self.n_days * self.daily

    @property
    def t0(self) -> dt.datetime:
        """UTC instant of ``t_index`` 0; local midnight of the first day unless given."""
        if self.origin is not None:
            return self.origin
        from zoneinfo import ZoneInfo

        local = dt.datetime.combine(self.start, dt.time(), tzinfo=ZoneInfo(self.tz))
        return local.astimezone(dt.timezone.utc).replace(tzinfo=None)

    @property
    def samples_per_hour(self) -> float:
        return 3600.0 / self.step_seconds

    def split(self, name: str) -> SplitRange:
        for part in self.splits:
            if part.name == name:
                return part
        raise SpecError(f"no split named {name}; there are {[p.name for p in self.splits]}")

    def but(self, **changes: Any) -> PanelSpec:
        """A copy with some values replaced, checked again."""
        return dataclasses.replace(self, **changes)

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any]) -> PanelSpec:
        """Build from a plain mapping (YAML or JSON); unknown or missing keys are errors."""
        known = {f.name: f for f in dataclasses.fields(cls)}
        unknown = sorted(set(values) - set(known))
        if unknown:
            raise SpecError(f"unknown keys: {unknown}")
        required = {
            name
            for name, f in known.items()
            if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING
        }
        absent = sorted(required - set(values))
        if absent:
            raise SpecError(f"missing keys: {absent}")
        clean = dict(values)
        for key in ("start", "end"):
            clean[key] = _as_date(clean[key])
        if "splits" in clean:
            clean["splits"] = tuple(
                SplitRange(name, _as_date(a), _as_date(b)) for name, (a, b) in dict(clean["splits"]).items()
            )
        for key in ("fixed_areas", "lags", "rolling", "seeds"):
            if key in clean:
                clean[key] = tuple(clean[key])
        return cls(**clean)


def _as_date(value: Any) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value))


# The published study period, its splits and feature lags.
CITY_HOLIDAYS: tuple[tuple[dt.date, str, str, str], ...] = (
    (dt.date(2013, 11, 1), "Ognissanti (All Saints)", "national", ""),
    (dt.date(2013, 12, 7), "Sant'Ambrogio", "milan", ""),
    (dt.date(2013, 12, 8), "Immacolata Concezione", "national", ""),
    (dt.date(2013, 12, 24), "Vigilia di Natale (Christmas Eve)", "observance", ""),
    (dt.date(2013, 12, 25), "Natale (Christmas Day)", "national", ""),
    (dt.date(2013, 12, 26), "Santo Stefano (St Stephen's Day)", "national", ""),
    (dt.date(2013, 12, 31), "San Silvestro (New Year's Eve)", "observance", ""),
    (dt.date(2014, 1, 1), "Capodanno (New Year's Day)", "national", ""),
)

CITY_2013 = PanelSpec(
    start=dt.date(2013, 11, 1),
    end=dt.date(2014, 1, 1),
    step_seconds=600,
    daily=144,
    weekly=1008,
    n_areas=10_000,
    tz="Europe/Rome",
    splits=(
        SplitRange("train", dt.date(2013, 11, 1), dt.date(2013, 12, 8)),
        SplitRange("validation", dt.date(2013, 12, 9), dt.date(2013, 12, 15)),
        SplitRange("test", dt.date(2013, 12, 16), dt.date(2013, 12, 22)),
        SplitRange("stress", dt.date(2013, 12, 23), dt.date(2014, 1, 1)),
    ),
    fixed_areas=(4159, 4556),
    lags=(1, 2, 3, 6, 12, 144, 145, 288, 1008),
    rolling=(6, 36, 144),
    holidays=CITY_HOLIDAYS,
)
