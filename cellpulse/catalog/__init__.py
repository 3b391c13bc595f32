"""Every operator as a query over the test tables."""

from cellpulse.catalog import distribution, features, forecast, kpi, models, panel, series, sources  # noqa: F401
from cellpulse.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
