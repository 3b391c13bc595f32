"""Panel analytics for dense spatio-temporal activity data, expressed as Spark DataFrame operators."""

from cellpulse.settings import CITY_2013, PanelSpec, SplitRange

__all__ = ["CITY_2013", "PanelSpec", "SplitRange"]
