"""Campaign-response analytics as Spark DataFrame operators."""

from canvass.spec import CAMPAIGN, FeatureSpec

__all__ = ["CAMPAIGN", "FeatureSpec"]
