"""Customer segmentation over transaction tables, expressed as Spark DataFrames."""

from patronmap.settings import AutoK, SegmentRules, Settings, Weights

__all__ = ["AutoK", "SegmentRules", "Settings", "Weights"]
