"""Settings of an analysis: weights, scaler, algorithm, k range and label thresholds.

Plain frozen dataclasses that are passed to operators; nothing here touches Spark.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace

# Scaler and algorithm names.
STANDARD_SCALER = "StandardScaler"
MINMAX_SCALER = "MinMaxScaler"
KMEANS = "K-Means"
DBSCAN = "DBSCAN"
HIERARCHICAL = "Hierarchical"
HIERARCHICAL_LONG = "Hierarchical (Agglomerative)"


@dataclass(frozen=True)
class Weights:
    """Importance of recency, frequency and monetary value; a missing one counts 1."""

    R: float = 1.0
    F: float = 1.0
    M: float = 1.0

    @classmethod
    def of(cls, given: Weights | Mapping[str, float] | None) -> Weights:
        if isinstance(given, Weights):
            return given
        known = {k: float(v) for k, v in (given or {}).items() if k in ("R", "F", "M")}
        return cls(**known)


@dataclass(frozen=True)
class SegmentRules:
    """Label thresholds, as shares of the highest reachable weighted score."""

    # Default thresholds.
    vip_r_min: float = 0.8
    vip_fm_min: float = 0.8
    loyal_r_min: float = 0.8
    loyal_fm_min: float = 0.6
    potential_r_min: float = 0.6
    potential_fm_min: float = 0.6
    risk_r_max: float = 0.4
    risk_fm_min: float = 0.7
    lost_r_max: float = 0.4
    lost_fm_max: float = 0.4
    new_r_min: float = 0.8
    new_fm_max: float = 0.4

    @classmethod
    def of(cls, given: SegmentRules | Mapping[str, float] | None) -> SegmentRules:
        if isinstance(given, SegmentRules):
            return given
        names = {f.name for f in fields(cls)}
        return cls(**{k: float(v) for k, v in (given or {}).items() if k in names})


@dataclass(frozen=True)
class AutoK:
    """Range of cluster counts to try; a reversed range is turned around."""

    k_min: int = 2
    k_max: int = 10

    def __post_init__(self) -> None:
        low, high = sorted((int(self.k_min), int(self.k_max)))
        object.__setattr__(self, "k_min", low)
        object.__setattr__(self, "k_max", high)

    @classmethod
    def of(cls, given: AutoK | Mapping[str, int] | None) -> AutoK:
        if isinstance(given, AutoK):
            return given
        return cls(**{k: v for k, v in (given or {}).items() if k in ("k_min", "k_max")})

    def values(self) -> range:
        return range(self.k_min, self.k_max + 1)


@dataclass(frozen=True)
class Settings:
    rfm_weights: Weights = field(default_factory=Weights)
    default_scaler: str = STANDARD_SCALER
    auto_k: AutoK = field(default_factory=AutoK)
    segmentation_default_algorithm: str = KMEANS
    segment_rules: SegmentRules = field(default_factory=SegmentRules)

    def __post_init__(self) -> None:
        if self.segmentation_default_algorithm == HIERARCHICAL_LONG:
            object.__setattr__(self, "segmentation_default_algorithm", HIERARCHICAL)

    @classmethod
    def from_dict(cls, given: Mapping[str, object] | None = None) -> Settings:
        """Defaults overlaid with `given`; nested groups are merged key by key, unknown keys ignored."""
        given = dict(given or {})
        base = cls()
        return replace(
            base,
            rfm_weights=Weights.of(given.get("rfm_weights")),
            default_scaler=given.get("default_scaler", base.default_scaler),
            auto_k=AutoK.of(given.get("auto_k")),
            segmentation_default_algorithm=given.get(
                "segmentation_default_algorithm", base.segmentation_default_algorithm
            ),
            segment_rules=SegmentRules.of(given.get("segment_rules")),
        )

    def to_dict(self) -> dict[str, object]:
        return asdict(self)
