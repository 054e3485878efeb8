"""Settings with their defaults, as frozen dataclasses; ``load`` reads a YAML file over them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class AnomalyParams:
    zscore_threshold: float = 3.0
    contamination: float = 0.05  # shifts forest scores by a constant, which min-max scaling removes
    risk_score_high: float = 70.0
    risk_score_medium: float = 40.0
    target_fpr: float = 0.01
    isolation_weight: float = 0.55
    zscore_weight: float = 0.45
    random_state: int = 42


@dataclass(frozen=True)
class FeatureParams:
    windows: tuple[int, ...] = (5, 15, 60)
    session_gap_minutes: int = 30
    min_events_for_entropy: int = 3
    velocity_cap: float = 1000.0


@dataclass(frozen=True)
class AlertParams:
    webhook_url: str = ""
    rate_limit_per_minute: int = 60
    dedup_window_seconds: float = 300.0
    retry_attempts: int = 3
    retry_backoff_seconds: float = 5.0


@dataclass(frozen=True)
class ModelParams:
    model_version: str = "1.0.0"
    n_estimators: int = 200
    max_samples: int = 256


@dataclass(frozen=True)
class ClusterParams:
    min_shared_signals: int = 1
    temporal_window_hours: float = 24.0
    risk_threshold: float = 60.0
    #: Signal values that link nobody, such as placeholder device ids; none by default.
    exclude_signals: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    anomaly_detection: AnomalyParams = field(default_factory=AnomalyParams)
    feature_engineering: FeatureParams = field(default_factory=FeatureParams)
    alerting: AlertParams = field(default_factory=AlertParams)
    model: ModelParams = field(default_factory=ModelParams)
    clusters: ClusterParams = field(default_factory=ClusterParams)


#: Names that a configuration file uses for fields of another name here.
_ALIASES = {
    "rolling_windows": "windows",
    "isolation_forest_weight": "isolation_weight",
    "rate_limit": "rate_limit_per_minute",
    "dedup_window": "dedup_window_seconds",
}


def from_dict(raw: dict) -> Config:
    """Known keys replace defaults; unknown ones are ignored."""
    config = Config()
    for section in fields(Config):
        given = {_ALIASES.get(k, k): v for k, v in (raw.get(section.name) or {}).items()}
        known = {f.name for f in fields(getattr(config, section.name))}
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known and v != "auto"}
        config = replace(config, **{section.name: replace(getattr(config, section.name), **values)})
    return config


def load(path: str | Path) -> Config:
    """Reads a YAML file; a missing one raises FileNotFoundError."""
    text = Path(path).read_text(encoding="utf-8")
    import yaml

    return from_dict(yaml.safe_load(text) or {})
