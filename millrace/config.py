"""Settings: closed, frozen groups with defaults, read from YAML once per path."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass
from functools import cache
from pathlib import Path


@dataclass(frozen=True)
class Cluster:
    threshold: float = 0.72
    time_window_days: int = 7
    top_k: int = 20
    semantic: bool = False
    fail_open: bool = True
    candidate_threshold: float = 0.45
    similarity_threshold: float = 0.92093


@dataclass(frozen=True)
class Lifecycle:
    official_authority: float = 0.95
    company_authority: float = 0.85
    corroborated_sources: int = 2
    evidence_gain: float = 0.18
    new_source_bonus: float = 0.07
    official_bonus: float = 0.25
    clarification_bonus: float = 0.05
    dispute_factor: float = 0.70


@dataclass(frozen=True)
class Learning:
    low_confidence: float = 0.65
    high_severity: float = 0.65
    min_feedback: int = 3
    min_f1_gain: float = 0.01
    max_critical_regression: float = 0.0
    human_approval: bool = True


@dataclass(frozen=True)
class EvidenceGate:
    min_sources: int = 2
    official_authority: float = 0.95


@dataclass(frozen=True)
class Runtime:
    min_workers: int = 1
    max_workers: int = 4
    scale_up_depth: int = 500
    scale_down_depth: int = 50
    degrade_after: int = 3
    stop_after: int = 5
    backoff_seconds: tuple[int, ...] = (30, 120, 300)


@dataclass(frozen=True)
class Routing:
    top_k: int = 3
    exact_alias: bool = True
    vector_route: bool = True
    score_threshold: float = 0.426251
    margin_threshold: float = 0.035125
    min_alias_chars: int = 2


@dataclass(frozen=True)
class Pairs:
    negative_ratio: float = 1.0
    max_positive_per_group: int = 20
    time_window_days: int = 7
    lead_chars: int = 240
    seed: int = 42


@dataclass(frozen=True)
class Splits:
    time_train_ratio: float = 0.8
    group_holdout_ratio: float = 0.2
    seed: int = 42


@dataclass(frozen=True)
class HardExamples:
    subject_margin: float = 0.05
    event_margin: float = 0.05
    max_examples: int = 5000


@dataclass(frozen=True)
class Settings:
    cluster: Cluster = field(default_factory=Cluster)
    lifecycle: Lifecycle = field(default_factory=Lifecycle)
    learning: Learning = field(default_factory=Learning)
    evidence_gate: EvidenceGate = field(default_factory=EvidenceGate)
    runtime: Runtime = field(default_factory=Runtime)
    routing: Routing = field(default_factory=Routing)
    pairs: Pairs = field(default_factory=Pairs)
    splits: Splits = field(default_factory=Splits)
    hard_examples: HardExamples = field(default_factory=HardExamples)


DEFAULTS = Settings()


def build(kind, values: dict):
    """An instance of a settings class; keys that it doesn't have are refused."""
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise ValueError(f"{kind.__name__} has no setting {', '.join(unknown)}")
    default = kind()
    return kind(**{k: build(type(held), v) if is_dataclass(held := getattr(default, k)) else tuple(v) if isinstance(v, list) else v for k, v in values.items()})


@cache
def load_settings(path: str) -> Settings:
    """The settings of a YAML file over the defaults; read once per path."""
    import yaml

    return build(Settings, yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})


def load_env(path: str = ".env") -> dict[str, str]:
    """Set KEY=VALUE lines of a file, never over a variable that is set; what was set. A missing file sets nothing."""
    added: dict[str, str] = {}
    file = Path(path)
    for line in file.read_text(encoding="utf-8").splitlines() if file.exists() else ():
        name, sign, value = line.strip().partition("=")
        if sign and name and not name.startswith("#") and name.strip() not in os.environ:
            added[name.strip()] = os.environ[name.strip()] = value.strip().strip("\"'")
    return added
