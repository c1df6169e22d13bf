"""Parameters of the trace engine."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Grouping dimensions and, in order of priority, the tags that name them.
TAG_KEYS: dict[str, list[str]] = {
    "service_identity": ["service_identity", "serviceIdentity", "serviceName", "localServiceName", "service_name", "istio.canonical_service"],
    "scope1": ["scope1", "scope_1", "scope-1"],
    "scope2": ["scope2", "scope_2", "scope-2"],
    "scope3": ["scope3", "scope_3", "scope-3"],
    "env": ["environment", "env"],
    "feature_group": ["feature_group", "featureGroup"],
    "feature_name": ["feature_name", "featureName"],
    "sub_service": ["sub_service", "subService", "subservice"],
}
OPERATION_KEYS = ["operation", "operation_name"]
SERVICE_NAME_KEYS = ["service_name", "serviceName", "localServiceName"]
DIMENSIONS = [*TAG_KEYS, "operation"]
# Variants of the baseline and numbers of samples before they speak.
VARIANTS = ["cumulative", "ewma", "sliding_window", "exponential_decay", "same_time_yesterday"]
THRESHOLDS = [50, 100, 500, 5000]

MINUTE_US = 60_000_000
HOUR_US = 60 * MINUTE_US


@dataclass(frozen=True)
class Config:
    """Defaults of the engine; empty tag lists fall back to the built-in ones."""

    tag_keys: dict[str, list[str]] = field(default_factory=dict)
    identity_fields: tuple[str, ...] = tuple(DIMENSIONS)
    anomaly_threshold: float = 3.5
    rare_threshold: float = 0.3
    baseline_pct: float = 0.75
    active: str = "cumulative:50"
    hot_minutes: int = 15
    warm_minutes: int = 60
    important_factor: int = 10
    assembly_window_s: int = 180
    #: Wall clock in microseconds; traces that start over five minutes after it move no clock and fill no hour. None: no such check.
    wall_us: int | None = None

    def keys(self, dim: str) -> list[str]:
        return self.tag_keys.get(dim) or TAG_KEYS[dim]

    def with_tags(self, **lists: list[str]) -> Config:
        return replace(self, tag_keys={**self.tag_keys, **lists})


def combinations() -> list[str]:
    """All ``variant:threshold`` combinations."""
    return [f"{v}:{t}" for v in VARIANTS for t in THRESHOLDS]


def parse_combination(text: str) -> tuple[str, int]:
    """Variant and threshold of a combination; an unknown one raises ValueError."""
    variant, _, n = text.strip().partition(":")
    if variant not in VARIANTS or not n.isdigit() or int(n) not in THRESHOLDS:
        raise ValueError(f"no such combination: {text!r}")
    return variant, int(n)


def select_combinations(which: str, active: str) -> list[str]:
    """``all``, ``active`` or a list with commas; repeated ones once, the active one always."""
    which = which.strip()
    if which == "all":
        return combinations()
    out = [] if which == "active" else [":".join(map(str, parse_combination(x))) for x in which.split(",") if x.strip()]
    return list(dict.fromkeys([*out, active]))
