"""The analysis policy: every threshold of the detectors, with its bounds."""

from __future__ import annotations

from dataclasses import dataclass, fields

#: Bounds of the settings, as users of the pipeline know them.
BOUNDS = {
    "baseline_days": (7, 90),
    "minimum_days": (2, 28),
    "minimum_peer_hosts": (3, 1000),
    "peer_common_fraction": (0.01, 1),
    "process_days": (1, 30),
    "closed_finding_days": (7, 730),
    "dedup_hours": (6, 168),
    "maximum_contexts_per_host_day": (50, 100_000),
    "min_fleet_hosts": (20, 10_000),
    "min_common_app_hosts": (5, 1000),
    "rare_app_fraction": (0.001, 0.1),
    "rare_relation_fraction": (0.001, 0.2),
}


@dataclass(frozen=True)
class Policy:
    baseline_days: int = 28
    minimum_days: int = 7
    minimum_peer_hosts: int = 10
    peer_common_fraction: float = 0.1
    process_days: int = 7
    closed_finding_days: int = 90
    dedup_hours: int = 48
    maximum_contexts_per_host_day: int = 2000
    min_fleet_hosts: int = 50
    min_common_app_hosts: int = 15
    rare_app_fraction: float = 0.01
    rare_relation_fraction: float = 0.02
    behavioral_enabled: bool = True
    execution_enabled: bool = False
    contextual_enabled: bool = False

    def checked(self) -> Policy:
        """The policy itself, if all settings are within their bounds."""
        for f in fields(self):
            low, high = BOUNDS.get(f.name, (None, None))
            if low is not None and not low <= getattr(self, f.name) <= high:
                raise ValueError(f"{f.name} must be between {low} and {high}")
        if self.minimum_days > self.baseline_days:
            raise ValueError("minimum_days must fit into baseline_days")
        return self


DEFAULT = Policy()
