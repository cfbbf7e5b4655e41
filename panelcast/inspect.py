"""What is registered and what can run here."""

from __future__ import annotations

import importlib.util
from dataclasses import dataclass

from panelcast.plans.registry import PROVIDERS, REGISTRY, list_models


@dataclass(frozen=True)
class HealthReport:
    tsfm_available: list[str]
    tsfm_missing: list[str]
    baselines_available: bool
    all_ok: bool

    def __str__(self) -> str:
        lines = ["Panelcast health report", "-" * 40, f"TSFMs available: {', '.join(self.tsfm_available) or 'None'}"]
        if self.tsfm_missing:
            lines.append(f"TSFMs missing: {', '.join(self.tsfm_missing)}")
        return "\n".join([*lines, f"Baselines available: {self.baselines_available}", f"Overall: {'OK' if self.all_ok else 'Issues detected'}"])


def check_health() -> HealthReport:
    """A model is available if its packages can be imported here or a provider is registered for it."""
    there = {n: n in PROVIDERS or all(importlib.util.find_spec(p) is not None for p in REGISTRY[n].requires) for n in list_models(tsfm_only=True)}
    baselines = all(n in REGISTRY for n in ("naive", "seasonal_naive"))
    return HealthReport([n for n, ok in there.items() if ok], [n for n, ok in there.items() if not ok], baselines, any(there.values()))
