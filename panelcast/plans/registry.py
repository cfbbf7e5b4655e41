"""Registered models and their limits."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class ModelSpec:
    """What planning needs to know of a model; ``provider`` names its provider or baseline."""

    name: str
    provider: str
    config_fields: dict[str, Any] = field(default_factory=dict)
    requires: tuple[str, ...] = ()
    is_tsfm: bool = True
    min_context_length: int | None = None
    max_context_length: int | None = None
    max_prediction_length: int | None = None
    pad_to_min_context: bool = True
    truncate_to_max_context: bool = True


# The models' published names, packages and limits.
REGISTRY: dict[str, ModelSpec] = {
    s.name: s
    for s in (
        ModelSpec("chronos", "panelcast.plans.pretrained:Chronos", {"model_name": "amazon/chronos-2"}, ("chronos", "torch"), max_context_length=8192, max_prediction_length=1024, pad_to_min_context=False),
        ModelSpec("timesfm", "panelcast.plans.pretrained:TimesFM", {}, ("timesfm", "torch"), min_context_length=993, max_context_length=15360, max_prediction_length=1024),
        ModelSpec("moirai", "panelcast.plans.pretrained:Moirai", {"model_name": "Salesforce/moirai-2.0-R-small"}, ("uni2ts", "gluonts", "torch"), max_context_length=4096, pad_to_min_context=False),
        ModelSpec("patchtst_fm", "panelcast.plans.pretrained:PatchTST", {"model_name": "ibm-research/patchtst-fm-r1"}, ("tsfm_public", "torch"), truncate_to_max_context=False),
        ModelSpec("naive", "baseline", is_tsfm=False),
        ModelSpec("seasonal_naive", "baseline", is_tsfm=False),
    )
}

#: Providers a user has registered: name to provider object.
PROVIDERS: dict[str, Any] = {}


def register(provider: Any) -> None:
    """Add a model provider; it takes part in plans under its name."""
    REGISTRY[provider.name] = provider.spec
    PROVIDERS[provider.name] = provider


def unregister(name: str) -> None:
    if PROVIDERS.pop(name, None) is not None:
        REGISTRY.pop(name, None)


def list_models(tsfm_only: bool = False) -> list[str]:
    return [n for n, s in REGISTRY.items() if s.is_tsfm or not tsfm_only]


def get_spec(name: str) -> ModelSpec:
    if name not in REGISTRY:
        raise KeyError(f"Unknown model {name!r}; registered: {', '.join(REGISTRY)}")
    return REGISTRY[name]
