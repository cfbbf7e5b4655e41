"""Which models run, and in which order."""

from __future__ import annotations

from panelcast.config import ForecastConfig
from panelcast.errors import ENoTSFM
from panelcast.plans.registry import REGISTRY, ModelSpec

# Models from fastest to slowest, and from most to least accurate.
BY_SPEED = ("timesfm", "chronos", "moirai", "patchtst_fm")
BY_ACCURACY = ("moirai", "chronos", "timesfm", "patchtst_fm")


def make_plan(tsfm_only: bool = True, dataset=None, config: ForecastConfig | None = None) -> list[ModelSpec]:
    """The models to run: by preference if asked, unranked ones last, then the first ``max_models``."""
    plan = [s for s in REGISTRY.values() if s.is_tsfm or not tsfm_only]
    if tsfm_only and not plan:
        raise ENoTSFM("No pretrained model is registered")
    order = {"fast": BY_SPEED, "accurate": BY_ACCURACY}.get(config.model_selection if config else "all")
    if order:
        plan.sort(key=lambda s: order.index(s.name) if s.name in order else len(order))
    return plan[: config.max_models] if config else plan
