"""The forecast configuration."""

from __future__ import annotations

from dataclasses import dataclass

from panelcast.functions.freq import season_length

_CHOICES = {"quantile_mode": ("best_effort", "strict"), "model_selection": ("all", "fast", "accurate")}


@dataclass(frozen=True)
class ForecastConfig:
    """Horizon ``h`` and how to forecast; ``quick`` and ``strict`` are ready-made."""

    h: int
    freq: str = "D"
    ensemble_method: str = "median"
    min_tsfm: int = 1
    quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)
    quantile_mode: str = "best_effort"
    device: str = "auto"
    batch_size: int = 32
    context_length: int | None = None
    prediction_length_limit: int | None = None
    strict_length_limits: bool = False
    max_models: int | None = None
    model_selection: str = "all"
    parallel_fit: bool = True
    parallel_predict: bool = True
    max_workers: int | None = None

    def __post_init__(self) -> None:
        least = {"h": 1, "min_tsfm": 1, "max_models": 1}
        for name, low in least.items():
            value = getattr(self, name)
            if value is not None and value < low:
                raise ValueError(f"{name} must be at least {low}, got {value}")
        for name, allowed in _CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}; got {getattr(self, name)!r}")

    @classmethod
    def quick(cls, h: int, freq: str = "D") -> ForecastConfig:
        return cls(h=h, freq=freq)

    @classmethod
    def strict(cls, h: int, freq: str = "D") -> ForecastConfig:
        return cls(h=h, freq=freq, min_tsfm=1)

    @property
    def season_length(self) -> int | None:
        return season_length(self.freq)
