"""What a forecast run returns."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.config import ForecastConfig


@dataclass(frozen=True)
class ForecastResult:
    """A lazy forecast frame (unique_id, ds, yhat, q...), the model's name, the configuration."""

    df: DataFrame
    model_name: str
    config: ForecastConfig | None = None
    model_errors: tuple[dict[str, str], ...] = ()

    def get_series(self, unique_id: Any) -> DataFrame:
        return self.df.filter(F.col("unique_id") == F.lit(unique_id))

    @property
    def point_forecast(self) -> DataFrame:
        return self.df.select(*[c for c in ("unique_id", "ds", "yhat") if c in self.df.columns])


@dataclass
class RunResult:
    """A forecast with the run's metadata."""

    forecast: ForecastResult
    duration_ms: float
    model_used: str
    backtest_metrics: dict[str, float] | None = None
    model_errors: list[dict[str, str]] = field(default_factory=list)

    def to_dataframe(self) -> DataFrame:
        return self.forecast.df

    def summary(self) -> dict[str, Any]:
        """Counts the forecast's rows, so it runs the plan."""
        shape = (self.forecast.df.count(), len(self.forecast.df.columns))
        return {"model": self.model_used, "duration_ms": round(self.duration_ms, 2), "model_errors": len(self.model_errors), "forecast_shape": shape}
