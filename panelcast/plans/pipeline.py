"""Fit, predict and forecast. Models are branches of one plan; series are its parallelism."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from panelcast.config import ForecastConfig
from panelcast.errors import EInsufficient, ENoTSFM
from panelcast.functions.lengths import validate_prediction_length
from panelcast.operators import providers as P
from panelcast.operators.baselines import BASELINES
from panelcast.operators.ensemble import ensemble_with_quantiles, quantile_name
from panelcast.operators.panel import CovariateSet, TSDataset, build_dataset, validate
from panelcast.operators.shared import checkpointed
from panelcast.plans.cache import ModelCache, provider_of
from panelcast.plans.planner import make_plan
from panelcast.plans.registry import ModelSpec
from panelcast.results import ForecastResult


@dataclass(frozen=True)
class Fitted:
    """A model ready to predict, or the error that kept it from it. Stateless models are ready too."""

    spec: ModelSpec
    provider: Any = None
    error: Exception | None = None

    @property
    def ok(self) -> bool:
        return self.error is None


def fit(spec: ModelSpec, dataset: TSDataset, device: str | None = None) -> Fitted:
    """Nothing is trained: checks that the model's packages are there. Raises what goes wrong."""
    if spec.provider == "baseline":
        return Fitted(spec)
    import importlib.util

    from panelcast.plans.registry import PROVIDERS

    if spec.name not in PROVIDERS:
        missing = [p for p in spec.requires if importlib.util.find_spec(p) is None]
        if missing:
            raise ImportError(f"{spec.name} needs {', '.join(missing)}")
    return Fitted(spec, provider_of(spec))


def predict(fitted: Fitted, dataset: TSDataset, h: int, quantiles: Sequence[float] = (), batch_size: int = 32, device: str = "cpu") -> DataFrame:
    """One model's lazy forecast (unique_id, ds, yhat, q...)."""
    if fitted.spec.name in BASELINES and fitted.provider is None:
        return BASELINES[fitted.spec.name](dataset, h)
    return P.predict(fitted.provider, dataset, h, quantiles, batch_size, device, ModelCache.generation)


def fit_all(models: Sequence[ModelSpec], dataset: TSDataset, device: str | None = None) -> list[Fitted]:
    """One entry a model, in order; failures are recorded in it."""
    out = []
    for spec in models:
        try:
            out.append(fit(spec, dataset, device))
        except Exception as e:  # noqa: BLE001  one model's failure must not end the run
            out.append(Fitted(spec, error=e))
    return out


def fit_all_parallel(models: Sequence[ModelSpec], dataset: TSDataset, device: str | None = None, max_workers: int | None = None) -> list[Fitted]:
    """As ``fit_all``: there is nothing on the driver to run in parallel."""
    return fit_all(models, dataset, device)


def predict_all(models: Sequence[ModelSpec], artifacts: Sequence[Fitted], dataset: TSDataset, h: int, quantiles: Sequence[float] = (), batch_size: int = 32, device: str = "cpu", errors: list[dict[str, str]] | None = None) -> list[DataFrame]:
    """The forecasts of the models that succeed, in the models' order.

    Provider branches are materialised in the shared folder, so that one that fails can be left out
    (and noted in ``errors``) and none runs twice.
    """
    out = []
    for spec, fitted in zip(models, artifacts):
        try:
            if not fitted.ok:
                raise fitted.error
            frame = predict(fitted, dataset, h, quantiles, batch_size, device)
            out.append(frame if fitted.provider is None else checkpointed(frame))
        except Exception as e:  # noqa: BLE001  see fit_all
            if errors is not None:
                errors.append({"model": spec.name, "error": f"{type(e).__name__}: {e}"[:2000]})
    return out


def predict_all_parallel(models, artifacts, dataset, h, quantiles=(), batch_size=32, max_workers=None, device="cpu", errors=None) -> list[DataFrame]:
    """As ``predict_all``: every branch already runs on the whole cluster."""
    return predict_all(models, artifacts, dataset, h, quantiles, batch_size, device, errors)


def check_horizons(models: Sequence[ModelSpec], config: ForecastConfig) -> None:
    """ValueError, before anything runs, if models would forecast horizons of different length."""
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        steps = {s.name: validate_prediction_length(config.h, s, config.strict_length_limits) for s in models}
    if config.prediction_length_limit is None and len(set(steps.values())) > 1:
        raise ValueError(f"Horizon {config.h} exceeds some models' limits, so their forecasts would differ in length: {steps}")


def run_forecast(data: Any, config: ForecastConfig, covariates: CovariateSet | None = None) -> ForecastResult:
    """Validate, plan, predict with every pretrained model, and combine."""
    dataset = build_dataset(validate(data, config), config, covariates)
    models = make_plan(tsfm_only=True, dataset=dataset, config=config)
    fitted = fit_all(models, dataset, config.device)
    ready = [f for f in fitted if f.ok]
    errors = [{"model": f.spec.name, "error": str(f.error)} for f in fitted if not f.ok]
    if not ready:
        raise ENoTSFM("No pretrained model could be loaded", context={"errors": errors})
    check_horizons([f.spec for f in ready], config)
    levels = tuple(dict.fromkeys(float(q) for q in config.quantiles))
    found = predict_all([f.spec for f in ready], ready, dataset, config.h, levels, config.batch_size, config.device, errors)
    if len(found) < config.min_tsfm:
        raise EInsufficient(f"Insufficient models succeeded: {len(found)} < {config.min_tsfm}", context={"errors": errors})
    combined = ensemble_with_quantiles(found, config.ensemble_method, levels, config.quantile_mode)
    return ForecastResult(combined, f"ensemble_{config.ensemble_method}", config, tuple(errors))


def forecast(data: Any, h: int, freq: str = "D", **options: Any) -> ForecastResult:
    """``run_forecast`` with a configuration made of the arguments."""
    return run_forecast(data, ForecastConfig(h=h, freq=freq, **options))


__all__ = ["Fitted", "fit", "fit_all", "fit_all_parallel", "forecast", "predict", "predict_all", "predict_all_parallel", "quantile_name", "run_forecast"]
