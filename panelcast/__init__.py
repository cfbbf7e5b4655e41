"""Probabilistic forecasts of time-series panels on Spark.

Names are imported on first use: a worker that runs one operator does not load all the others.
"""

import importlib

_HOMES = {
    "config": ("ForecastConfig",),
    "errors": ("EContract", "EInsufficient", "ENoTSFM", "ETemporal", "PanelcastError"),
    "functions.lengths": ("LengthAdjustment", "adjust_context_length", "check_data_compatibility", "get_effective_limits", "validate_prediction_length"),
    "inspect": ("HealthReport", "check_health"),
    "operators.ensemble": ("ensemble",),
    "operators.panel": ("CovariateSet", "TSDataset", "build_dataset", "validate"),
    "plans.cache": ("ModelCache",),
    "plans.device": ("resolve_device",),
    "plans.pipeline": ("fit", "fit_all", "fit_all_parallel", "forecast", "predict", "predict_all", "predict_all_parallel", "run_forecast"),
    "plans.planner": ("make_plan",),
    "plans.registry": ("REGISTRY", "ModelSpec", "get_spec", "list_models", "register"),
    "results": ("ForecastResult", "RunResult"),
    "streaming": ("ensemble_streaming",),
}
_HOME = {name: module for module, names in _HOMES.items() for name in names}

__version__ = "0.1.0"
__all__ = ["__version__", *_HOME]  # noqa: PLE0604


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    value = globals()[name] = getattr(importlib.import_module(f"{__name__}.{_HOME[name]}"), name)
    return value


def __dir__() -> list[str]:
    return sorted({*globals(), *__all__})
