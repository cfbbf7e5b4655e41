"""Ensembles: one keyed aggregate over all models' forecasts.

Forecasts are combined by (unique_id, ds), never by row position. Null means that a model does not
give a column (it is ignored); NaN is a model's value and makes the result NaN.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.errors import EInsufficient

METHODS = ("median", "mean")


def quantile_name(q: float) -> str:
    """The column of a level, equal for 1 and 1.0."""
    return f"q{float(q)}"


def combine(value: Column, method: str) -> Column:
    """Exact median or mean; NaN if any value is."""
    center = F.median(value) if method == "median" else F.avg(value)
    return F.when(F.bool_or(F.isnan(value)), F.lit(float("nan"))).otherwise(center)


def _check(predictions: Sequence[DataFrame], method: str) -> None:
    if not predictions:
        raise EInsufficient("No predictions to ensemble")
    if method not in METHODS:
        raise ValueError(f"Unknown ensemble method: {method}; choose from {', '.join(METHODS)}")


def ensemble_with_quantiles(predictions: Sequence[DataFrame], method: str = "median", quantiles: Sequence[float] = (), quantile_mode: str = "best_effort") -> DataFrame:
    """(unique_id, ds, yhat, q...) over all models; a single forecast is returned untouched.

    Other columns of the first forecast are carried along by key, null where it has no such row; its levels
    that were not requested are not. A requested level that no model has is left out, or raises EInsufficient in ``strict`` mode.
    """
    _check(predictions, method)
    if len(predictions) == 1:
        return predictions[0]
    wanted = list(dict.fromkeys(map(quantile_name, quantiles)))
    there = [c for c in wanted if any(c in p.columns for p in predictions)]
    if quantile_mode == "strict" and len(there) < len(wanted):
        raise EInsufficient(f"No model gives the quantiles {[c for c in wanted if c not in there]}")
    columns = ["yhat", *there]
    first = predictions[0]
    carried = [c for c in first.columns if c not in ("unique_id", "ds", *columns) and not re.fullmatch(r"q\d+(\.\d+)?", c)]
    parts = []
    for p in predictions:
        own = [(F.col(f"`{c}`") if c in p.columns else F.lit(None)).cast("double").alias(c) for c in columns]
        rest = [(F.col(f"`{c}`") if p is first else F.lit(None).cast(first.schema[c].dataType)).alias(c) for c in carried]
        parts.append(p.select("unique_id", "ds", *own, *rest))
    keep = [F.first(f"`{c}`", ignorenulls=True).alias(c) for c in carried]  # the first forecast has a key once
    return reduce(DataFrame.unionAll, parts).groupBy("unique_id", "ds").agg(*[combine(F.col(f"`{c}`"), method).alias(c) for c in columns], *keep)


def ensemble(predictions: Sequence[DataFrame], method: str = "median", quantiles: Sequence[float] = (), quantile_mode: str = "best_effort") -> DataFrame:
    return ensemble_with_quantiles(predictions, method, quantiles, quantile_mode)


def coverage(predictions: Sequence[DataFrame]) -> DataFrame:
    """(unique_id, ds, n_models) where some model gives no forecast: keys that do not match."""
    every = reduce(DataFrame.unionAll, [p.select("unique_id", "ds") for p in predictions])
    return every.groupBy("unique_id", "ds").agg(F.count(F.lit(1)).alias("n_models")).filter(F.col("n_models") != len(predictions))
