"""Chunked ensembles under their streaming name: memory is bounded by Spark's own partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from panelcast.operators.ensemble import ensemble_with_quantiles


def ensemble_streaming(predictions: Sequence[DataFrame], method: str = "median", quantiles: Sequence[float] = (), chunk_size: int = 1000, quantile_mode: str = "best_effort") -> DataFrame:
    """The same plan as ``ensemble``; ``chunk_size`` is accepted and has no effect."""
    return ensemble_with_quantiles(predictions, method, quantiles, quantile_mode)
