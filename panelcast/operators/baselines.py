"""The baseline models, entirely as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions import freq as fq
from panelcast.operators.panel import TSDataset, newest


def _steps(rows: DataFrame, h: int) -> DataFrame:
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"))


def naive(dataset: TSDataset, h: int) -> DataFrame:
    """(unique_id, ds, yhat): the last value, repeated."""
    last = dataset.df.groupBy("unique_id").agg(F.max("ds").alias("last_ds"), F.max_by("y", F.struct("ds", "y")).alias("yhat"))
    return _steps(last, h).select("unique_id", fq.future(F.col("last_ds"), F.col("step"), dataset.config.freq).alias("ds"), "yhat")


def seasonal_naive(dataset: TSDataset, h: int, season: int | None = None) -> DataFrame:
    """(unique_id, ds, yhat): the value one season back by position, else the last value.

    Only the newest season of a series leaves its partitions.
    """
    season = season or dataset.config.season_length or 1
    tail = newest(dataset.df, season).groupBy("unique_id").agg(
        F.max("ds").alias("last_ds"),
        F.max_by("y", -F.col("age")).alias("last_y"),
        F.map_from_entries(F.collect_list(F.struct("age", "y"))).alias("by_age"),
    )
    age = F.lit(season) - (F.col("step") - 1) % season
    value = F.when(F.map_contains_key("by_age", age), F.element_at("by_age", age)).otherwise(F.col("last_y"))
    return _steps(tail, h).select("unique_id", fq.future(F.col("last_ds"), F.col("step"), dataset.config.freq).alias("ds"), value.alias("yhat"))


BASELINES = {"naive": naive, "seasonal_naive": seasonal_naive}
