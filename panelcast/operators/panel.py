"""Panels of time series: validation, the dataset and its series.

A panel is a long frame (unique_id, ds, y); other columns are carried along. Row order means nothing
here: wherever order matters it is by ``ds`` and, for repeated time stamps, by ``y``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.config import ForecastConfig
from panelcast.errors import EContract, ETemporal
from panelcast.functions import freq as fq

REQUIRED = ("unique_id", "ds", "y")


def _frame(data: Any) -> DataFrame:
    if isinstance(data, DataFrame):
        return data
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    missing_columns(list(data.columns))
    return spark.createDataFrame(data) if len(data) else spark.createDataFrame([], "unique_id string, ds timestamp_ntz, y double")


def missing_columns(columns: list[str]) -> None:
    missing = sorted(set(REQUIRED).difference(columns))
    if missing:
        raise EContract(f"Missing required columns: {missing}", context={"missing": missing, "available": list(columns)})


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN where the type has it; infinities are values."""
    col = F.col(name)
    return col.isNull() | F.isnan(col) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else col.isNull()


def validation_report(df: DataFrame) -> DataFrame:
    """One row: the number of rows and of missing values in each required column, in one pass."""
    missing_columns(df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(is_missing(df, c)).alias(f"missing_{c}") for c in REQUIRED])


def validate(data: Any, config: ForecastConfig | None = None) -> DataFrame:
    """The frame itself if it keeps the contract, else EContract: columns, then rows, then values.

    Types are not judged here. Runs one aggregate job.
    """
    df = _frame(data)
    report = validation_report(df).first()
    if not report["n_rows"]:
        raise EContract("DataFrame is empty")
    for c in REQUIRED:
        if n := report[f"missing_{c}"]:
            raise EContract(f"Column '{c}' contains {n} null values", context={"column": c, "null_count": n})
    return df


def check_distinct(df: DataFrame) -> DataFrame:
    """The frame, or ETemporal if a series has a time stamp twice (an opt-in check)."""
    first = df.groupBy("unique_id", "ds").count().filter("count > 1").first()
    if first is not None:
        raise ETemporal("A series has a time stamp twice", context={"unique_id": first[0], "ds": str(first[1]), "rows": first[2]})
    return df


@dataclass(frozen=True)
class CovariateSet:
    """Optional frames: static (unique_id, ...), past and future (unique_id, ds, ...)."""

    static: DataFrame | None = None
    past: DataFrame | None = None
    future: DataFrame | None = None

    def is_empty(self) -> bool:
        return self.static is None and self.past is None and self.future is None


def newest(df: DataFrame, k: int) -> DataFrame:
    """Each series' newest ``k`` rows with ``age`` (1 is the newest).

    The rank filter is applied in every partition before the shuffle, so a series of any length
    sends at most k rows a partition.
    """
    order = Window.partitionBy("unique_id").orderBy(F.desc("ds"), F.desc("y"))
    return df.withColumn("age", F.row_number().over(order)).filter(F.col("age") <= k)


@dataclass(frozen=True)
class TSDataset:
    """A panel with its configuration and covariates; everything stays lazy."""

    df: DataFrame
    config: ForecastConfig
    covariates: CovariateSet | None = None
    _kept: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def from_dataframe(cls, data: Any, config: ForecastConfig, covariates: CovariateSet | None = None) -> TSDataset:
        df = _frame(data)
        missing_columns(df.columns)
        kind = df.schema["y"].dataType
        if not isinstance(kind, (T.NumericType, T.StringType, T.BooleanType)):
            raise EContract(f"Column 'y' of type {kind.simpleString()} is not numeric", context={"column": "y"})
        fq.check(config.freq)
        own = {"ds": F.col("ds").cast("timestamp_ntz"), "y": F.expr("try_cast(y as double)") if isinstance(kind, T.StringType) else F.col("y").cast("double")}
        return cls(df.withColumns(own), config, covariates)

    def sorted(self) -> DataFrame:
        """For presentation: ordered by series and time."""
        return self.df.orderBy("unique_id", "ds", "y")

    @property
    def n_series(self) -> int:
        return self.df.select("unique_id").distinct().count()

    def lengths(self) -> DataFrame:
        return self.df.groupBy("unique_id").agg(F.count(F.lit(1)).alias("n"), F.min("ds").alias("start_ds"), F.max("ds").alias("last_ds"), F.max_by("y", F.struct("ds", "y")).alias("last_y"))

    def stats(self) -> DataFrame:
        """One row (n_series, min_length, max_length), lazily and in one pass; lengths are 0 without series."""
        length = F.col("count")
        return self.df.groupBy("unique_id").count().agg(F.count(F.lit(1)).alias("n_series"), *[F.coalesce(f(length), F.lit(0)).cast("bigint").alias(f"{n}_length") for n, f in (("min", F.min), ("max", F.max))])

    @property
    def min_length(self) -> int:
        return self.stats().first()["min_length"]

    @property
    def max_length(self) -> int:
        return self.stats().first()["max_length"]

    def get_series(self, unique_id: Any) -> DataFrame:
        return self.df.filter(F.col("unique_id") == F.lit(unique_id)).orderBy("ds", "y")

    def series(self, longest: int | None = None) -> DataFrame:
        """(unique_id, n, start_ds, last_ds, ctx): a row a series, ``ctx`` its values in order.

        With ``longest`` only the newest values; n and start_ds are those of the whole series. Without it a
        vector is as long as its series, and one task holds it: for a series of very many rows, give a limit.
        """
        vector = F.array_sort(F.collect_list(F.struct("ds", "y")))
        facts = [F.count(F.lit(1)).alias("n"), F.min("ds").alias("start_ds"), F.max("ds").alias("last_ds")]
        if longest is None:
            return self.df.groupBy("unique_id").agg(*facts, vector.alias("r")).select("unique_id", "n", "start_ds", "last_ds", F.col("r.y").alias("ctx"))
        tails = newest(self.df, longest).groupBy("unique_id").agg(vector.alias("r")).select("unique_id", F.col("r.y").alias("ctx"))
        return self.df.groupBy("unique_id").agg(*facts).join(tails, "unique_id")

    def get_series_dict(self) -> dict[Any, Any]:
        """{id: vector of y} on the driver, kept for the next call; for small panels."""
        import numpy as np

        if "dict" not in self._kept:
            self._kept["dict"] = {r[0]: np.array(r[1], float) for r in self.series().select("unique_id", "ctx").toLocalIterator()}
        return self._kept["dict"]

    def future_index(self, n_periods: int | None = None) -> DataFrame:
        """(unique_id, ds) of the next periods of each series (``config.h`` of them if 0 or None)."""
        h = n_periods or self.config.h
        last = self.df.groupBy("unique_id").agg(F.max("ds").alias("last_ds"))
        return last.select("unique_id", "last_ds", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step")).select("unique_id", fq.future(F.col("last_ds"), F.col("step"), self.config.freq).alias("ds"))

    def get_covariates_for_series(self, unique_id: Any, kind: str) -> DataFrame | None:
        """One series' rows of the static, past or future covariates; None if there are none."""
        if kind not in ("static", "past", "future"):
            raise ValueError(f"Unknown covariate type: {kind}")
        frame = getattr(self.covariates, kind, None)
        if frame is None or "unique_id" not in frame.columns:
            return None
        own = frame.filter(F.col("unique_id") == F.lit(unique_id))
        return None if own.isEmpty() else own


def build_dataset(data: Any, config: ForecastConfig, covariates: CovariateSet | None = None) -> TSDataset:
    return TSDataset.from_dataframe(data, config, covariates)
