"""Sources and sinks of panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.panel import missing_columns

PANEL_SCHEMA = "unique_id string, ds timestamp_ntz, y double"
_KINDS = {"unique_id": "string", "ds": "timestamp_ntz", "y": "double"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A panel from CSV with a header: the three columns typed, others carried as strings."""
    raw = spark.read.csv(path, header=True)
    missing_columns(raw.columns)
    return raw.select(*[F.expr(f"try_cast(`{c}` as {_KINDS[c]})").alias(c) if c in _KINDS else F.col(f"`{c}`") for c in raw.columns])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    missing_columns(df.columns)
    return df


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header: a folder of files, or with ``single`` a folder of one, written by one task (small results only)."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def panel_from(df: DataFrame, unique_id: str, ts: str, value, unit: str = "day") -> DataFrame:
    """A panel from an event table: ``value`` (an aggregate) per id and truncated time stamp."""
    ds = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")
    return df.groupBy(F.col(unique_id).alias("unique_id"), ds.alias("ds")).agg(value.alias("y"))
