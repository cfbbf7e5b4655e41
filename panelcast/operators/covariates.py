"""Covariate alignment by keyed joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.panel import TSDataset

KEYS = ("unique_id", "ds")


def features(frame: DataFrame) -> list[str]:
    """The covariate columns of a frame: all but the keys."""
    return [c for c in frame.columns if c not in KEYS]


def future_block(dataset: TSDataset, h: int, history: float = 0.0, missing_zero: bool = True) -> DataFrame:
    """(unique_id, block map<feature, array>): ``history`` over the past, then the first h future rows by time.

    Series with fewer than h future rows get zeros, or no block at all with ``missing_zero`` off.
    """
    cov = dataset.covariates.future
    names = features(cov)
    order = Window.partitionBy("unique_id").orderBy("ds")
    first = cov.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= h)
    rows = first.groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct("k", *names))).alias("r"))
    base = dataset.df.groupBy("unique_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    both = base.join(rows, "unique_id", "left")
    full = F.coalesce(F.size("r") == h, F.lit(False))

    def block(name: str) -> Column:
        past = F.array_repeat(F.lit(float(history)), F.col("n"))
        values = F.when(full, F.col("r").getField(name).cast("array<double>"))
        if missing_zero:
            values = F.coalesce(values, F.array_repeat(F.lit(0.0), h))
        return F.concat(past, values)

    out = both.select("unique_id", F.create_map(*[x for n in names for x in (F.lit(n), block(n))]).alias("block"), full.alias("full"))
    return out.drop("full") if missing_zero else out.filter("full").drop("full")


def past_block(dataset: TSDataset) -> DataFrame:
    """(unique_id, block): past covariates on the series' own time stamps, NaN where there is none."""
    cov = dataset.covariates.past
    names = features(cov)
    # of rows with equal keys the smallest counts, column by column: whichever it is, always the same one
    row = F.struct(*[F.col(f"`{n}`").cast("double").alias(f"cov_{i}") for i, n in enumerate(names)])
    own = cov.groupBy(*KEYS).agg(F.min(row).alias("c")).select(*KEYS, "c.*")
    joined = dataset.df.select("unique_id", "ds", "y").join(own, list(KEYS), "left")
    rows = joined.groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct("ds", "y", *[F.coalesce(f"cov_{i}", F.lit(float("nan"))).alias(f"cov_{i}") for i in range(len(names))]))).alias("r"))
    return rows.select("unique_id", F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.col("r").getField(f"cov_{i}"))]).alias("block"))


def static_join(dataset: TSDataset) -> DataFrame:
    """Every series with its static covariates; Spark broadcasts the smaller side if its size allows."""
    return dataset.df.select("unique_id").distinct().join(dataset.covariates.static, "unique_id", "left")


def extended_target(ctx: Column, h: int) -> Column:
    """A history vector followed by h NaNs."""
    return F.concat(ctx, F.array_repeat(F.lit(float("nan")), h))


def extended_index(dataset: TSDataset, h: int) -> DataFrame:
    """(unique_id, ds): the history's time stamps and the h that follow."""
    return dataset.df.select(*KEYS).unionByName(dataset.future_index(h)).distinct()
