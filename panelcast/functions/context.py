"""Context preparation: padding, truncation and cleaning of history vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")


def mean(ctx: Column) -> Column:
    """Mean of a vector, 0 if it is empty."""
    total = F.aggregate(ctx, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(ctx) > 0, total / F.size(ctx)).otherwise(F.lit(0.0))


def nan_mean(ctx: Column) -> Column:
    """Mean of the values that are numbers, 0 if there is none."""
    return mean(F.filter(ctx, lambda x: x.isNotNull() & ~F.isnan(x)))


def left_pad(ctx: Column, length: int | None, fill: float | None = None) -> Column:
    """Padded on the left to ``length`` with ``fill``, by default the vector's mean."""
    if length is None:
        return ctx
    value = mean(ctx) if fill is None else F.lit(float(fill))
    return F.when(F.size(ctx) < length, F.concat(F.array_repeat(value, F.greatest(F.lit(length) - F.size(ctx), F.lit(0))), ctx)).otherwise(ctx)


def keep_last(ctx: Column, length: int | None) -> Column:
    """The newest ``length`` values."""
    if length is None:
        return ctx
    return F.when(F.size(ctx) > length, F.slice(ctx, -length, length)).otherwise(ctx)


def adjust_length(ctx: Column, spec, fill: float | None = None) -> Column:
    """A struct: the vector within ``spec``'s limits and what was done to it.

    Too long without permission to truncate raises when the plan runs; too short without permission
    to pad stays short and has ``too_short``.
    """
    low, high = spec.min_context_length, spec.max_context_length
    n = F.size(ctx)
    short = n < low if low is not None else F.lit(False)
    long = n > high if high is not None else F.lit(False)
    data = left_pad(ctx, low, fill) if spec.pad_to_min_context else ctx
    if spec.truncate_to_max_context:
        data = keep_last(data, high)
    elif high is not None:
        message = F.concat(F.lit("Context length "), n.cast("string"), F.lit(f" exceeds max {high} of {spec.name}"))
        data = F.when(long, F.raise_error(message).cast("array<double>")).otherwise(data)
    padded, cut = (short if spec.pad_to_min_context else F.lit(False)), (long if spec.truncate_to_max_context else F.lit(False))
    return F.struct(
        data.alias("data"),
        padded.alias("was_padded"),
        cut.alias("was_truncated"),
        n.alias("original_length"),
        F.size(data).alias("adjusted_length"),
        F.when(padded, F.lit(low) - n).otherwise(0).alias("padding_amount"),
        F.when(cut, n - F.lit(high)).otherwise(0).alias("truncation_amount"),
        (short & ~padded).alias("too_short"),
    )


def exact_length(ctx: Column, length: int | None) -> Column:
    """Padded with the mean, or cut on the left, to exactly ``length``."""
    return keep_last(left_pad(ctx, length), length)


def fill_mean(ctx: Column) -> Column:
    """NaN and null become the mean of the rest (0 if there is none); an empty vector becomes [0]."""
    # the mean is computed once a vector: it is the one element the outer transform runs over
    fill = lambda m: F.transform(ctx, lambda x: F.when(x.isNull() | F.isnan(x), m).otherwise(x))
    filled = F.element_at(F.transform(F.array(nan_mean(ctx)), fill), 1)
    return F.when(F.size(ctx) == 0, F.array(F.lit(0.0))).otherwise(filled)


def fill_neighbours(df: DataFrame, value: str = "y") -> DataFrame:
    """Per series, non-finite and null values take the last finite one before, else the first after, else 0."""
    finite = F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    order = Window.partitionBy("unique_id").orderBy("ds", value)
    before = F.last(finite, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(finite, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(value, F.coalesce(before, after, F.lit(0.0)))


def to_float(ctx: Column) -> Column:
    return ctx.cast("array<float>")
