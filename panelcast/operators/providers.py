"""Pretrained models as providers that run on the executors in Arrow batches.

A provider is a small picklable object; workers load its model once and keep it (by class, name,
device and generation). ``predict`` numbers batches of series by length and is then one lazy ``mapInPandas`` over a frame with a row a series; batches
are numbered before they leave the JVM, so they do not depend on row order.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions import freq as fq
from panelcast.functions import outputs as O
from panelcast.functions.context import adjust_length, exact_length, fill_mean, keep_last
from panelcast.functions.lengths import fit_exact, validate_prediction_length
from panelcast.operators.ensemble import quantile_name
from panelcast.operators.panel import TSDataset
from panelcast.operators.shared import checkpointed, ship


@dataclass
class Batch:
    """What a model gets for some series: float32 contexts, the horizon, levels, covariate blocks."""

    ids: list[Any]
    contexts: list[np.ndarray]
    h: int
    quantiles: tuple[float, ...]
    starts: list[Any]
    freq: str
    future: list[dict[str, list[float]] | None]
    past: list[dict[str, list[float]] | None]
    lengths: list[int] | None = None  # of the whole series, of which a context may hold the newest values


@dataclass
class Forecasts:
    """points[series, step]; quantiles[level][series, step], levels as requested."""

    points: Sequence[np.ndarray]
    quantiles: dict[float, Sequence[np.ndarray]]


@runtime_checkable
class ModelProvider(Protocol):
    """What a model has to offer to take part."""

    name: str
    spec: Any

    def load(self, device: str) -> Any: ...
    def predict_batch(self, model: Any, batch: Batch) -> Forecasts: ...
    def quantile_levels(self, requested: Sequence[float]) -> list[float]: ...


_MODELS: dict[tuple, Any] = {}
_LOCK = threading.Lock()


def worker_model(provider: ModelProvider, device: str, generation: int) -> Any:
    """The provider's model in this process, loaded at most once; older generations go."""
    key = (type(provider).__qualname__, provider.name, device, generation)
    with _LOCK:
        if key not in _MODELS:
            for old in [k for k in _MODELS if k[:3] == key[:3]]:
                release(provider, _MODELS.pop(old))
            _MODELS[key] = provider.load(device)
        return _MODELS[key]


def release(provider: ModelProvider, model: Any) -> None:
    """Let the provider free what it holds; best effort."""
    hook = getattr(provider, "unload", None)
    if hook is not None:
        try:
            hook(model)
        except Exception:  # noqa: BLE001  freeing must not fail a run
            return


def length_batches(series: DataFrame, batch_size: int, ordinal: str = "unique_id") -> DataFrame:
    """``series`` with ``batch``: chunks of ``batch_size`` series of similar length.

    Series are ranked by length, then by ``ordinal``; up to one batch of them is a single chunk. Ranks
    are row numbers within range partitions plus the partitions' offsets, so no task sorts all
    series, not even if all have one length.
    """
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = series.select("n", ordinal).repartitionByRange(parts, "n", ordinal)
    ranged = checkpointed(ranged.withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    skips = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("n", ordinal)) + F.col("skip")
    ranks = ranged.join(skips, "part").select(ordinal, F.floor((rank - 1) / batch_size).cast("long").alias("batch"))
    return series.join(ranks, ordinal)


def _prepared(dataset: TSDataset, provider: ModelProvider) -> DataFrame:
    """A row a series with its cleaned context within the provider's limits."""
    spec, asked = provider.spec, dataset.config.context_length
    longest = min((x for x in (spec.max_context_length, asked) if x), default=None)
    series = dataset.series(longest if spec.truncate_to_max_context or longest == asked else None)
    series = series.withColumn("ctx", keep_last(F.col("ctx"), asked))
    ctx = fill_mean(F.col("ctx")) if getattr(provider, "mean_fill", True) else F.col("ctx")
    exact = getattr(provider, "exact_context", None)
    fitted = F.struct(exact_length(ctx, exact).alias("data")) if exact else adjust_length(ctx, spec)
    return series.withColumn("ctx", fitted["data"].cast("array<float>"))


def predict(provider: ModelProvider, dataset: TSDataset, h: int, quantiles: Sequence[float] = (), batch_size: int = 32, device: str = "cpu", generation: int = 0) -> DataFrame:
    """(unique_id, ds, yhat, q...): the provider's forecast of every series, a lazy frame.

    Numbering the batches runs one small job here, over the series' lengths alone. A series whose forecast is shorter than the horizon gets the steps there are.
    """
    ship(dataset.df.sparkSession)
    steps = validate_prediction_length(h, provider.spec, dataset.config.strict_length_limits)
    limit = dataset.config.prediction_length_limit
    steps = min(steps, limit) if limit else steps
    levels = [float(q) for q in provider.quantile_levels(quantiles)]
    frequency = dataset.config.freq
    rows = _prepared(dataset, provider)
    cov, wants = dataset.covariates, getattr(provider, "covariates", ())
    from panelcast.operators import covariates as C

    for kind, make in (("future", lambda: C.future_block(dataset, steps, getattr(provider, "history_fill", 0.0))), ("past", lambda: C.past_block(dataset))):
        if kind in wants and getattr(cov, kind, None) is not None:
            rows = rows.join(make().withColumnRenamed("block", kind), "unique_id", "left")
        else:
            rows = rows.withColumn(kind, F.lit(None).cast("map<string,array<double>>"))
    batched = length_batches(rows, batch_size)
    n = max(1, int(dataset.df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # partitions by number: adaptive execution leaves them as they are, so batches stay whole
    batched = batched.repartitionById(n, F.pmod("batch", F.lit(n)).cast("int")).sortWithinPartitions("batch", "n", "unique_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = worker_model(provider, device, generation)
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = frame["batch"].iloc[-1] if len(frame) else None
            for _, part in frame[frame["batch"] != last].groupby("batch", sort=True):
                yield one(model, part)
            held = frame[frame["batch"] == last] if len(frame) else None
        if held is not None and len(held):
            yield one(model, held)

    def one(model: Any, part: pd.DataFrame) -> pd.DataFrame:
        blocks = lambda c: [None if m is None else dict(m) for m in part[c]]
        batch = Batch(list(part["unique_id"]), [np.asarray(c, np.float32) for c in part["ctx"]], steps, tuple(levels), list(part["start_ds"]), frequency, blocks("future"), blocks("past"), [int(n) for n in part["n"]])
        got = provider.predict_batch(model, batch)
        points = [np.asarray(p, float)[:steps] for p in got.points]
        sizes = [len(p) for p in points]
        begin = np.cumsum([0, *sizes])
        at = np.repeat(np.arange(len(part)), sizes)
        frame = part[["unique_id", "last_ds"]].iloc[at].reset_index(drop=True)
        frame["step"] = (np.arange(len(at)) - begin[at] + 1).astype(np.int32)
        frame["yhat"] = np.concatenate([np.zeros(0), *points])
        for q in levels:
            values, absent = np.zeros(len(at)), np.ones(len(at), bool)
            for i, course in enumerate(got.quantiles.get(q) or ()):
                if course is not None:
                    course = np.asarray(course, float)[: sizes[i]]
                    own = slice(begin[i], begin[i] + len(course))
                    values[own], absent[own] = course, False
            frame[quantile_name(q)] = pd.arrays.FloatingArray(values, absent)  # NaN is a value, absent is null
        return frame

    kind = dataset.df.schema["unique_id"].dataType.simpleString()
    schema = f"unique_id {kind}, last_ds timestamp_ntz, step int, yhat double" + "".join(f", `{quantile_name(q)}` double" for q in levels)
    raw = batched.select("unique_id", "start_ds", "last_ds", "n", "ctx", "future", "past", "batch").mapInPandas(run, schema)
    return raw.select("unique_id", fq.future(F.col("last_ds"), F.col("step"), frequency).alias("ds"), "yhat", *[F.col(f"`{quantile_name(q)}`") for q in levels])


# --- providers ---------------------------------------------------------------------------------


@dataclass
class DecileProvider:
    """A model that takes a list of contexts and returns (points, deciles).

    ``model.forecast(horizon, inputs)`` gives (batch, horizon) and (batch, horizon, quantile).
    """

    spec: Any
    levels: tuple[float, ...] | None = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)

    @property
    def name(self) -> str:
        return self.spec.name

    def load(self, device: str) -> Any:
        raise ImportError(f"{self.name} needs the package {self.spec.requires[0]}")

    def quantile_levels(self, requested: Sequence[float]) -> list[float]:
        return [float(q) for q in requested]

    def predict_batch(self, model: Any, batch: Batch) -> Forecasts:
        points, deciles = model.forecast(horizon=batch.h, inputs=batch.contexts)
        found = [O.decile_courses(deciles, i, batch.h, batch.quantiles, self.levels) for i in range(len(batch.ids))]
        return Forecasts(list(np.asarray(points)), {q: [f.get(q) for f in found] for q in batch.quantiles})


def model_levels(model: Any) -> tuple[float, ...] | None:
    """The quantile levels a loaded model names, in its configuration or its backbone."""
    for part in ("config", "backbone"):
        if (found := getattr(getattr(model, part, None), "quantile_levels", None)) is not None:
            return tuple(float(q) for q in found)
    return None


@dataclass
class QuantileProvider:
    """A model of exact context length that returns (batch, quantile, horizon), NaNs repaired.

    Levels and context length not given here are those of the loaded model; a requested level it does not
    have is null.
    """

    spec: Any
    exact_context: int | None = None
    levels: tuple[float, ...] | None = None

    @property
    def name(self) -> str:
        return self.spec.name

    def load(self, device: str) -> Any:
        raise ImportError(f"{self.name} needs the package {self.spec.requires[0]}")

    def quantile_levels(self, requested: Sequence[float]) -> list[float]:
        return (O.matched_levels(self.levels, requested) or []) if requested else []

    def call(self, model: Any, batch: Batch, levels: list[float] | None) -> Any:
        return model(inputs=batch.contexts, prediction_length=batch.h, quantile_levels=levels)

    def predict_batch(self, model: Any, batch: Batch) -> Forecasts:
        exact = self.exact_context or getattr(getattr(model, "config", None), "context_length", None)
        batch.contexts = [fit_exact(c, exact) for c in batch.contexts]
        own = self.levels or model_levels(model)
        asked = O.matched_levels(own, batch.quantiles)
        raw = self.call(model, batch, asked)
        n, last = len(batch.ids), [float(c[-1]) if len(c) else 0.0 for c in batch.contexts]
        points = O.extract_batch_forecasts(raw, batch.h, n, asked or (list(own) if own else None))
        courses = O.extract_batch_quantiles(raw, batch.h, n, asked)
        fixed = {q: [None if np.isnan(v).all() else O.repair_nan(v, x) for v, x in zip(vs, last)] for q, vs in courses.items()}
        return Forecasts([O.repair_nan(p, x) for p, x in zip(points, last)], fixed)


@dataclass
class SampleProvider:
    """A model of sample paths: contexts padded on the left with 0 to the batch's longest.

    ``model.predict(inputs (batch, 1, length), h, covariates)`` gives (batch, samples, 1, h).
    """

    spec: Any
    covariates: tuple[str, ...] = ("future",)
    mean_fill: bool = False

    @property
    def name(self) -> str:
        return self.spec.name

    def load(self, device: str) -> Any:
        raise ImportError(f"{self.name} needs the package {self.spec.requires[0]}")

    def quantile_levels(self, requested: Sequence[float]) -> list[float]:
        return [float(q) for q in requested]

    def predict_batch(self, model: Any, batch: Batch) -> Forecasts:
        longest = max(map(len, batch.contexts))
        inputs = np.stack([np.pad(c, (longest - len(c), 0)) for c in batch.contexts])[:, None, :]
        samples = np.asarray(model.predict(inputs, batch.h, self._covariates(batch, longest)))
        points, courses = [], {q: [] for q in batch.quantiles}
        for s in samples.reshape(len(batch.ids), -1, samples.shape[-1]):
            found = O.sample_quantiles(s, [0.5, *batch.quantiles])
            points.append(found[0])
            for q, v in zip(batch.quantiles, found[1:]):
                courses[q].append(v)
        return Forecasts(points, courses)

    def _covariates(self, batch: Batch, longest: int) -> np.ndarray | None:
        """(batch, feature, longest + h), aligned on the right; None without covariates."""
        names = sorted({n for b in batch.future if b for n in b})
        if not names:
            return None
        width = longest + batch.h
        out = np.zeros((len(batch.ids), len(names), width), np.float32)
        for i, b in enumerate(batch.future):
            for j, n in enumerate(names):
                v = np.asarray((b or {}).get(n, []), np.float32)[-width:]
                out[i, j, width - len(v) :] = v
        return out


def start_of_context(start, n: int, kept: int, freq: str):
    """The first time stamp of a context of which only the newest ``kept`` of ``n`` values are left."""
    return pd.date_range(start=start, periods=max(1, n - kept + 1), freq=fq.pandas_alias(freq))[-1] if n > kept else start


def padding(lengths: Sequence[int], batch_size: int) -> int:
    """How many padded values batches of these lengths, in this order, need."""
    groups = [list(lengths[i : i + batch_size]) for i in range(0, len(lengths), batch_size)]
    return sum(max(g) * len(g) - sum(g) for g in groups)


def n_batches(n: int, batch_size: int) -> int:
    return math.ceil(n / batch_size)
