"""The driver's view of loaded models. Workers keep the models; a new generation makes them reload."""

from __future__ import annotations

import importlib
import os
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from panelcast.operators.providers import release, worker_model
from panelcast.operators.shared import ship
from panelcast.plans.registry import PROVIDERS, REGISTRY, ModelSpec


def provider_of(spec: ModelSpec) -> Any:
    """The provider object of a spec: the registered one, or a new one of the class it names."""
    if spec.name in PROVIDERS:
        return PROVIDERS[spec.name]
    module, _, name = spec.provider.partition(":")
    return getattr(importlib.import_module(module), name)(spec)


class ModelCache:
    """Load-once by (name, device) in this process, and the generation workers compare with."""

    _models: dict[tuple[str, str], Any] = {}
    generation = 0

    @classmethod
    def get(cls, spec: ModelSpec, device: str = "cpu") -> Any:
        key = (spec.name, device)
        if key not in cls._models:
            cls._models[key] = provider_of(spec).load(device)
        return cls._models[key]

    @classmethod
    def preload(cls, models: Iterable[ModelSpec], device: str = "cpu", spark: SparkSession | None = None) -> None:
        """Load models in this process, or with ``spark`` on its workers instead (see ``preload_workers``)."""
        if spark is not None:
            cls.preload_workers(models, device, spark).collect()
            return
        for spec in models:
            cls.get(spec, device)

    @classmethod
    def preload_workers(cls, models: Iterable[ModelSpec], device: str, spark: SparkSession, tasks: int | None = None) -> DataFrame:
        """(task, process, model): a task for every slot loads the models where forecasts will run.

        Workers that Spark uses again keep them; one it starts later loads on first use. Best effort:
        Spark may give a worker two of the tasks.
        """
        ship(spark)
        providers, generation = [provider_of(s) for s in models], cls.generation
        n = tasks or spark.sparkContext.defaultParallelism

        def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for p in providers:
                    worker_model(p, device, generation)
                for task in frame["id"]:
                    yield pd.DataFrame({"task": task, "process": os.getpid(), "model": [p.name for p in providers]})

        return spark.range(0, n, 1, n).mapInPandas(load, "task bigint, process bigint, model string")

    @classmethod
    def unload(cls, name: str | None = None) -> None:
        """Forget one model or all; each provider's hook is called, workers reload on next use."""
        for key in [k for k in cls._models if name in (None, k[0])]:
            model = cls._models.pop(key)
            if key[0] in REGISTRY:
                release(provider_of(REGISTRY[key[0]]), model)
        cls.generation += 1

    @classmethod
    def list_loaded(cls) -> list[str]:
        return list(dict.fromkeys(name for name, _ in cls._models))

    @classmethod
    def is_loaded(cls, name: str) -> bool:
        return name in cls.list_loaded()
