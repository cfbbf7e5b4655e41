"""Providers of public pretrained models. Their packages are imported on the worker, when a model loads.

None of these packages can be installed in this repository's test environment; the tests run every provider
whole, from loading to forecasts, with modules of the same names and signatures in their place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd

from panelcast.functions import freq as fq
from panelcast.functions import outputs as O
from panelcast.functions.lengths import fill_neighbours
from panelcast.operators.providers import Batch, DecileProvider, Forecasts, QuantileProvider, SampleProvider, start_of_context
from panelcast.plans.device import device_to_device_map, model_device, resolve_device, without_mps


def _no_grad():
    import torch

    return torch.no_grad()


@dataclass
class Chronos(SampleProvider):
    def load(self, device: str) -> Any:
        from chronos import BaseChronosPipeline

        return BaseChronosPipeline.from_pretrained(self.spec.config_fields["model_name"], device_map=device_to_device_map(resolve_device(device)))

    def predict_batch(self, model: Any, batch: Batch) -> Forecasts:
        import torch

        class Adapter:
            def predict(self, inputs: np.ndarray, h: int, covariates: np.ndarray | None) -> np.ndarray:
                more = {} if covariates is None else {"feat_dynamic_real": torch.tensor(covariates)}
                with _no_grad():
                    return np.stack([O.tensor_to_numpy(x) for x in model.predict(torch.tensor(inputs), h, **more)])

        return super().predict_batch(Adapter(), batch)


@dataclass
class TimesFM(DecileProvider):
    def load(self, device: str) -> Any:
        import timesfm

        model = timesfm.TimesFM_2p5_200M_torch.from_pretrained("google/timesfm-2.5-200m-pytorch")
        if hasattr(model, "to"):
            import torch

            model = model.to(torch.device(resolve_device(device)))
        model.compile(timesfm.ForecastConfig(max_context=self.spec.max_context_length, max_horizon=self.spec.max_prediction_length, normalize_inputs=True, use_continuous_quantile_head=True))
        return model


@dataclass
class Moirai:
    """Forecasts through GluonTS; past and future covariates ride along, NaN where unknown."""

    spec: Any
    covariates: tuple[str, ...] = ("future", "past")
    history_fill: float = float("nan")
    mean_fill: bool = False

    @property
    def name(self) -> str:
        return self.spec.name

    def quantile_levels(self, requested: Sequence[float]) -> list[float]:
        return [float(q) for q in requested]

    def load(self, device: str) -> Any:
        from uni2ts.model.moirai2 import Moirai2Forecast, Moirai2Module

        module = Moirai2Module.from_pretrained(self.spec.config_fields["model_name"]).to(resolve_device(device))
        return Moirai2Forecast, module, {}

    def unload(self, model: Any) -> None:
        model[2].clear()

    def predict_batch(self, model: Any, batch: Batch) -> Forecasts:
        from gluonts.dataset.common import ListDataset

        kind, module, kept = model
        sizes = [len(next(iter(b.values()))) if b else 0 for b in batch.future]
        future = max((len(b) for b in batch.future if b), default=0)
        past = max((len(b) for b in batch.past if b), default=0)
        key = (batch.h, max(map(len, batch.contexts)), future, past, len(batch.ids))
        if key not in kept:  # predictors of the same shape are used again
            kept[key] = kind(module=module, prediction_length=batch.h, context_length=key[1], target_dim=1, feat_dynamic_real_dim=future, past_feat_dynamic_real_dim=past).create_predictor(batch_size=len(batch.ids))
        period, entries = fq.period_alias(batch.freq), []
        for i, ctx in enumerate(map(fill_neighbours, batch.contexts)):
            whole = max(len(ctx), batch.lengths[i] if batch.lengths else sizes[i] - batch.h)
            entry = {"start": pd.Period(start_of_context(batch.starts[i], whole, len(ctx), batch.freq), freq=period), "target": ctx}
            if batch.future[i]:
                entry["feat_dynamic_real"] = np.array([v[-(len(ctx) + batch.h) :] for v in batch.future[i].values()])
            if batch.past[i]:
                entry["past_feat_dynamic_real"] = np.array([v[-len(ctx) :] for v in batch.past[i].values()])
            entries.append(entry)
        got = list(kept[key].predict(ListDataset(entries, freq=period)))
        return Forecasts([np.asarray(f.quantile(0.5)) for f in got], {q: [np.asarray(f.quantile(q)) for f in got] for q in batch.quantiles})


@dataclass
class PatchTST(QuantileProvider):
    def load(self, device: str) -> Any:
        from tsfm_public import PatchTSTFMForPrediction

        # mps only where it was asked for: by itself the model does not run well on it
        name, place = self.spec.config_fields["model_name"], resolve_device(device, allow_mps=False)
        try:
            model = PatchTSTFMForPrediction.from_pretrained(name, device_map=place)
        except TypeError:  # versions without that argument
            model = PatchTSTFMForPrediction.from_pretrained(name)
            model = model.to(place) if hasattr(model, "to") else model
        if hasattr(model, "eval"):
            model.eval()
        return model

    def call(self, model: Any, batch: Batch, levels: list[float] | None) -> Any:
        import torch

        place = model_device(model)
        inputs = [torch.tensor(c, **({} if place is None else {"device": place})) for c in batch.contexts]
        with _no_grad(), without_mps(place):
            try:
                return model(inputs=inputs, prediction_length=batch.h, quantile_levels=levels, return_loss=False)
            except TypeError:  # versions without that argument
                return model(inputs=inputs, prediction_length=batch.h, quantile_levels=levels)
