"""Stands in for uni2ts: forecasts that tell the context's first period, its length and the covariates."""

import numpy as np


class Moirai2Module:
    @classmethod
    def from_pretrained(cls, name):
        assert name == "Salesforce/moirai-2.0-R-small"
        return cls()

    def to(self, device):
        assert device in ("cpu", "cuda")
        return self


class _Forecast:
    def __init__(self, entry, h):
        self.entry, self.h = entry, h

    def quantile(self, q):
        start = self.entry["start"].start_time
        known = [np.nansum(self.entry[k]) for k in ("feat_dynamic_real", "past_feat_dynamic_real") if k in self.entry]
        if q == 0.5:
            return np.full(self.h, start.year * 10_000 + start.month * 100 + start.day, float)
        return np.full(self.h, q * 10 + sum(known) + 1000 * len(self.entry["target"]))


class Moirai2Forecast:
    def __init__(self, module, prediction_length, context_length, target_dim, feat_dynamic_real_dim, past_feat_dynamic_real_dim):
        assert isinstance(module, Moirai2Module) and target_dim == 1
        self.h, self.length, self.dims = prediction_length, context_length, (feat_dynamic_real_dim, past_feat_dynamic_real_dim)

    def create_predictor(self, batch_size):
        self.batch_size = batch_size
        return self

    def predict(self, dataset):
        assert len(dataset) == self.batch_size and max(len(e["target"]) for e in dataset) == self.length
        for e in dataset:
            for name, dim, more in (("feat_dynamic_real", self.dims[0], self.h), ("past_feat_dynamic_real", self.dims[1], 0)):
                if name in e:
                    assert e[name].shape == (dim, len(e["target"]) + more)
            yield _Forecast(e, self.h)
