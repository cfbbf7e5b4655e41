"""Stands in for tsfm_public: the step, ten more a level of the model's own."""

from types import SimpleNamespace

import numpy as np
import torch


class PatchTSTFMForPrediction:
    config = SimpleNamespace(context_length=16, quantile_levels=[0.1, 0.5, 0.9])

    @classmethod
    def from_pretrained(cls, name, device_map):
        assert name == "ibm-research/patchtst-fm-r1"
        out = cls()
        out.device = torch.device(device_map)
        return out

    def eval(self):
        return self

    def __call__(self, inputs, prediction_length, quantile_levels, return_loss=False):
        assert all(isinstance(x, torch.Tensor) and x.shape == (16,) and x.place == self.device.type for x in inputs)
        assert not torch.mps.is_available()  # asked for while the model runs elsewhere
        levels = self.config.quantile_levels
        rows = [np.arange(1, prediction_length + 1) + 10.0 * levels.index(q) + 1000 * (len(quantile_levels) == 1) for q in quantile_levels]
        return SimpleNamespace(quantile_predictions=torch.tensor(np.stack([rows] * len(inputs))))
