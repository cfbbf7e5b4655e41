"""Stands in for chronos: three equal samples of the last value plus a hundred times the covariates' sum."""

import numpy as np
import torch


class BaseChronosPipeline:
    @classmethod
    def from_pretrained(cls, name, device_map):
        assert name == "amazon/chronos-2" and device_map in ("cpu", "cuda")
        return cls()

    def predict(self, inputs, prediction_length=None, feat_dynamic_real=None):
        assert isinstance(inputs, torch.Tensor) and inputs.ndim == 3 and inputs.shape[1] == 1
        n, _, length = inputs.shape
        out = np.repeat(inputs[:, :, -1:], prediction_length, axis=2)
        if feat_dynamic_real is not None:
            assert isinstance(feat_dynamic_real, torch.Tensor)
            assert feat_dynamic_real.shape[0] == n and feat_dynamic_real.shape[2] == length + prediction_length
            assert not feat_dynamic_real[:, :, :length].any()
            out = out + 100 * feat_dynamic_real[:, :, length:].sum(1, keepdims=True)
        return [torch.tensor(np.stack([x] * 3)) for x in out]
