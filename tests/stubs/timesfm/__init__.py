"""Stands in for timesfm: the step, ten more a decile, and a thousand where the model is on cuda."""

from dataclasses import dataclass

import numpy as np


@dataclass
class ForecastConfig:
    max_context: int
    max_horizon: int
    normalize_inputs: bool
    use_continuous_quantile_head: bool


class TimesFM_2p5_200M_torch:  # noqa: N801
    place = "cpu"

    @classmethod
    def from_pretrained(cls, name):
        assert name == "google/timesfm-2.5-200m-pytorch"
        return cls()

    def to(self, device):
        self.place = device.type
        return self

    def compile(self, config):
        assert (config.max_context, config.max_horizon) == (15360, 1024)
        self.compiled = True

    def forecast(self, horizon, inputs):
        assert self.compiled and all(isinstance(x, np.ndarray) and len(x) == 993 for x in inputs)
        points = np.stack([np.arange(1, horizon + 1) + 1000.0 * (self.place == "cuda") for _ in inputs])
        return points, np.stack([points + 10 * i for i in range(10)], axis=2)
