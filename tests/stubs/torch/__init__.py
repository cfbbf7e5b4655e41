"""Stands in for torch in tests: arrays with a device, and what is asked about devices."""

from contextlib import nullcontext
from types import SimpleNamespace

import numpy as np


class device:  # noqa: N801
    def __init__(self, type):  # noqa: A002
        self.type = str(type)

    def __str__(self):
        return self.type


class Tensor(np.ndarray):
    def detach(self):
        return self

    def cpu(self):
        return self

    def numpy(self):
        return np.asarray(self)


def tensor(values, dtype=None, device=None):
    out = np.array(values, dtype or np.float32).view(Tensor)
    out.place = str(device or "cpu")
    return out


no_grad = nullcontext
cuda = SimpleNamespace(is_available=lambda: True)
mps = SimpleNamespace(is_available=lambda: True)
backends = SimpleNamespace(mps=SimpleNamespace(is_available=lambda: False))
