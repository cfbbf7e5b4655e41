"""Stands in for gluonts: entries with their frequency."""

import numpy as np
import pandas as pd


class ListDataset(list):
    def __init__(self, entries, freq):
        super().__init__(entries)
        self.freq = freq
        for e in self:
            assert isinstance(e["start"], pd.Period) and e["start"] == pd.Period(e["start"].start_time, freq=freq)
            assert np.isfinite(e["target"]).all()
