"""The pretrained providers, from loading to forecasts, with stand-ins for their packages on the workers."""

import datetime as dt
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

import panelcast as pc
from panelcast.operators import providers as P
from panelcast.plans import pretrained
from panelcast.plans.cache import ModelCache
from panelcast.plans.device import model_device, without_mps

STUBS = str(Path(__file__).parent / "stubs")


class _Stubbed:
    """Finds the stand-ins first wherever the model is loaded."""

    def load(self, device):
        if STUBS not in sys.path:
            sys.path.insert(0, STUBS)
        return super().load(device)


class Chronos(_Stubbed, pretrained.Chronos):
    pass


class TimesFM(_Stubbed, pretrained.TimesFM):
    pass


class Moirai(_Stubbed, pretrained.Moirai):
    pass


class PatchTST(_Stubbed, pretrained.PatchTST):
    pass


NAN = float("nan")


def future(spark, ids, days, **features):
    rows = [(k, dt.datetime(2024, 1, d), *[float(v) for v in vs]) for k in ids for d, *vs in zip(days, *features.values())]
    return spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, " + ", ".join(f"{n} double" for n in features))


def by_series(df, column="yhat"):
    out = {}
    for r in df.orderBy("unique_id", "ds").collect():
        out.setdefault(r.unique_id, []).append(r[column])
    return out


def test_chronos(panel):
    data = pc.build_dataset(panel({"A": [1, 2, 3], "B": [7]}), pc.ForecastConfig(h=2))
    df = P.predict(Chronos(pc.get_spec("chronos")), data, 2, (0.1, 0.5, 0.9))
    assert by_series(df) == by_series(df, "q0.1") == by_series(df, "q0.9") == {"A": [3, 3], "B": [7, 7]}


def test_chronos_covariates(spark, panel):
    """Covariates are (batch, feature, length + h): zeros over the past, the future aligned on the right."""
    cov = future(spark, ["A", "C"], [4, 5, 6], price=[1, 2, 9], promo=[0, 5, 9])
    data = pc.build_dataset(panel({"A": [1, 2, 3], "B": [7, 8], "C": [1, 1, 4]}), pc.ForecastConfig(h=2), pc.CovariateSet(future=cov))
    got = by_series(P.predict(Chronos(pc.get_spec("chronos")), data, 2, batch_size=2))
    assert got == {"A": [103, 703], "B": [8, 8], "C": [104, 704]}


@pytest.mark.parametrize("device, more", [("cpu", 0), ("cuda", 1000), ("auto", 1000)])
def test_timesfm_runs_on_the_asked_device(panel, device, more):
    data = pc.build_dataset(panel({"A": range(50)}), pc.ForecastConfig(h=3))
    df = P.predict(TimesFM(pc.get_spec("timesfm")), data, 3, (0.1, 0.9), device=device)
    assert by_series(df) == {"A": [more + 1, more + 2, more + 3]}
    assert by_series(df, "q0.1") == {"A": [more + 11, more + 12, more + 13]} and by_series(df, "q0.9")["A"][0] == more + 91


def test_patchtst_asks_for_its_own_levels(panel):
    data = pc.build_dataset(panel({"A": [1, 2], "B": range(40)}), pc.ForecastConfig(h=3))
    alone = by_series(P.predict(PatchTST(pc.get_spec("patchtst_fm")), data, 3))
    assert alone == {"A": [1011, 1012, 1013], "B": [1011, 1012, 1013]}  # only the median was asked for
    df = P.predict(PatchTST(pc.get_spec("patchtst_fm")), data, 3, (0.1, 0.5, 0.7, 0.9))
    assert by_series(df, "q0.1")["A"] == [1, 2, 3] and by_series(df, "q0.9")["B"] == [21, 22, 23] and by_series(df)["A"] == [11, 12, 13]
    assert by_series(df, "q0.7")["A"] == [None] * 3  # a level the model does not have


@pytest.mark.parametrize("freq", ["D", "h", "15min", "W", "B", "MS", "ME", "QS", "QE", "YS", "YE", "QS-OCT", "2MS"])
def test_moirai_steps_in_periods(spark, freq):
    stamps = pd.date_range("2020-01-01", periods=5, freq=freq)
    rows = spark.createDataFrame([("A", t.to_pydatetime(), float(i)) for i, t in enumerate(stamps)], "unique_id string, ds timestamp_ntz, y double")
    df = P.predict(Moirai(pc.get_spec("moirai")), pc.build_dataset(rows, pc.ForecastConfig(h=2, freq=freq)), 2, (0.1,))
    alias = P.fq.period_alias(freq)
    first = pd.Period(stamps[0], freq=alias).start_time
    assert by_series(df) == {"A": [first.year * 10_000 + first.month * 100 + first.day] * 2}
    assert by_series(df, "q0.1") == {"A": [5001.0] * 2}
    want = pd.date_range(stamps[-1], periods=3, freq=freq)[1:]
    assert [r.ds for r in df.orderBy("ds").collect()] == [t.to_pydatetime() for t in want]


def test_moirai_covariates(spark, panel):
    cov = pc.CovariateSet(future=future(spark, ["A"], [5, 6], price=[1, 2], promo=[10, 20]), past=future(spark, ["A", "B"], [1, 3], heat=[100, 300]))
    data = pc.build_dataset(panel({"A": [1, NAN, 3, 4], "B": [7, 8, 9]}), pc.ForecastConfig(h=2), cov)
    got = by_series(P.predict(Moirai(pc.get_spec("moirai")), data, 2, (0.1,), batch_size=1), "q0.1")
    assert got == {"A": [4434.0] * 2, "B": [3401.0] * 2}


def test_moirai_starts_where_a_cut_context_does(panel):
    data = pc.build_dataset(panel({"A": range(40)}), pc.ForecastConfig(h=1, context_length=10))
    df = P.predict(Moirai(pc.get_spec("moirai")), data, 1, (0.1,))
    assert by_series(df) == {"A": [20240131.0]} and by_series(df, "q0.1") == {"A": [10001.0]}


def test_preloading_reaches_the_workers(spark):
    provider = TimesFM(pc.ModelSpec("preloaded", "", requires=("timesfm",), max_context_length=15360, max_prediction_length=1024))
    pc.register(provider)
    try:
        rows = ModelCache.preload_workers([provider.spec], "cpu", spark, tasks=4).collect()
        assert len(rows) == 4 and {r.model for r in rows} == {"preloaded"}
        ModelCache.preload([provider.spec], "cpu", spark)
        assert not ModelCache.is_loaded("preloaded")  # the driver holds none of it
    finally:
        from panelcast.plans.registry import unregister

        unregister("preloaded")


def test_where_a_model_is(monkeypatch):
    monkeypatch.syspath_prepend(STUBS)
    torch = __import__("torch")
    try:
        on = type("M", (), {"device": torch.device("cuda")})()
        inside = type("M", (), {"parameters": lambda self: iter([on])})()
        assert model_device(on).type == model_device(inside).type == "cuda" and model_device(object()) is None
        with without_mps(torch.device("cuda")):
            assert not torch.mps.is_available()
        assert torch.mps.is_available() and not torch.backends.mps.is_available()
        with without_mps(torch.device("mps")):
            assert torch.mps.is_available()
        assert np.isclose(float(torch.tensor([1.5])[0]), 1.5)
    finally:
        sys.modules.pop("torch", None)
