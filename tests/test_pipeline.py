"""Providers, planning, the cache, the whole pipeline, sources and the command line."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import panelcast as pc
from panelcast import cli
from panelcast.catalog import DummyDeciles, DummyQuantiles, DummySamples
from panelcast.functions.outputs import DECILES
from panelcast.operators import covariates as C
from panelcast.operators import providers as P
from panelcast.plans import registry
from panelcast.plans.pipeline import check_horizons
from panelcast.sources import read_csv, write_csv


class Recorder:
    """A decile model of the usual test shape: step + place in batch, deciles 10 apart."""

    def forecast(self, horizon, inputs):
        assert all(len(x) == 993 for x in inputs)
        point = np.stack([np.arange(1, horizon + 1, dtype=np.float32) + b for b in range(len(inputs))])
        return point, np.stack([point + 10 * i for i in range(10)], axis=2)


class Steps(P.DecileProvider):
    def load(self, device):
        return Recorder()


class Broken(P.DecileProvider):
    def load(self, device):
        raise RuntimeError("no weights")


class Named(DummyDeciles):
    label = "x"

    @property
    def name(self):
        return self.label


@pytest.fixture()
def only():
    """Replace the registered models by given providers."""
    kept = dict(registry.REGISTRY)

    def use(*providers):
        registry.REGISTRY.clear()
        for p in providers:
            registry.register(p)

    yield use
    registry.REGISTRY.clear()
    registry.REGISTRY.update(kept)
    registry.PROVIDERS.clear()


def test_decile_provider_exact_numbers(panel):
    data = pc.build_dataset(panel({"A": range(50)}), pc.ForecastConfig(h=7))
    df = P.predict(Steps(pc.get_spec("timesfm")), data, 7, (0.1, 0.5, 0.9)).orderBy("ds")
    assert df.columns == ["unique_id", "ds", "yhat", "q0.1", "q0.5", "q0.9"]
    assert [r["q0.1"] for r in df.collect()] == [11, 12, 13, 14, 15, 16, 17]
    assert [r["q0.9"] for r in df.collect()] == [91, 92, 93, 94, 95, 96, 97]
    assert df.first().ds == dt.datetime(2024, 2, 20)
    assert P.predict(Steps(pc.get_spec("timesfm")), data, 7).columns == ["unique_id", "ds", "yhat"]
    assert set(DECILES) == {9, 10}


def test_quantile_provider_repairs_nan(panel):
    data = pc.build_dataset(panel({"A": [1, 2]}), pc.ForecastConfig(h=4))
    rows = P.predict(DummyQuantiles(pc.get_spec("patchtst_fm"), 8, (0.1, 0.5, 0.9)), data, 4, (0.1, 0.9)).orderBy("ds").collect()
    assert [r["q0.1"] for r in rows] == pytest.approx([1, 2, 7 / 3, 4])
    assert [r["q0.9"] for r in rows] == [None] * 4


def test_sample_provider(panel):
    data = pc.build_dataset(panel({"A": [1, 2], "B": [1]}), pc.ForecastConfig(h=2))
    rows = P.predict(DummySamples(pc.get_spec("chronos")), data, 2, (0.5,)).collect()
    assert sorted((r.unique_id, r.yhat, r["q0.5"]) for r in rows) == [("A", 4.5, 4.5), ("A", 9, 9), ("B", 4.5, 4.5), ("B", 9, 9)]


class Seen(P.SampleProvider):
    """Samples that show what the model was given: the covariates' last value, and the input's sum."""

    def load(self, device):
        return self

    def predict(self, inputs, h, covariates):
        shown = inputs.sum(axis=(1, 2)) + (0 if covariates is None else 1000 * covariates[:, 0, -1])
        return np.repeat(shown[:, None, None, None], h, axis=3)


def test_covariates_reach_the_provider(spark, panel):
    rows = panel({"A": [1, 2], "B": [5]})
    future = spark.createDataFrame([("A", dt.datetime(2024, 1, 3), 1.0), ("A", dt.datetime(2024, 1, 4), 2.0), ("B", dt.datetime(2024, 1, 2), 9.0)], "unique_id string, ds timestamp_ntz, price double")
    data = pc.build_dataset(rows, pc.ForecastConfig(h=2), pc.CovariateSet(future=future))
    got = {r.unique_id: r.yhat for r in P.predict(Seen(pc.get_spec("chronos")), data, 2).collect()}
    assert got == {"A": 2003.0, "B": 5.0}  # B has too few future rows: zeros
    assert C.future_block(data, 2, float("nan"), missing_zero=False).count() == 1
    assert C.features(future) == ["price"]
    past = future.withColumn("ds", F.col("ds") - F.expr("interval 1 day"))
    block = C.past_block(pc.build_dataset(rows, pc.ForecastConfig(h=1), pc.CovariateSet(past=past)))
    got = {r.unique_id: r.block["price"] for r in block.collect()}
    assert np.isnan(got["A"][0]) and got["A"][1] == 1.0 and got["B"] == [9.0]


def test_context_length_is_honoured(panel):
    data = pc.build_dataset(panel({"A": [1, 2, 4]}), pc.ForecastConfig(h=1, context_length=2))
    assert P.predict(Seen(pc.get_spec("chronos")), data, 1).first().yhat == 6.0


def test_prediction_limits_are_honoured(panel):
    rows = panel({"A": [1, 2, 4]})
    short = pc.build_dataset(rows, pc.ForecastConfig(h=9, prediction_length_limit=3))
    assert P.predict(Seen(pc.get_spec("chronos")), short, 9).count() == 3
    strict = pc.build_dataset(rows, pc.ForecastConfig(h=2000, strict_length_limits=True))
    with pytest.raises(ValueError):
        P.predict(Seen(pc.get_spec("chronos")), strict, 2000)


def test_length_batches(spark):
    rows = [(f"s{i:03d}", int(n)) for i, n in enumerate(np.random.default_rng(3).integers(1, 6, 60))]
    df = P.length_batches(spark.createDataFrame(rows, "unique_id string, n int"), 8)
    want = {u: i // 8 for i, (u, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r.unique_id: r.batch for r in df.collect()} == want
    lengths = [n for _, n in rows]
    assert P.padding(sorted(lengths), 8) <= P.padding(lengths, 8) and P.n_batches(17, 8) == 3


def test_start_of_a_cut_context():
    assert P.start_of_context(dt.datetime(2024, 1, 1), 10, 4, "D") == dt.datetime(2024, 1, 7)
    assert P.start_of_context(dt.datetime(2024, 1, 1), 4, 4, "D") == dt.datetime(2024, 1, 1)


def test_registry_and_plans(only):
    assert pc.list_models() == ["chronos", "timesfm", "moirai", "patchtst_fm", "naive", "seasonal_naive"]
    assert pc.list_models(tsfm_only=True) == ["chronos", "timesfm", "moirai", "patchtst_fm"]
    with pytest.raises(KeyError, match="registered: chronos"):
        pc.get_spec("nope")
    names = lambda **k: [s.name for s in pc.make_plan(config=pc.ForecastConfig(h=1, **k))]
    assert names(model_selection="fast") == ["timesfm", "chronos", "moirai", "patchtst_fm"]
    assert names(model_selection="accurate", max_models=2) == ["moirai", "chronos"]
    assert names(max_models=1) == ["chronos"] and len(pc.make_plan(tsfm_only=False)) == 6
    only()
    with pytest.raises(pc.ENoTSFM):
        pc.make_plan()


def test_baselines_take_part_when_planned(panel):
    data = pc.build_dataset(panel({"A": range(10)}), pc.ForecastConfig(h=2))
    plan = [s for s in pc.make_plan(tsfm_only=False) if not s.is_tsfm]
    fitted = pc.fit_all(plan, data)
    found = pc.predict_all_parallel(plan, pc.fit_all_parallel(plan, data), data, 2)
    assert all(f.ok for f in fitted) and len(found) == 2
    assert [r.yhat for r in pc.ensemble(found, "mean").orderBy("ds").collect()] == [6.0, 6.5]
    assert pc.predict(pc.fit(plan[0], data), data, 2).count() == 2


def test_forecast_end_to_end(panel, only):
    a, b = Named(pc.get_spec("timesfm")), Named(pc.get_spec("timesfm"))
    b.label = "y"
    only(a, b)
    registry.REGISTRY["x"] = registry.REGISTRY["y"] = pc.ModelSpec("x", "", min_context_length=5)
    registry.REGISTRY["y"] = pc.ModelSpec("y", "")
    result = pc.forecast(panel({"A": range(10), "B": range(3)}), h=3, quantiles=(0.1, 0.9))
    assert result.model_name == "ensemble_median" and result.df.columns == ["unique_id", "ds", "yhat", "q0.1", "q0.9"]
    assert [r.yhat for r in result.get_series("A").orderBy("ds").collect()] == [10, 11, 12]
    assert result.model_errors == ()


def test_failing_models_are_left_out_and_noted(panel, only):
    bad = Broken(pc.ModelSpec("bad", ""))
    good = DummyDeciles(pc.ModelSpec("good", ""))
    only(good, bad)
    result = pc.forecast(panel({"A": [1, 2]}), h=1, quantiles=())
    assert [e["model"] for e in result.model_errors] == ["bad"] and result.df.count() == 1
    with pytest.raises(pc.EInsufficient, match="1 < 2"):
        pc.forecast(panel({"A": [1, 2]}), h=1, min_tsfm=2)


def test_no_model_loads_here(panel):
    missing = pc.check_health().tsfm_missing
    if len(missing) == 4:
        with pytest.raises(pc.ENoTSFM):
            pc.forecast(panel({"A": [1, 2]}), h=1)


def test_horizons_that_would_differ():
    both = [pc.get_spec("chronos"), pc.get_spec("moirai")]
    check_horizons(both, pc.ForecastConfig(h=1024))
    with pytest.raises(ValueError, match="differ in length"):
        check_horizons(both, pc.ForecastConfig(h=1025))


def test_cache(only):
    loads, freed = [], []

    class Counting(DummyDeciles):
        def load(self, device):
            loads.append(device)
            return object()

        def unload(self, model):
            freed.append(model)
            raise RuntimeError("ignored")

    spec = pc.ModelSpec("counted", "")
    only(Counting(spec))
    cache = pc.ModelCache
    first = cache.get(spec)
    assert cache.get(spec) is first and loads == ["cpu"] and cache.is_loaded("counted") and cache.list_loaded() == ["counted"]
    cache.preload([spec], "cuda")
    before = cache.generation
    cache.unload("counted")
    assert len(freed) == 2 and not cache.is_loaded("counted") and cache.generation == before + 1
    cache.unload()
    provider = Counting(spec)
    a = P.worker_model(provider, "cpu", 1)
    assert P.worker_model(provider, "cpu", 1) is a and P.worker_model(provider, "cpu", 2) is not a


def test_devices_and_health():
    assert pc.resolve_device("cpu") == "cpu" and pc.resolve_device("nonsense") in ("cpu", "cuda", "mps")
    report = pc.check_health()
    assert set(report.tsfm_available) | set(report.tsfm_missing) == set(pc.list_models(tsfm_only=True)) and report.baselines_available
    assert "Baselines available: True" in str(report)


def test_csv_and_command_line(spark, tmp_path, panel, only, capsys):
    write_csv(panel({"A": range(5), "B": range(4)}), str(tmp_path / "in"), single=True)
    df = read_csv(spark, str(tmp_path / "in"))
    assert dict(df.dtypes) == {"unique_id": "string", "ds": "timestamp_ntz", "y": "double"} and df.count() == 9
    assert cli.main(["validate", "--input", str(tmp_path / "in")]) == 0
    assert "2 series" in capsys.readouterr().out
    (tmp_path / "bad.csv").write_text("unique_id,ds,y\nA,2024-01-01,\n")
    assert cli.main(["validate", "--input", str(tmp_path / "bad.csv")]) == 1
    only(DummyDeciles(pc.ModelSpec("good", "")))
    assert cli.main(["forecast", "--input", str(tmp_path / "in"), "--h", "2", "--output", str(tmp_path / "out"), "--quantiles", "0.1"]) == 0
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["unique_id", "ds", "yhat", "q0.1"]
    assert cli.main(["health"]) == 0
