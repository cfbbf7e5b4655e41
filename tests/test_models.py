"""Baselines, ensembles, context operators, limits, output decoding."""

import datetime as dt
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

import panelcast as pc
from panelcast.functions import context as X
from panelcast.functions import outputs as O
from panelcast.functions.lengths import compatibility, fill_neighbours, fit_exact
from panelcast.operators.baselines import naive, seasonal_naive
from panelcast.operators.ensemble import coverage
from panelcast.plans.registry import ModelSpec


def values(df):
    return {k: [r.yhat for r in df.filter(F.col("unique_id") == k).orderBy("ds").collect()] for k in [r[0] for r in df.select("unique_id").distinct().collect()]}


def test_naive(panel):
    data = pc.build_dataset(panel({"A": [1, 2, 3], "B": [9]}), pc.ForecastConfig(h=3))
    df = naive(data, 3)
    assert values(df) == {"A": [3, 3, 3], "B": [9, 9, 9]}
    assert df.filter("unique_id = 'A'").agg(F.min("ds"), F.max("ds")).first() == (dt.datetime(2024, 1, 4), dt.datetime(2024, 1, 6))


@pytest.mark.parametrize("n", [1, 3, 6, 7, 8, 20])
def test_seasonal_naive_by_position(panel, n):
    y, h, season = list(range(100, 100 + n)), 17, 7
    data = pc.build_dataset(panel({"A": y}), pc.ForecastConfig(h=h))
    want = [y[i] if (i := n - season + k % season) >= 0 else y[-1] for k in range(h)]
    assert values(seasonal_naive(data, h))["A"] == want


def test_unknown_season_repeats_the_last(panel):
    data = pc.build_dataset(panel({"A": [1, 2, 3]}), pc.ForecastConfig(h=2, freq="QE"))
    assert values(seasonal_naive(data, 2))["A"] == [3, 3]


def frames(spark, *columns):
    day = dt.datetime(2024, 1, 1)
    return [spark.createDataFrame([("A", day, v)], "unique_id string, ds timestamp_ntz, yhat double") for v in columns]


def test_ensemble_rules(spark):
    a, b, c, d = frames(spark, 1.0, 2.0, 10.0, 4.0)
    assert pc.ensemble([a, b, c, d]).first().yhat == 3.0
    assert pc.ensemble([a, b, c], "median").first().yhat == 2.0
    assert pc.ensemble([a, b, c, d], "mean").first().yhat == 4.25
    assert pc.ensemble([a]) is a
    nan = frames(spark, float("nan"))[0]
    assert np.isnan(pc.ensemble([a, b, nan]).first().yhat) and np.isnan(pc.ensemble([a, nan], "mean").first().yhat)
    with pytest.raises(pc.EInsufficient):
        pc.ensemble([])
    for bad in ([a], [a, b]):
        with pytest.raises(ValueError):
            pc.ensemble(bad, "mode")


def test_ensemble_quantiles(spark):
    a, b = frames(spark, 1.0, 3.0)
    with_q = a.withColumn("q0.1", F.lit(0.5))
    out = pc.ensemble([with_q, b], "mean", (0.1, 0.9))
    assert out.columns == ["unique_id", "ds", "yhat", "q0.1"] and out.first()["q0.1"] == 0.5
    with pytest.raises(pc.EInsufficient):
        pc.ensemble([with_q, b], "mean", (0.1, 0.9), "strict")
    assert pc.ensemble([with_q, b], "mean", (0.1,), "strict").first().yhat == 2.0
    assert pc.ensemble([with_q.withColumnRenamed("q0.1", "q1.0"), b], "mean", (1, 1.0)).columns[-1] == "q1.0"
    assert pc.ensemble_streaming([a, b], "mean", chunk_size=1).first().yhat == 2.0


def test_ensemble_joins_by_key_not_by_position(panel):
    up = panel({"A": [1, 2], "B": [3, 4]}).withColumnRenamed("y", "yhat")
    out = pc.ensemble([up, up.orderBy(F.desc("yhat"))], "mean")
    assert sorted((r.unique_id, r.yhat) for r in out.collect()) == [("A", 1), ("A", 2), ("B", 3), ("B", 4)]
    assert coverage([up, up.filter("unique_id = 'A'")]).count() == 2


def vector(spark, xs):
    return spark.createDataFrame([(None if xs is None else [None if x is None else float(x) for x in xs],)], "ctx array<double>")


def run(spark, xs, f):
    return vector(spark, xs).select(f(F.col("ctx")).alias("r")).first().r


def test_padding_and_truncation(spark):
    assert run(spark, [1, 3], lambda c: X.left_pad(c, 4)) == [2, 2, 1, 3]
    assert run(spark, [1, 3], lambda c: X.left_pad(c, 4, 0)) == [0, 0, 1, 3]
    assert run(spark, [], lambda c: X.left_pad(c, 2)) == [0, 0]
    assert run(spark, [1, 3], lambda c: X.left_pad(c, 2)) == [1, 3]
    assert run(spark, [1, 2, 3], lambda c: X.keep_last(c, 2)) == [2, 3]
    assert run(spark, [1, 2], lambda c: X.keep_last(c, 3)) == [1, 2]
    assert run(spark, range(5), lambda c: X.exact_length(c, 3)) == [2, 3, 4]
    assert run(spark, [4], lambda c: X.exact_length(c, 3)) == [4, 4, 4]


@pytest.mark.parametrize("n", [0, 2, 4, 5, 8, 9])
def test_both_forms_of_length_adjustment_agree(spark, n):
    spec = ModelSpec("m", "", min_context_length=5, max_context_length=8)
    one = pc.adjust_context_length(np.arange(n, dtype=float), spec)
    col = run(spark, range(n), lambda c: X.adjust_length(c, spec))
    assert col.data == one.data.tolist()
    for name in ("was_padded", "was_truncated", "original_length", "adjusted_length", "padding_amount", "truncation_amount"):
        assert col[name] == getattr(one, name), name


def test_limits_that_may_not_be_met(spark):
    spec = ModelSpec("m", "", min_context_length=5, max_context_length=8, pad_to_min_context=False, truncate_to_max_context=False)
    with pytest.warns(UserWarning):
        assert len(pc.adjust_context_length(np.zeros(2), spec).data) == 2
    assert run(spark, [1, 2], lambda c: X.adjust_length(c, spec)).too_short
    with pytest.raises(ValueError):
        pc.adjust_context_length(np.zeros(9), spec)
    with pytest.raises(Exception, match="exceeds max 8"):
        run(spark, range(9), lambda c: X.adjust_length(c, spec))


def test_cleaning(spark, panel):
    nan, inf = float("nan"), float("inf")
    assert run(spark, [nan, 1, None, 3], X.fill_mean) == [2, 1, 2, 3]
    assert run(spark, [nan, nan], X.fill_mean) == [0, 0] and run(spark, [], X.fill_mean) == [0]
    rows = X.fill_neighbours(panel({"A": [nan, inf, 1, None, -inf, 5], "B": [nan]})).orderBy("unique_id", "ds").collect()
    assert [r.y for r in rows] == [1, 1, 1, 1, 1, 5, 0]
    assert vector(spark, [1]).select(X.to_float(F.col("ctx"))).dtypes[0][1] == "array<float>"


def test_prediction_length():
    spec = ModelSpec("m", "", max_prediction_length=10)
    assert pc.validate_prediction_length(10, spec) == 10
    with pytest.warns(UserWarning, match="max prediction length is 10"):
        assert pc.validate_prediction_length(11, spec) == 10
    with pytest.raises(ValueError):
        pc.validate_prediction_length(11, spec, strict=True)
    assert pc.validate_prediction_length(10**6, ModelSpec("m", "")) == 10**6


def test_effective_limits():
    loaded = type("M", (), {"config": type("C", (), {"context_length": 64})})()
    assert pc.get_effective_limits(pc.get_spec("patchtst_fm"), loaded) == {"min_context": 64, "max_context": 64, "max_prediction": None}
    assert pc.get_effective_limits(pc.get_spec("chronos"), loaded) == {"min_context": None, "max_context": 8192, "max_prediction": 1024}


@pytest.mark.parametrize("n, h", [(10, 5), (2000, 5), (20000, 2000), (993, 1024)])
def test_compatibility_forms_agree(spark, n, h):
    for name in ("timesfm", "chronos", "patchtst_fm", "naive"):
        spec = pc.get_spec(name)
        one = pc.check_data_compatibility(spec, n, h)
        col = spark.range(1).select(compatibility(spec, F.lit(n), h).alias("c")).first().c
        assert (col.compatible, col.issues, col.recommendations) == (one["compatible"], one["issues"], one["recommendations"])
    assert not pc.check_data_compatibility(pc.get_spec("timesfm"), 10, 2000)["compatible"]


def test_decoding_shapes():
    cube = np.arange(2 * 3 * 4, dtype=np.float32).reshape(2, 3, 4)
    levels = [0.1, 0.5, 0.9]
    assert O.extract_point_forecast(cube, 4, levels).tolist() == cube[0, 1].tolist()
    assert O.extract_point_forecast(cube[0].T, 4, levels).tolist() == cube[0, 1].tolist()
    assert O.extract_point_forecast(np.arange(3.0), 5).tolist() == [0, 1, 2, 2, 2]
    assert O.extract_point_forecast(np.zeros(0), 2).tolist() == [0, 0]
    assert O.extract_point_forecast((np.ones((1, 4)), None), 2).tolist() == [1, 1]
    assert O.extract_point_forecast(np.ones((4, 1)), 2).tolist() == [1, 1]
    for bad in (np.zeros((1, 1, 1, 1)), np.array(1.0)):
        with pytest.raises(ValueError):
            O.extract_point_forecast(bad, 1)
    with pytest.raises(ValueError):
        O.extract_predictions_array(None)
    assert [x.tolist() for x in O.extract_batch_forecasts({"prediction_outputs": cube}, 4, 2, levels)] == [cube[0, 1].tolist(), cube[1, 1].tolist()]
    assert len(O.extract_batch_forecasts(cube[:1], 4, 3, levels)) == 3
    assert [x.tolist() for x in O.extract_batch_forecasts(np.arange(6.0), 2, 2)] == [[0, 1], [3, 4]]
    got = O.extract_batch_quantiles(cube, 4, 2, levels)
    assert got[0.9][1].tolist() == cube[1, 2].tolist()
    assert O.extract_batch_quantiles(cube.transpose(0, 2, 1), 4, 2, levels)[0.1][0].tolist() == cube[0, 0].tolist()
    assert O.extract_batch_quantiles(cube, 4, 2, [0.5, 0.6]) == {} and O.extract_batch_quantiles(cube, 4, 2, []) == {}
    square = np.arange(9.0).reshape(1, 3, 3)  # as many steps as levels: rows are the levels
    assert O.extract_batch_quantiles(square, 3, 1, levels)[0.1][0].tolist() == [0, 1, 2]


def test_quantile_indices():
    deciles = [i / 10 for i in range(1, 10)]
    assert O.resolve_quantile_index(0.3, deciles, 9) == 2 and O.resolve_quantile_index(0.3, deciles, 10) == 3
    assert O.resolve_quantile_index(0.95, deciles, 10, O.DECILES) == 9 and O.resolve_quantile_index(0.1, None, 9, O.DECILES) == 0
    assert O.resolve_quantile_index(0.1, None, 5) == 2 and O.resolve_quantile_index(0.1, None, 0) is None
    assert O.select_median_index([0.1, 0.4, 0.9], 3) == 1 and O.select_median_index(None, 4) == 2
    assert O.matched_levels([0.1, 0.5], [0.5, 0.7]) == [0.5] and O.matched_levels([0.1], [0.7]) is None
    assert O.matched_levels(None, [0.7]) == [0.7] and O.matched_levels([0.1, 0.5], None) == [0.5] and O.matched_levels([0.1, 0.4], None) == [0.1, 0.4]


def test_repair_and_samples():
    nan = np.nan
    assert O.repair_nan(np.array([nan, nan]), 7.0).tolist() == [7, 7]
    assert O.repair_nan(np.array([1.0, nan, 3.0]), 7.0).tolist() == [1, 2, 3]
    samples = np.random.default_rng(1).normal(size=(50, 3))
    assert np.allclose(O.sample_quantiles(samples, [0.5])[0], np.median(samples, axis=0))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        O.repair_nan(np.array([1.0]), 0.0)


def test_array_forms():
    nan, inf = np.nan, np.inf
    assert fill_neighbours([nan, inf, 1, nan, 5]).tolist() == [1, 1, 1, 1, 5] and fill_neighbours([nan]).tolist() == [0]
    assert fit_exact([1, 3], 4).tolist() == [2, 2, 1, 3] and fit_exact(range(5), 3).tolist() == [2, 3, 4] and fit_exact([], 2).tolist() == [0, 0]
