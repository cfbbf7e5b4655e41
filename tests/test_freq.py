"""Calendars against pandas' date_range on a grid of start days, multiples and steps."""

import datetime as dt
import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.functions import freq as fq


@pytest.mark.parametrize("letters", [
    "D", "W", "W-WED", "B", "C", "MS", "ME", "BMS", "BME", "QS", "QE", "QS-OCT", "QS-FEB", "QE-NOV", "BQS", "BQE", "BQS-MAY", "BQE-JAN", "YS", "YE", "YS-APR", "YE-JUN", "BYS", "BYE", "BYE-SEP",
    "SMS", "SME", "h", "min", "s", "ms", "us",
])
def test_future_equals_pandas(spark, letters):
    starts = [dt.datetime(2023, 12, 20) + dt.timedelta(days=i, hours=i % 24, minutes=i % 60) for i in range(0, 440, 3)]
    base = spark.createDataFrame([(s,) for s in starts], "last timestamp_ntz").select("last", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k"))
    for n in (1, 2, 3):
        f = f"{n}{letters}"
        got = {(r[0], r[1]): r[2] for r in base.select("last", "k", fq.future(F.col("last"), F.col("k"), f)).collect()}
        for s in starts:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                want = pd.date_range(start=s, periods=7, freq=f)[1:]
            assert [got[s, k] for k in range(1, 7)] == [w.to_pydatetime() for w in want], (f, s)


def test_unaligned_last_skips_a_period(spark):
    table = [("2024-01-31", "ME", "2024-02-29"), ("2024-01-15", "ME", "2024-02-29"), ("2024-01-15", "MS", "2024-03-01"), ("2024-01-06", "B", "2024-01-09"), ("2024-01-03", "W", "2024-01-14"), ("2024-01-31", "QE", "2024-06-30"), ("2024-02-10", "QS", "2024-07-01"), ("2024-01-15", "2MS", "2024-04-01")]
    for last, f, want in table:
        row = spark.sql(f"select timestamp_ntz'{last}' as last").select(fq.future(F.col("last"), F.lit(1), f)).first()
        assert row[0] == dt.datetime.fromisoformat(want), (last, f)


@pytest.mark.parametrize("freq, season", [("D", 7), ("2D", 7), ("B", 5), ("H", 24), ("h", 24), ("T", 60), ("15min", 60), ("M", 12), ("ME", 12), ("MS", 12), ("Q", 4), ("QS", 4), ("W", 52), ("QE", None), ("W-MON", None)])
def test_season_length(freq, season):
    assert fq.season_length(freq) == season


def test_aliases_and_unknown_frequencies():
    assert [fq.normalize_alias(f) for f in ("H", "2H", "M", "3M", "MS", "D")] == ["h", "2h", "ME", "3ME", "MS", "D"]
    for bad in ("", "xyz", "0D", "QS-FOO", "MS-FEB", "D-MON", "W-FEB", "1.5D", "ns"):
        with pytest.raises(ValueError):
            fq.check(bad)


@pytest.mark.parametrize("freq", ["D", "h", "15min", "W", "W-WED", "B", "MS", "ME", "2MS", "BMS", "QS", "QE", "QS-OCT", "QE-NOV", "YS", "YE", "YS-APR", "YE-JUN"])
def test_periods_step_as_their_frequency(freq):
    stamps = pd.date_range("2024-01-31", periods=4, freq=freq)
    alias = fq.period_alias(freq)
    periods = [pd.Period(s, freq=alias) for s in stamps]
    assert len(set(periods)) == 4
    first = pd.Period(stamps[0], freq=alias)
    assert [first + k for k in range(4)] == periods  # a step of the period is a step of the frequency


def test_spellings_of_pandas():
    assert [fq.pandas_alias(f) for f in ("H", "2T", "Q", "Q-NOV", "A-JUN", "BM", "W-WED", "15min")] == ["h", "2min", "QE", "QE-NOV", "YE-JUN", "BME", "W-WED", "15min"]
