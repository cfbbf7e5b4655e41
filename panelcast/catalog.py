"""The registered queries of the forecasting operators, each with the SQL it must agree with.

Output columns of quantiles are named ``q0_1`` here; sums of doubles are rounded, as engines add in
different orders.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.config import ForecastConfig
from panelcast.functions import context as X
from panelcast.functions.freq import future
from panelcast.functions.lengths import compatibility
from panelcast.operators import covariates as C
from panelcast.operators import providers as P
from panelcast.operators.baselines import naive, seasonal_naive
from panelcast.operators.ensemble import coverage, ensemble_with_quantiles
from panelcast.operators.panel import CovariateSet, TSDataset, validation_report
from panelcast.plans.planner import make_plan
from panelcast.plans.registry import REGISTRY, ModelSpec
from panelcast.sources import panel_from
from panelcast.streaming import ensemble_streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# --- panels ------------------------------------------------------------------------------------


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _money(c: str):
    return F.round(F.sum(c), 2)


def daily(spark: SparkSession, d: str) -> DataFrame:
    return panel_from(_read(spark, d, "events"), "event_type", "ts", _money("value"))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return panel_from(_read(spark, d, "events"), "event_type", "ts", _money("value"), "hour")


def users(spark: SparkSession, d: str) -> DataFrame:
    return panel_from(_read(spark, d, "events"), "user_id", "ts", _money("value"))


def monthly(spark: SparkSession, d: str) -> DataFrame:
    return panel_from(_read(spark, d, "orders"), "o_orderpriority", "o_orderdate", _money("o_totalprice"), "month")


def weekly(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("l_shipdate")
    sunday = F.when(F.dayofweek(day) == 1, day).otherwise(F.next_day(day, "SUN")).cast("timestamp_ntz")
    return _read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("unique_id"), sunday.alias("ds")).agg(_money("l_quantity").alias("y"))


def business(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "orders").filter(F.weekday("o_orderdate") < 5)
    return panel_from(rows, "o_orderstatus", "o_orderdate", F.count(F.lit(1)).cast("double"))


def weeks(spark: SparkSession, d: str) -> DataFrame:
    """All events by week: fewer weeks than a season has."""
    day = F.to_date("ts")
    sunday = F.when(F.dayofweek(day) == 1, day).otherwise(F.next_day(day, "SUN")).cast("timestamp_ntz")
    return _read(spark, d, "events").groupBy(F.col("event_type").alias("unique_id"), sunday.alias("ds")).agg(_money("value").alias("y"))


PANELS: dict[str, tuple[Query, str, str]] = {
    "daily": (daily, "D", "SELECT event_type AS unique_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ds, round(sum(value), 2) AS y FROM events GROUP BY 1, 2"),
    "hourly": (hourly, "h", "SELECT event_type AS unique_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ds, round(sum(value), 2) AS y FROM events GROUP BY 1, 2"),
    "users": (users, "D", "SELECT user_id AS unique_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ds, round(sum(value), 2) AS y FROM events GROUP BY 1, 2"),
    "monthly": (monthly, "MS", "SELECT o_orderpriority AS unique_id, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ds, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2"),
    "weekly": (weekly, "W", "SELECT l_returnflag AS unique_id, CAST(CAST(l_shipdate AS DATE) + CAST((7 - dayofweek(l_shipdate)) % 7 AS INTEGER) AS TIMESTAMP) AS ds, round(sum(l_quantity), 2) AS y FROM lineitem GROUP BY 1, 2"),
    "business": (business, "B", "SELECT o_orderstatus AS unique_id, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ds, CAST(count(*) AS DOUBLE) AS y FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1, 2"),
    "weeks": (weeks, "W", "SELECT event_type AS unique_id, CAST(CAST(ts AS DATE) + CAST((7 - dayofweek(ts)) % 7 AS INTEGER) AS TIMESTAMP) AS ds, round(sum(value), 2) AS y FROM events GROUP BY 1, 2"),
}


def dataset(panel: str, spark: SparkSession, d: str, h: int = 7, freq: str | None = None, covariates: CovariateSet | None = None) -> TSDataset:
    make, own, _ = PANELS[panel]
    return TSDataset.from_dataframe(make(spark, d), ForecastConfig(h=h, freq=freq or own), covariates)


def _panel_sql(panel: str) -> str:
    return f"WITH panel AS ({PANELS[panel][2]})"


def _ix_sql(panel: str) -> str:
    return f"{_panel_sql(panel)}, ix AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS rn, count(*) OVER (PARTITION BY unique_id) AS n FROM panel), lasts AS (SELECT unique_id, ds AS last_ds, y AS last_y, n FROM ix WHERE rn = n)"


for _name in ("daily", "hourly", "monthly", "weekly", "business"):
    _query(f"panel_{_name}", PANELS[_name][2])(PANELS[_name][0])

_query("panel_users", PANELS["users"][2])(users)


@_query(
    "validate_report",
    f"{_panel_sql('daily')} SELECT count(*) AS n_rows, count(*) FILTER (WHERE unique_id IS NULL) AS missing_unique_id, count(*) FILTER (WHERE ds IS NULL) AS missing_ds, count(*) FILTER (WHERE y IS NULL OR isnan(y)) AS missing_y FROM panel",
)
def _(spark, d):
    return validation_report(daily(spark, d))


@_query(
    "validate_report_nulls",
    "SELECT count(*) AS n_rows, count(*) FILTER (WHERE event_id % 11 = 0) AS missing_unique_id, count(*) FILTER (WHERE event_id % 13 = 0) AS missing_ds, count(*) FILTER (WHERE event_id % 7 = 0 OR event_id % 5 = 0) AS missing_y FROM events",
)
def _(spark, d):
    e = _read(spark, d, "events")
    i = F.col("event_id")
    return validation_report(
        e.select(
            F.when(i % 11 != 0, F.col("event_type")).alias("unique_id"),
            F.when(i % 13 != 0, F.col("ts")).alias("ds"),
            F.when(i % 7 == 0, F.lit(None)).when(i % 5 == 0, F.lit(float("nan"))).when(i % 3 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("y"),
        )
    )


@_query("series_stats", f"{_panel_sql('users')} SELECT unique_id, count(*) AS n, min(ds) AS start_ds, max(ds) AS last_ds, arg_max(y, ds) AS last_y FROM panel GROUP BY 1")
def _(spark, d):
    return dataset("users", spark, d).lengths()


@_query("panel_stats", f"{_panel_sql('users')}, c AS (SELECT unique_id, count(*) AS n FROM panel GROUP BY 1) SELECT count(*) AS n_series, min(n) AS min_length, max(n) AS max_length FROM c")
def _(spark, d):
    return dataset("users", spark, d).stats()


@_query("series_filter", f"{_panel_sql('daily')} SELECT * FROM panel WHERE unique_id = 'click'")
def _(spark, d):
    return dataset("daily", spark, d).get_series("click").select("unique_id", "ds", "y")


@_query("series_vectors", f"{_panel_sql('daily')} SELECT unique_id, count(*) AS n, min(ds) AS start_ds, max(ds) AS last_ds, list(y ORDER BY ds) AS ctx FROM panel GROUP BY 1")
def _(spark, d):
    return dataset("daily", spark, d).series()


@_query("series_newest", f"{_ix_sql('users')} SELECT unique_id, list(y ORDER BY ds) AS ctx FROM ix WHERE n - rn < 10 GROUP BY 1")
def _(spark, d):
    return dataset("users", spark, d).series(10).select("unique_id", "ctx")


# --- calendars ---------------------------------------------------------------------------------

# SQL of the first anchor at or after date d, and of m steps on from it.
_STEP_SQL = {
    "D": "d + CAST(m AS INTEGER)",
    "W": "d + CAST((7 - dayofweek(d)) % 7 + 7 * m AS INTEGER)",
    "B": "b + CAST(m + 2 * ((isodow(b) - 1 + m) // 5) AS INTEGER)",
    "MS": "CASE WHEN day(d) = 1 THEN d ELSE date_trunc('month', d) + INTERVAL 1 MONTH END + to_months(CAST(m AS INTEGER))",
    "ME": "last_day(CAST(date_trunc('month', d) + to_months(CAST(m AS INTEGER)) AS DATE))",
    "QS": "CASE WHEN d = date_trunc('quarter', d) THEN d ELSE date_trunc('quarter', d) + INTERVAL 3 MONTH END + to_months(CAST(3 * m AS INTEGER))",
    "QE": "last_day(CAST(date_trunc('quarter', d) + to_months(CAST(2 + 3 * m AS INTEGER)) AS DATE))",
    "YS": "CASE WHEN d = date_trunc('year', d) THEN d ELSE date_trunc('year', d) + INTERVAL 12 MONTH END + to_months(CAST(12 * m AS INTEGER))",
    "YE": "last_day(CAST(date_trunc('year', d) + to_months(CAST(11 + 12 * m AS INTEGER)) AS DATE))",
    "SMS": "CAST(date_trunc('month', d) + to_months(CAST((CASE WHEN day(d) = 1 THEN 0 WHEN day(d) <= 15 THEN 1 ELSE 2 END + m) // 2 AS INTEGER)) AS DATE) + CAST(14 * ((CASE WHEN day(d) = 1 THEN 0 WHEN day(d) <= 15 THEN 1 ELSE 2 END + m) % 2) AS INTEGER)",
    "SME": "CASE WHEN (CASE WHEN day(d) <= 15 THEN 0 ELSE 1 END + m) % 2 = 0 THEN CAST(date_trunc('month', d) + to_months(CAST((CASE WHEN day(d) <= 15 THEN 0 ELSE 1 END + m) // 2 AS INTEGER)) AS DATE) + 14 ELSE last_day(CAST(date_trunc('month', d) + to_months(CAST((CASE WHEN day(d) <= 15 THEN 0 ELSE 1 END + m) // 2 AS INTEGER)) AS DATE)) END",
}


def _period_sql(months: int, anchor: int, end: bool, business: bool) -> str:
    """SQL of the anchor m periods on from date d: a period starts or ends in month ``anchor``, on a weekday or not."""
    away = "CASE isodow({x}) WHEN 6 THEN {sat} WHEN 7 THEN {sun} ELSE 0 END"

    def point(month: str) -> str:
        x = f"last_day({month})" if end else month
        return f"({x} + CAST({away.format(x=x, sat=-1 if end else 2, sun=-2 if end else 1)} AS INTEGER))" if business else x

    off = f"(({anchor} - month(d)) % {months} + {months}) % {months}" if end else f"-(((month(d) - {anchor}) % {months} + {months}) % {months})"
    near = f"CAST(date_trunc('month', d) + to_months(CAST({off} AS INTEGER)) AS DATE)"
    first = f"(CASE WHEN d <= {point(near)} THEN {near} ELSE CAST({near} + to_months({months}) AS DATE) END)"
    return point(f"CAST({first} + to_months(CAST({months} * m AS INTEGER)) AS DATE)")


for _letters, _rule in (("BMS", (1, 1, False, True)), ("BME", (1, 1, True, True)), ("QS-OCT", (3, 10, False, False)), ("QE-NOV", (3, 11, True, False)), ("YS-APR", (12, 4, False, False)), ("YE-JUN", (12, 6, True, False)), ("BQE", (3, 12, True, True))):
    _STEP_SQL[_letters] = _period_sql(*_rule)


def _future_sql(last: str, letters: str, n: int, h: int) -> str:
    """SQL of (unique_id, ds): h steps of n periods after ``last`` (unique_id, last_ds)."""
    steps = f"SELECT unique_id, last_ds, CAST(last_ds AS DATE) AS d, k * {n} AS m, CAST(last_ds AS DATE) + CAST(CASE isodow(last_ds) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS INTEGER) AS b FROM {last}, (SELECT unnest(range(1, {h + 1})) AS k)"
    if letters in ("h", "min"):
        unit = "hours" if letters == "h" else "minutes"
        return f"SELECT unique_id, last_ds + to_{unit}(m) AS ds FROM ({steps})"
    return f"SELECT unique_id, CAST({_STEP_SQL[letters]} AS TIMESTAMP) + (last_ds - CAST(CAST(last_ds AS DATE) AS TIMESTAMP)) AS ds FROM ({steps})"


def _future_query(name: str, panel: str, letters: str, n: int = 1, h: int = 9) -> None:
    last = f"(SELECT unique_id, max(ds) AS last_ds FROM ({PANELS[panel][2]}) GROUP BY 1)"

    @_query(f"future_index_{name}", _future_sql(last, letters, n, h))
    def _(spark, d):
        return dataset(panel, spark, d, h, f"{n if n > 1 else ''}{letters}").future_index()


for _args in (
    ("d", "daily", "D"), ("h", "hourly", "h"), ("w", "weekly", "W"), ("ms", "monthly", "MS"), ("me", "business", "ME"), ("qs", "monthly", "QS"), ("qe", "monthly", "QE"),
    ("b", "business", "B"), ("ys", "business", "YS"), ("ye", "business", "YE"), ("2ms", "business", "MS", 2), ("3b", "weekly", "B", 3), ("2w", "daily", "W", 2), ("15min", "hourly", "min", 15),
    ("bms", "business", "BMS"), ("bme", "business", "BME"), ("qs_oct", "monthly", "QS-OCT"), ("qe_nov", "monthly", "QE-NOV"), ("ys_apr", "business", "YS-APR"), ("ye_jun", "business", "YE-JUN"),
    ("sms", "daily", "SMS"), ("sme", "daily", "SME"),
):
    _future_query(*_args)

_CALENDAR = " UNION ALL ".join(
    f"SELECT '{f}' AS freq, unique_id, ds FROM ({_future_sql('(SELECT o_orderkey AS unique_id, o_orderdate + to_minutes(o_orderkey % 1440) AS last_ds FROM orders)', f, 2, 3)})" for f in _STEP_SQL
)


@_query("future_calendar", _CALENDAR)
def _(spark, d):
    """Two-period steps of every anchored frequency from each order's date, at odd times of day."""
    last = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    rows = _read(spark, d, "orders").select(F.col("o_orderkey").alias("unique_id"), last.alias("last_ds"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    # a projection a frequency: all in one would be too large to be compiled
    return reduce(DataFrame.unionAll, [rows.select(F.lit(f).alias("freq"), "unique_id", future(F.col("last_ds"), F.col("k"), f"2{f}").alias("ds")) for f in _STEP_SQL])


# --- baselines and ensembles -------------------------------------------------------------------


def _naive_sql(panel: str, letters: str, h: int) -> str:
    return f"{_ix_sql(panel)}, f AS ({_future_sql('lasts', letters, 1, h)}) SELECT f.unique_id, f.ds, last_y AS yhat FROM f JOIN lasts USING (unique_id)"


def _seasonal_sql(panel: str, letters: str, h: int, season: int) -> str:
    f = _future_sql("lasts", letters, 1, h)
    return (
        f"{_ix_sql(panel)}, f AS (SELECT unique_id, ds, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS k FROM ({f})), "
        f"g AS (SELECT f.unique_id, f.ds, last_y, n - {season} + ((k - 1) % {season}) + 1 AS src FROM f JOIN lasts USING (unique_id)) "
        "SELECT g.unique_id, g.ds, coalesce(ix.y, g.last_y) AS yhat FROM g LEFT JOIN ix ON ix.unique_id = g.unique_id AND ix.rn = g.src"
    )


def _baseline_queries(name: str, panel: str, letters: str, h: int, season: int) -> None:
    @_query(f"naive_{name}", _naive_sql(panel, letters, h))
    def _(spark, d):
        return naive(dataset(panel, spark, d, h), h)

    @_query(f"seasonal_naive_{name}", _seasonal_sql(panel, letters, h, season))
    def _(spark, d):
        return seasonal_naive(dataset(panel, spark, d, h), h)


for _args in (("d", "daily", "D", 10, 7), ("h", "hourly", "h", 30, 24), ("ms", "monthly", "MS", 15, 12), ("w", "weekly", "W", 60, 52), ("b", "business", "B", 12, 5), ("users", "users", "D", 14, 7), ("short", "weeks", "W", 10, 52)):
    _baseline_queries(*_args)


def _both_sql(panel: str, letters: str, h: int, season: int) -> str:
    return f"(SELECT * FROM ({_naive_sql(panel, letters, h)}) UNION ALL SELECT * FROM ({_seasonal_sql(panel, letters, h, season)}))"


def _ensemble_query(name: str, panel: str, letters: str, h: int, season: int, method: str) -> None:
    how = {"median": "median(yhat)", "mean": "avg(yhat)"}[method]

    @_query(name, f"SELECT unique_id, ds, round({how}, 6) AS yhat FROM {_both_sql(panel, letters, h, season)} GROUP BY 1, 2")
    def _(spark, d):
        data = dataset(panel, spark, d, h)
        out = ensemble_with_quantiles([naive(data, h), seasonal_naive(data, h)], method)
        return out.select("unique_id", "ds", F.round("yhat", 6).alias("yhat"))


_ensemble_query("ens_median", "daily", "D", 7, 7, "median")
_ensemble_query("ens_mean", "daily", "D", 7, 7, "mean")
_ensemble_query("ens_users", "users", "D", 7, 7, "median")
_ensemble_query("ens_monthly", "monthly", "MS", 12, 12, "mean")


@_query("ens_streaming", SQL["ens_mean"])
def _(spark, d):
    data = dataset("daily", spark, d)
    out = ensemble_streaming([naive(data, 7), seasonal_naive(data, 7)], "mean", chunk_size=5)
    return out.select("unique_id", "ds", F.round("yhat", 6).alias("yhat"))


def _with_levels(df: DataFrame, levels: dict[str, float]) -> DataFrame:
    return df.select("unique_id", "ds", "yhat", *[(F.col("yhat") * f).alias(q) for q, f in levels.items()])


def _renamed(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), 6).alias(c.replace(".", "_")) if c[0] == "q" or c == "yhat" else F.col(c) for c in df.columns])


_N, _S = _naive_sql("daily", "D", 7), _seasonal_sql("daily", "D", 7, 7)
_THIRD = "SELECT unique_id, ds, yhat * 1.5 AS yhat FROM"


@_query(
    "ens_quantiles",
    f"SELECT unique_id, ds, round(median(yhat), 6) AS yhat, round(median(lo), 6) AS q0_1, round(median(hi), 6) AS q0_9 FROM (SELECT unique_id, ds, yhat, yhat * 0.9 AS lo, yhat * 1.1 AS hi FROM ({_N}) UNION ALL SELECT unique_id, ds, yhat, yhat * 0.8, yhat * 1.2 FROM ({_S}) UNION ALL SELECT unique_id, ds, yhat, yhat * 0.7, yhat * 1.3 FROM ({_THIRD} ({_N}))) GROUP BY 1, 2",
)
def _(spark, d):
    data = dataset("daily", spark, d)
    a, b = naive(data, 7), seasonal_naive(data, 7)
    third = a.withColumn("yhat", F.col("yhat") * 1.5)
    parts = [_with_levels(a, {"q0.1": 0.9, "q0.9": 1.1}), _with_levels(b, {"q0.1": 0.8, "q0.9": 1.2}), _with_levels(third, {"q0.1": 0.7, "q0.9": 1.3})]
    return _renamed(ensemble_with_quantiles(parts, "median", (0.1, 0.9)))


@_query(
    "ens_quantiles_partial",
    f"SELECT unique_id, ds, round(avg(yhat), 6) AS yhat, round(avg(lo), 6) AS q0_1 FROM (SELECT unique_id, ds, yhat, yhat * 0.9 AS lo FROM ({_N}) UNION ALL SELECT unique_id, ds, yhat, NULL FROM ({_S})) GROUP BY 1, 2",
)
def _(spark, d):
    data = dataset("daily", spark, d)
    return _renamed(ensemble_with_quantiles([_with_levels(naive(data, 7), {"q0.1": 0.9}), seasonal_naive(data, 7)], "mean", (0.1, 0.9)))


@_query(
    "ens_nan",
    f"SELECT unique_id, ds, CASE WHEN count(*) FILTER (WHERE isnan(yhat)) > 0 THEN 'NaN'::DOUBLE ELSE round(median(yhat), 6) END AS yhat FROM (SELECT unique_id, ds, CASE WHEN day(ds) % 2 = 0 THEN 'NaN'::DOUBLE ELSE yhat END AS yhat FROM ({_N}) UNION ALL SELECT * FROM ({_S})) GROUP BY 1, 2",
)
def _(spark, d):
    data = dataset("daily", spark, d)
    a = naive(data, 7).withColumn("yhat", F.when(F.dayofmonth("ds") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("yhat")))
    return _renamed(ensemble_with_quantiles([a, seasonal_naive(data, 7)], "median"))


@_query("ens_single", f"SELECT unique_id, ds, yhat, 'naive' AS model FROM ({_N})")
def _(spark, d):
    """One forecast is returned as it is, other columns included."""
    return ensemble_with_quantiles([naive(dataset("daily", spark, d), 7).withColumn("model", F.lit("naive"))], "median", (0.5,), "strict")


@_query("ens_carried", f"SELECT unique_id, ds, round(avg(yhat), 6) AS yhat, max(note) AS note FROM (SELECT *, unique_id || day(ds) AS note FROM ({_N}) UNION ALL SELECT *, NULL FROM ({_S})) GROUP BY 1, 2")
def _(spark, d):
    """Other columns of the first forecast come along."""
    data = dataset("daily", spark, d)
    first = naive(data, 7).withColumn("note", F.concat("unique_id", F.dayofmonth("ds").cast("string")))
    return _renamed(ensemble_with_quantiles([first, seasonal_naive(data, 7)], "mean"))


@_query("ens_coverage", f"SELECT unique_id, ds, count(*) AS n_models FROM (SELECT unique_id, ds FROM ({_N}) UNION ALL SELECT unique_id, ds FROM ({_S}) WHERE day(ds) % 2 = 0) GROUP BY 1, 2 HAVING count(*) <> 2")
def _(spark, d):
    """Where a model gives no forecast."""
    data = dataset("daily", spark, d)
    return coverage([naive(data, 7), seasonal_naive(data, 7).filter(F.dayofmonth("ds") % 2 == 0)])


# --- context, limits, batches ------------------------------------------------------------------

_SPEC = ModelSpec("example", "", min_context_length=35, max_context_length=40)
_TIGHT = ModelSpec("example", "", min_context_length=5, max_context_length=12)
_VECTORS = f"{_panel_sql('daily')}, v AS (SELECT unique_id, list(y ORDER BY ds) AS ctx FROM panel GROUP BY 1)"


def _struct_sql(data: str, padded: str, cut: str, pad: str, trunc: str) -> str:
    return f"{_VECTORS} SELECT unique_id, list_transform({data}, lambda x: round(x, 9)) AS data, {padded} AS was_padded, {cut} AS was_truncated, len(ctx) AS original_length, len({data}) AS adjusted_length, {pad} AS padding_amount, {trunc} AS truncation_amount FROM v"


def _adjusted(spark: SparkSession, d: str, spec: ModelSpec, fill: float | None) -> DataFrame:
    rows = dataset("daily", spark, d).series().select("unique_id", X.adjust_length(F.col("ctx"), spec, fill).alias("a"))
    names = ("was_padded", "was_truncated", "original_length", "adjusted_length", "padding_amount", "truncation_amount")
    return rows.select("unique_id", F.transform("a.data", lambda x: F.round(x, 9)).alias("data"), *[F.col(f"a.{n}").cast("bigint" if "was" not in n else "boolean").alias(n) for n in names])


_PAD = "CASE WHEN len(ctx) < 35 THEN list_concat(list_resize([]::DOUBLE[], greatest(35 - len(ctx), 0), {fill}), ctx) ELSE ctx END"


@_query("ctx_pad", _struct_sql(_PAD.format(fill="-1.0"), "len(ctx) < 35", "false", "greatest(35 - len(ctx), 0)", "CAST(0 AS BIGINT)"))
def _(spark, d):
    return _adjusted(spark, d, _SPEC, -1.0)


@_query("ctx_pad_mean", _struct_sql(_PAD.format(fill="list_avg(ctx)"), "len(ctx) < 35", "false", "greatest(35 - len(ctx), 0)", "CAST(0 AS BIGINT)"))
def _(spark, d):
    return _adjusted(spark, d, _SPEC, None)


@_query("ctx_too_short", f"{_VECTORS} SELECT unique_id, len(ctx) < 35 AS too_short, false AS was_padded, len(ctx) AS adjusted_length FROM v")
def _(spark, d):
    """Too short for a model that may not be padded: flagged, unchanged."""
    spec = ModelSpec("example", "", min_context_length=35, pad_to_min_context=False)
    rows = dataset("daily", spark, d).series().select("unique_id", X.adjust_length(F.col("ctx"), spec).alias("a"))
    return rows.select("unique_id", "a.too_short", "a.was_padded", F.col("a.adjusted_length").cast("bigint").alias("adjusted_length"))


@_query("ctx_float", f"{_VECTORS} SELECT unique_id, list_transform(ctx, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE)) AS ctx FROM v")
def _(spark, d):
    return dataset("daily", spark, d).series().select("unique_id", X.to_float(F.col("ctx")).cast("array<double>").alias("ctx"))


@_query("ctx_truncate", _struct_sql("ctx[-12:]", "false", "len(ctx) > 12", "CAST(0 AS BIGINT)", "greatest(len(ctx) - 12, 0)"))
def _(spark, d):
    return _adjusted(spark, d, _TIGHT, None)


@_query("ctx_exact", f"{_VECTORS} SELECT unique_id, list_transform(ctx[-20:], lambda x: round(x, 9)) AS short, list_transform(list_concat(list_resize([]::DOUBLE[], greatest(45 - len(ctx), 0), list_avg(ctx)), ctx), lambda x: round(x, 9)) AS long FROM v")
def _(spark, d):
    each = lambda n: F.transform(X.exact_length(F.col("ctx"), n), lambda x: F.round(x, 9))
    return dataset("daily", spark, d).series().select("unique_id", each(20).alias("short"), each(45).alias("long"))


def _gappy(spark: SparkSession, d: str) -> DataFrame:
    """Single events as a panel, with null, NaN and infinite values by rule."""
    i = F.col("event_id")
    y = F.when(i % 7 == 0, F.lit(None)).when(i % 11 == 0, F.lit(float("nan"))).when(i % 13 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return _read(spark, d, "events").select(F.col("user_id").alias("unique_id"), F.col("ts").alias("ds"), y.alias("y"))


_GAPPY = "SELECT user_id AS unique_id, ts AS ds, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL ELSE value END AS y FROM events"


@_query(
    "ctx_sanitize_ffill",
    f"SELECT unique_id, ds, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(y IGNORE NULLS) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS y FROM ({_GAPPY})",
)
def _(spark, d):
    return X.fill_neighbours(_gappy(spark, d)).select("unique_id", "ds", "y")


@_query(
    "ctx_sanitize_mean",
    f"WITH g AS ({_GAPPY.replace(' OR event_id % 13 = 0', '')}) SELECT unique_id, list(round(coalesce(y, m), 9) ORDER BY ds) AS ctx FROM (SELECT *, coalesce(avg(y) OVER (PARTITION BY unique_id), 0.0) AS m FROM g) GROUP BY 1",
)
def _(spark, d):
    i = F.col("event_id")
    y = F.when(i % 7 == 0, F.lit(float("nan"))).when(i % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = _read(spark, d, "events").select(F.col("user_id").alias("unique_id"), F.col("ts").alias("ds"), y.alias("y"))
    data = TSDataset.from_dataframe(rows, ForecastConfig(h=1, freq="h"))
    return data.series().select("unique_id", F.transform(X.fill_mean(F.col("ctx")), lambda x: F.round(x, 9)).alias("ctx"))


@_query("length_batches", f"{_panel_sql('users')}, c AS (SELECT unique_id, count(*) AS n FROM panel GROUP BY 1) SELECT unique_id, n, CAST((row_number() OVER (ORDER BY n, unique_id) - 1) // 16 AS BIGINT) AS batch FROM c")
def _(spark, d):
    return P.length_batches(dataset("users", spark, d).lengths().select("unique_id", "n"), 16)


@_query(
    "compat_check",
    f"{_panel_sql('users')}, c AS (SELECT unique_id, count(*) AS n FROM panel GROUP BY 1) SELECT unique_id, false AS compatible, ['Prediction length 2000 exceeds max 1024'] AS issues, list_concat(['Reduce horizon to 1024 or use AR generation'], CASE WHEN n < 993 THEN ['Will pad context from ' || n || ' to 993'] ELSE [] END) AS recommendations FROM c",
)
def _(spark, d):
    rows = dataset("users", spark, d).lengths()
    return rows.select("unique_id", compatibility(REGISTRY["timesfm"], F.col("n"), 2000).alias("c")).select("unique_id", "c.*")


# --- covariates --------------------------------------------------------------------------------

_COUNTS = "SELECT event_type AS unique_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ds, CASE WHEN min(day(ts)) % 3 > 0 THEN CAST(count(*) AS DOUBLE) END AS n_events FROM events GROUP BY 1, 2"


def _past(spark: SparkSession, d: str) -> DataFrame:
    """Event counts of all days, unknown on every third."""
    rows = panel_from(_read(spark, d, "events"), "event_type", "ts", F.count(F.lit(1)).cast("double"))
    return rows.select("unique_id", "ds", F.when(F.dayofmonth("ds") % 3 > 0, F.col("y")).alias("n_events"))


@_query("cov_past_align", f"{_panel_sql('daily')} SELECT p.unique_id, list(coalesce(c.n_events, 'NaN'::DOUBLE) ORDER BY p.ds) AS n_events FROM panel p LEFT JOIN ({_COUNTS}) c USING (unique_id, ds) GROUP BY 1")
def _(spark, d):
    data = dataset("daily", spark, d, covariates=CovariateSet(past=_past(spark, d)))
    return C.past_block(data).select("unique_id", F.col("block")["n_events"].alias("n_events"))


def _future_frame(spark: SparkSession, d: str) -> DataFrame:
    """Ten future days of a price by rule; one event type has only three."""
    rows = dataset("daily", spark, d, 10).future_index()
    rows = rows.filter((F.col("unique_id") != "view") | (F.col("ds") < F.lit("2024-02-03").cast("timestamp_ntz")))
    return rows.withColumn("price", (F.dayofmonth("ds") * 1.5).cast("double"))


@_query(
    "cov_future_block",
    f"{_panel_sql('daily')}, c AS (SELECT unique_id, count(*) AS n, max(ds) AS last FROM panel GROUP BY 1) SELECT unique_id, list_concat(list_resize([]::DOUBLE[], n, 0.0), CASE WHEN unique_id = 'view' AND last >= TIMESTAMP '2024-01-27' THEN list_resize([]::DOUBLE[], 7, 0.0) ELSE list_transform(range(1, 8), lambda k: CAST(day(last + to_days(CAST(k AS INTEGER))) * 1.5 AS DOUBLE)) END) AS price FROM c",
)
def _(spark, d):
    data = dataset("daily", spark, d, covariates=CovariateSet(future=_future_frame(spark, d)))
    return C.future_block(data, 7).select("unique_id", F.col("block")["price"].alias("price"))


@_query("cov_static_join", "SELECT CAST(c.k AS BIGINT) AS unique_id, n_name, r_name FROM (SELECT DISTINCT c_nationkey AS k FROM customer) c LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) ON n_nationkey = c.k")
def _(spark, d):
    nations = _read(spark, d, "nation").join(_read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    static = nations.select(F.col("n_nationkey").cast("bigint").alias("unique_id"), "n_name", "r_name")
    rows = _read(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("unique_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ds"), F.col("c_acctbal").alias("y"))
    return C.static_join(TSDataset.from_dataframe(rows, ForecastConfig(h=1), CovariateSet(static=static)))


@_query("cov_for_series", "SELECT CAST(n_nationkey AS BIGINT) AS unique_id, n_name FROM nation WHERE n_nationkey = 7")
def _(spark, d):
    static = _read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("unique_id"), "n_name")
    return dataset("users", spark, d, covariates=CovariateSet(static=static)).get_covariates_for_series(7, "static")


@_query("cov_extended_index", f"{_panel_sql('daily')}, l AS (SELECT unique_id, max(ds) AS last_ds FROM panel GROUP BY 1) SELECT unique_id, ds FROM panel UNION {_future_sql('l', 'D', 1, 7)}")
def _(spark, d):
    return C.extended_index(dataset("daily", spark, d), 7)


@_query("cov_extended_target", f"{_VECTORS} SELECT unique_id, list_concat(ctx, list_resize([]::DOUBLE[], 3, 'NaN'::DOUBLE)) AS target FROM v")
def _(spark, d):
    return dataset("daily", spark, d).series().select("unique_id", C.extended_target(F.col("ctx"), 3).alias("target"))


# --- providers ---------------------------------------------------------------------------------


class _Deciles:
    """A deterministic model: the last context value plus the step; deciles 10 apart."""

    def forecast(self, horizon, inputs):
        point = np.stack([np.float32(np.round(x[-1])) + np.arange(1, horizon + 1, dtype=np.float32) for x in inputs])
        return point, np.stack([point + 10 * i for i in range(10)], axis=2)


class DummyDeciles(P.DecileProvider):
    def load(self, device):
        return _Deciles()


class DummyQuantiles(P.QuantileProvider):
    """A deterministic model with NaN steps: every third step of every level, and all of level 0.9."""

    def load(self, device):
        return None

    def call(self, model, batch, levels):
        steps = np.arange(1, batch.h + 1, dtype=np.float32)
        base = np.where(steps % 3 == 0, np.nan, steps)
        return {"quantile_predictions": np.stack([np.stack([np.full(batch.h, np.nan) if q > 0.8 else base + 10 * i for i, q in enumerate(levels)]) for _ in batch.ids])}


class DummySamples(P.SampleProvider):
    """Deterministic sample paths: step * sample for samples 0 to 9."""

    def load(self, device):
        return self

    def predict(self, inputs, h, covariates):
        paths = np.arange(10)[:, None] * np.arange(1, h + 1)[None, :]
        return np.broadcast_to(paths[None, :, None, :], (len(inputs), 10, 1, h))


def _levels(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), 4).alias(c.replace(".", "_")) if c[0] == "q" or c == "yhat" else F.col(c) for c in df.columns])


_STEPS = f"{_ix_sql('users')}, f AS (SELECT unique_id, ds, CAST(row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS DOUBLE) AS k FROM ({_future_sql('lasts', 'D', 1, 7)}))"


@_query("dummy_provider_forecast", f"{_STEPS} SELECT f.unique_id, f.ds, round_even(last_y, 0) + k AS yhat, round_even(last_y, 0) + k + 10 AS q0_1, round_even(last_y, 0) + k + 50 AS q0_5, round_even(last_y, 0) + k + 90 AS q0_9 FROM f JOIN lasts USING (unique_id)")
def _(spark, d):
    return _levels(P.predict(DummyDeciles(REGISTRY["timesfm"]), dataset("users", spark, d), 7, (0.1, 0.5, 0.9)))


@_query("provider_nan_repair", f"{_STEPS} SELECT unique_id, ds, CASE WHEN CAST(k AS INT) % 3 = 0 THEN 3.8 ELSE k END + 10 AS yhat, CASE WHEN CAST(k AS INT) % 3 = 0 THEN 3.8 ELSE k END AS q0_1, CASE WHEN CAST(k AS INT) % 3 = 0 THEN 3.8 ELSE k END + 10 AS q0_5, CAST(NULL AS DOUBLE) AS q0_9 FROM f")
def _(spark, d):
    spec = REGISTRY["patchtst_fm"]
    return _levels(P.predict(DummyQuantiles(spec, 64, (0.1, 0.5, 0.9)), dataset("users", spark, d), 7, (0.1, 0.5, 0.9)))


@_query("sample_quantiles", f"{_STEPS}, s AS (SELECT unique_id, ds, k * s AS v FROM f, (SELECT unnest(range(0, 10)) AS s)) SELECT unique_id, ds, round(quantile_cont(v, 0.5), 4) AS yhat, round(quantile_cont(v, 0.1), 4) AS q0_1, round(quantile_cont(v, 0.9), 4) AS q0_9 FROM s GROUP BY 1, 2")
def _(spark, d):
    return _levels(P.predict(DummySamples(REGISTRY["chronos"]), dataset("users", spark, d), 7, (0.1, 0.9)))


class DummyWidths(P.SampleProvider):
    """Forecasts what it was given: a thousand times the padded length, and the padding's zeros."""

    def load(self, device):
        return self

    def predict(self, inputs, h, covariates):
        zeros = np.cumprod(inputs[:, 0, :] == 0, axis=1).sum(axis=1)
        return np.repeat((1000.0 * inputs.shape[2] + zeros)[:, None, None, None], h, axis=3)


class DummyCovariates(P.SampleProvider):
    """Forecasts the covariates it was given: their sum, and a thousand times their width."""

    def load(self, device):
        return self

    def predict(self, inputs, h, covariates):
        return np.repeat((covariates.sum(axis=(1, 2)) + 1000.0 * covariates.shape[2])[:, None, None, None], h, axis=3)


class DummyShort(P.DecileProvider):
    """A model that forecasts two steps fewer than asked."""

    def load(self, device):
        return self

    def forecast(self, horizon, inputs):
        point = np.tile(np.arange(1.0, horizon - 1), (len(inputs), 1))
        return point, np.stack([point + 10 * i for i in range(10)], axis=2)


class DummyOwnLevels(P.QuantileProvider):
    """A loaded model that names its levels and forecasts two steps fewer than asked: the last one stands for them."""

    def load(self, device):
        return SimpleNamespace(config=SimpleNamespace(context_length=8, quantile_levels=[0.1, 0.5, 0.9]))

    def call(self, model, batch, levels):
        own = model.config.quantile_levels
        steps = np.arange(1, batch.h - 1, dtype=np.float32)
        return {"quantile_predictions": np.stack([np.stack([steps + 10 * own.index(q) for q in levels]) for _ in batch.ids])}


@_query(
    "provider_padding",
    f"{_ix_sql('users')}, b AS (SELECT unique_id, n, (row_number() OVER (ORDER BY n, unique_id) - 1) // 16 AS batch FROM lasts), w AS (SELECT unique_id, n, max(n) OVER (PARTITION BY batch) AS wide FROM b), f AS ({_future_sql('lasts', 'D', 1, 2)}) SELECT f.unique_id, f.ds, CAST(1000 * wide + wide - n AS DOUBLE) AS yhat FROM f JOIN w USING (unique_id)",
)
def _(spark, d):
    rows = dataset("users", spark, d, 2)
    positive = TSDataset.from_dataframe(rows.df.withColumn("y", F.abs("y") + 1), rows.config)
    return P.predict(DummyWidths(REGISTRY["chronos"]), positive, 2, batch_size=16)


@_query(
    "provider_covariates",
    f"{_ix_sql('daily')}, f AS ({_future_sql('lasts', 'D', 1, 7)}), c AS (SELECT unique_id, (SELECT max(n) FROM lasts) + 7 AS wide, CASE WHEN unique_id = 'view' AND last_ds >= TIMESTAMP '2024-01-27' THEN 0.0 ELSE list_sum(list_transform(range(1, 8), lambda k: CAST(day(last_ds + to_days(CAST(k AS INTEGER))) * 1.5 AS DOUBLE))) END AS total FROM lasts) SELECT f.unique_id, f.ds, 1000 * wide + total AS yhat FROM f JOIN c USING (unique_id)",
)
def _(spark, d):
    """Aligned on the right, zeros over the past and for a series with too few future rows."""
    data = dataset("daily", spark, d, covariates=CovariateSet(future=_future_frame(spark, d)))
    return P.predict(DummyCovariates(REGISTRY["chronos"]), data, 7)


@_query("provider_short_output", f"{_STEPS} SELECT unique_id, ds, k AS yhat FROM f WHERE k <= 5")
def _(spark, d):
    return _levels(P.predict(DummyShort(REGISTRY["timesfm"]), dataset("users", spark, d), 7))


@_query("provider_own_levels", f"{_STEPS} SELECT unique_id, ds, least(k, 5) AS yhat, least(k, 5) AS q0_1, CAST(NULL AS DOUBLE) AS q0_7 FROM f")
def _(spark, d):
    return _levels(P.predict(DummyOwnLevels(REGISTRY["patchtst_fm"]), dataset("users", spark, d), 7, (0.1, 0.7)))


@_query("plan_selection", "SELECT * FROM (VALUES ('all', 0, 'chronos'), ('all', 1, 'timesfm'), ('fast', 0, 'timesfm'), ('fast', 1, 'chronos'), ('accurate', 0, 'moirai'), ('accurate', 1, 'chronos')) t(selection, place, model)")
def _(spark, d):
    rows = [(s, i, m.name) for s in ("all", "fast", "accurate") for i, m in enumerate(make_plan(config=ForecastConfig(h=1, model_selection=s, max_models=2)))]
    return spark.createDataFrame(rows, "selection string, place int, model string")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
