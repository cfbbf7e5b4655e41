"""Every registered forecasting query against its SQL, and the driver's contract."""

import sys

import duckdb
import numpy as np
import pytest

from panelcast import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return "nan" if v != v else round(v, 7) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - {"future_calendar"}))
def test_query_agrees_with_sql(spark, data_dir, duck, name):
    df = catalog.queries()[name](spark, data_dir)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    ours = sorted(map(repr, (plain(list(r)) for r in df.select(*sorted(df.columns)).collect())))
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert ours == sorted(map(repr, (plain([r[i] for i in order]) for r in want.fetchall())))


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["unique_id", "ds", "yhat"] and df.count() == 35
    assert set(catalog.queries()) <= set(entry.queries())


def test_library_does_not_import_the_corpus_operators():
    import subprocess

    code = "import sys, panelcast, panelcast.catalog, panelcast.cli; print(any(m.startswith('panelcast.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=catalog.__file__.rsplit("/", 2)[0]).stdout.strip() == "False"
