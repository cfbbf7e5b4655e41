"""One local session for all tests; the checkpoint folder is theirs."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), str(ROOT / "tests"), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("test data not found")
    return str(path)


@pytest.fixture()
def panel(spark):
    """Build a panel from {id: values} of daily rows from 2024-01-01."""
    import datetime as dt

    def make(series, start=dt.datetime(2024, 1, 1), step=dt.timedelta(days=1)):
        rows = [(k, start + i * step, None if v is None else float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")

    return make
