"""Shared plumbing of the corpus operators: table access, the shared folder, Arrow helpers."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators import shared
from panelcast.operators.shared import checkpointed  # noqa: F401  a part of this module for the operators

#: Rows of a record batch between the JVM and Python: texts can be long.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Make the session ready: workers get this package, and batches at most BATCH_ROWS rows."""
    shared.ship(spark)
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data (one Parquet file or a folder of them)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; the folder goes when the application ends."""
    path = f"{shared.checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place, files = _hadoop(spark, path)
    files.mkdirs(place)  # only what exists is remembered for deletion
    files.deleteOnExit(place)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    place, files = _hadoop(spark, path)
    files.delete(place, True)


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def place_of(*columns: str | Column) -> Column:
    """A row's place in a sample: a hash of its columns, from 0 up to 2**53."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 53))


def among_smallest(place: Column, n: int, count: Column) -> Column:
    """Whether a place is small enough to be among the n smallest of ``count`` ones.

    Twice as many and a hundred more stay on average, so all n do but for a chance below 10**-20; a row is
    judged by itself, so a sample needs no task that meets all rows.
    """
    return place.cast("double") * count <= F.lit(float((2 * n + 100) << 53))


def together(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """``df`` in n partitions, rows equal in ``columns`` in one of them, for functions over whole partitions.

    A plain ``repartition`` on columns does not promise that: adaptive execution drops it where a join below is
    partitioned alike, and may then read that join's shuffle locally. Partitions by number stay.
    """
    return df.repartitionById(n, F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int"))


def own_column(df: DataFrame, wish: str) -> str:
    """``wish``, lengthened until no column of ``df`` (in any case) has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def text_array(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    """A string column as one array, null as the empty text."""
    col = batch.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    return col.fill_null("") if col.null_count else col
