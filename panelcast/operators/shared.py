"""What a cluster needs: this package on its workers, and materialisation in the shared folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_LEAVING: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors once per application.

    Worker functions are pickled by reference, so every Python worker must be able to import
    them; a cluster's workers share no folder with the driver.
    """
    sc = spark.sparkContext
    if not any(f.endswith("panelcast_src.zip") for f in sc._python_includes):
        target = os.path.join(tempfile.mkdtemp(), "panelcast_src.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(PACKAGE.parent))
        sc.addPyFile(target)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it.

    It is set here only where the session has none and all its executors are in this process (tests); on a
    cluster its absence is an error. What this application writes there goes when it ends.
    """
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = os.path.join(tempfile.gettempdir(), "panelcast-checkpoints")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(place)
    own = sc.getCheckpointDir()  # a folder of this application's own in that place
    if own not in _LEAVING:
        _LEAVING.add(own)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return place


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
