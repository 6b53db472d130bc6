"""Session settings shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, for cut lineage.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset, as in local
    tests, a temporary folder of this machine is made and set on the context.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            own = tempfile.mkdtemp(prefix="graphloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            named = f"file://{own}"
        spark.sparkContext.setCheckpointDir(named)
        # Files of a cut go when no frame needs them any more.
        spark.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return named or current


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from there (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, *paths) if x)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder."""
    importable(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
