"""Tables written to a folder that all executors see, to cut the lineage of iterative plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import LatticaError


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset a temporary folder in local mode, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.conf.get("spark.lattica.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise LatticaError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + _temporary()
        spark.conf.set("spark.lattica.shared.dir", path)
    return path.rstrip("/")


def _temporary() -> str:
    """A folder of this process, removed when it ends."""
    path = tempfile.mkdtemp(prefix="lattica-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """Write the table and read it back; survives lost executors and ends the lineage."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
