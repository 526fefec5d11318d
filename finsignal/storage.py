"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary one for a local master (tests), and an
    error for any other: executors on other machines would write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="finsignal-")
        found = _OWN[app]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder. All places of one application lie in one folder, finsignal-<application id>,
    which may be removed once the results are written."""
    return f"{shared_dir(spark)}/finsignal-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts lineage and survives lost executors: nothing is recomputed from earlier steps.
    """
    path, schema = new_path(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder at this path, in whatever store Spark reads it from? Other failures are raised."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
