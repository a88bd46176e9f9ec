"""Where intermediate results go: the folder all executors share."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='graphloom-')}/graphloom_package", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session leaves it unset and runs on one machine (tests) a
    temporary folder is made and set as the checkpoint folder; a cluster without
    a shared folder is an error, for no executor could read another's disk.
    """
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(said)
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/graphloom/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage replaced by files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder: columns and filters still push down into it."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)  # digests in hexadecimal take half
    return spark.read.schema(df.schema).parquet(path)
