"""Session helpers that behave alike on a laptop and on a cluster."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, one of our own on a single machine.

    On a cluster an unset folder is an error: a temporary folder there is another one on each machine.
    """
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf = os.path.join(tempfile.gettempdir(), "pagemill-shared")
    sc.setCheckpointDir(conf)
    return jsc.getCheckpointDir().get()


_FOLDERS: list = []


def new_folder(spark: SparkSession) -> str:
    """A folder of this session in the shared folder; all of them are removed when the driver ends or by ``remove_folders``."""
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    if not _FOLDERS:
        atexit.register(remove_folders)
    _FOLDERS.append((spark, path))
    return path


def remove_folders() -> None:
    """Delete what ``materialise`` and ``new_folder`` wrote in this process; tables read from it can't be used after."""
    while _FOLDERS:
        spark, path = _FOLDERS.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: its folder is left to the cluster's own cleaning
            continue


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and the rows survive lost executors."""
    path = new_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
