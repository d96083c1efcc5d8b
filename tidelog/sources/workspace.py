"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application's own in the one named by ``spark.checkpoint.dir`` or set as the context's checkpoint folder.

    Where neither is set, a temporary folder serves a local master; a cluster's
    executors wouldn't see one, so there that is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_ = context._jsc.sc().getCheckpointDir()
        named = set_.get() if set_.isDefined() else None
    if not named:
        named = spark.conf.get("spark.tidelog.shared.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.tidelog.shared.dir", named)
    return f"{named.rstrip('/')}/tidelog/{context.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
