"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.sources.workspace import delete, new_path, shared_dir


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and
    the rows survive the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files behind tables made by :func:`materialize` that nothing reads any more."""
    for df in tables:
        root = shared_dir(df.sparkSession) + "/"
        mark = root.split("://", 1)[-1].split("/", 1)[-1]  # the store may name its files another way than the folder
        for folder in {f.split(mark, 1)[1].split("/", 1)[0] for f in df.inputFiles() if mark in f}:
            delete(df.sparkSession, root + folder)


def n_partitions(spark: SparkSession) -> int:
    """Partitions for an explicit shuffle: the session's own setting, which is sized to the cluster and its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application wrote to the shared folder; results that read them must be written by then."""
    delete(spark, shared_dir(spark))
