"""Tables in the folder that all executors share: what is written there is computed once, and its lineage ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_name(spark: SparkSession) -> str:
    """A new name in spark.checkpoint.dir; only in local mode, where it is unset, in a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="slidegrid-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/slidegrid-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    path = shared_name(df.sparkSession)
    df.write.option("compression", "lz4").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def full_uri(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, as Hadoop's settings of the session say."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
