"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir or was given; a temporary one only where all runs in one process."""
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="docledger-")
        spark.sparkContext.setCheckpointDir(folder)
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
    return given.get()


def work_folder(spark: SparkSession) -> str:
    """A new folder's name beside the checkpoints."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """The rows written once, so that several outputs do not compute them again and later joins start from plain columns."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As ``staged``, for many wide rows: as compressed columns, of which later steps read those that they need. Types that Parquet has not
    are left to a checkpoint."""
    if re.search(r"\b(void|interval|variant)\b", df.schema.simpleString()):
        return staged(df)
    to = work_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)
