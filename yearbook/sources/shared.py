"""Tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The folders made by this driver and not yet deleted, in the order made.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, a local session, as in tests, takes the warehouse; a
    cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    _made.append(f"{base.rstrip('/')}/yearbook-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows of build(), written; the folders that build made on its way are deleted.

    For a step of a job whose result alone goes on: a DataFrame that an operator
    returns still reads what it has written, and keeps it otherwise."""
    before = len(_made)
    out = written(build())
    for path in _made[before:-1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    del _made[before:-1]
    return out
