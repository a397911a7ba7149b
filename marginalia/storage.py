"""The folder that driver and executors share, and tables written there to fix rows and end lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []  # tables of this process that clean() may delete


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only on one machine, where driver and executors are one process,
    may it be unset; then a temporary folder is made and set. A cluster must name a folder that all share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='marginalia-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there, the
    rows are fixed, and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes the tables that written() has made so far and returns how many; to be called when no
    DataFrame made with them is needed any more, as between the jobs of a long-lived session."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done
