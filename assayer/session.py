"""Session helpers: lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that names none
    gets a temporary folder; a cluster without one is an error, because executors could
    not read each other's files.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="assayer-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back, dropping its lineage.

    One job, where an eager checkpoint runs the plan twice; and the table's size is known, so
    Spark broadcasts it only when it is small.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/assayer/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no later plan reads; any other DataFrame is left alone."""
    for table in tables:
        path = getattr(table, "cut_path", None)
        if path:
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame) -> DataFrame:
    """Fix a metadata table (one row per column or per rule) so that reports on it do not scan the data again."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
