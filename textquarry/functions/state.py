"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (``spark.checkpoint.dir``).

    Only a local session that names none, as in tests, gets a temporary folder, which goes
    when Python ends.  On a cluster a missing setting is an error: a folder of the driver's
    machine is none that executors share.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="textquarry-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    context.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read back from the shared folder.

    The result is known to the optimiser by its size on disk.  What it estimated of the
    plan isn't carried on: sizes of joins are estimated as products, and over the rounds of
    an iteration they, and the constraints beside them, grow beyond all bounds.
    """
    spark = df.sparkSession
    shared_dir(spark)
    done = df._jdf.checkpoint()
    jvm = spark.sparkContext._jvm
    plan = done.queryExecution().logical()
    file = plan.rdd().getCheckpointFile()
    if not file.isDefined():
        return DataFrame(done, spark)
    where = jvm.org.apache.hadoop.fs.Path(file.get())
    size = max(1, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength())
    none = jvm.scala.Option.empty()
    # the statistics of a range of as many bytes: eight for each number
    known = spark.range(-(-size // 8))._jdf.queryExecution().optimizedPlan().stats()
    session = spark._jsparkSession
    measured = jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, session, jvm.scala.Option.apply(known), none
    )
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, measured), spark)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path in the shared folder, if it is there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def is_directory(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
