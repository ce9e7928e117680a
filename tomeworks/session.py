"""Session helpers: how workers find the package, and where shared tables go."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, at most, but for one row that is larger.
BATCH_BYTES = 16 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep Arrow batches of long texts small.

    On a cluster the package is shipped with --py-files or installed; this adds its folder for
    workers that share the driver's file system.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in [ROOT, *paths] if p)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir).

    Only a local session without that setting gets a temporary folder of its own; a cluster
    without it is an error, as a machine-local folder would be lost with its executor.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tomeworks-")
        warnings.warn(f"spark.checkpoint.dir isn't set; this local session keeps its tables in {where}", stacklevel=2)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def app_dir(spark: SparkSession) -> str:
    """This application's own folder within the shared one: tables that lazy results still read are left there."""
    return f"{shared_dir(spark)}/tomeworks-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application stored. Results that haven't been written elsewhere are lost."""
    discard(spark, app_dir(spark))


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{app_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that stored() wrote."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
