"""Keeping archives current as rows of files arrive.

The manifest of a run is a table (name, key) in the shared folder. Each micro batch renders the archives that it touches,
writes those that changed, and appends their keys; the newest key of a name counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tomeworks.operators import incremental, render
from tomeworks.session import shared_dir


def latest(keys: DataFrame) -> DataFrame:
    """(name, key) of the newest batch of each name."""
    return keys.groupBy("name").agg(F.max_by("key", "batch").alias("key"))


def keep_current(files: DataFrame, where: str, sink: Callable[[DataFrame], None], stamp: str, llm: bool = False, once: bool = True) -> StreamingQuery:
    """Start a query over a stream of (archive_id, rel_path, content); sink gets the changed archives (archive_id, text) of each batch.

    All files seen so far are kept below `where`, so an archive is rendered whole. A batch that is run again after a failure
    overwrites its own files and keys, so none counts twice; the newest content of a path counts.
    """
    spark: SparkSession = files.sparkSession

    def exists(path: str) -> bool:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def batch(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{where}/files/batch={n}")
        seen = spark.read.parquet(f"{where}/files").filter(F.col("batch") <= n)
        touched = rows.select("archive_id").distinct()
        whole = seen.join(touched, "archive_id", "left_semi").groupBy("archive_id", "rel_path").agg(F.max_by("content", "batch").alias("content"))
        made = render.archives(whole, llm, stamp).select("archive_id", "text")
        now = incremental.keyed(made, "archive_id").join(made.withColumnRenamed("archive_id", "name"), "name")
        if exists(f"{where}/keys"):
            old = spark.read.parquet(f"{where}/keys").filter(F.col("batch") < n)
            now = incremental.changed(now, latest(old))
        now.write.mode("overwrite").parquet(f"{where}/made/batch={n}")
        done = spark.read.parquet(f"{where}/made/batch={n}")
        sink(done.select(F.col("name").alias("archive_id"), "text"))
        done.select("name", "key").write.mode("overwrite").parquet(f"{where}/keys/batch={n}")

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", f"{where}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def default_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/watch"
