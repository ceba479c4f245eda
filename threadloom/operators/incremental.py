"""Append-only batches: what is new, and where a keyword's search resumes.

A batch is written to a hidden folder and becomes visible by one rename to the next number, which only
one run can take. A run that dies before has changed nothing that is read, and may be repeated; of two
runs at once the later one takes out what the earlier one has meanwhile added. The rename must not
replace a folder that exists, as on local disks and HDFS.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.relational import remaining, slot_plan
from threadloom.session import rename_new


def batches(spark: SparkSession, path: str) -> list[str]:
    """The folders of the batches that are visible, in their order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batch-*")
    found = pattern.getFileSystem(conf).globStatus(pattern) or []
    return sorted(str(f.getPath()) for f in found)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all visible batches."""
    return spark.read.parquet(*batches(spark, path))


def publish(spark: SparkSession, staged: str, path: str, number: int) -> bool:
    """Make a written batch visible under its number; false if another run has taken that."""
    return rename_new(spark, staged, f"{path.rstrip('/')}/batch-{number:08d}")


def process_new_only(
    rows: DataFrame, path: str, key: str, process: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Process the rows whose key is not in the output yet, add them as one batch, return the whole output.

    ``process`` keeps the ``key``. Rows that it drops are new again in the next run.
    """
    spark = rows.sparkSession
    seen = batches(spark, path)
    fresh = rows if not seen else remaining(rows, spark.read.parquet(*seen).select(key), key=key)
    added = process(fresh)
    while True:
        staged = f"{path.rstrip('/')}/_staged/{uuid.uuid4().hex}"
        added.write.parquet(staged)
        if publish(spark, staged, path, len(seen) + 1):
            return read_batches(spark, path)
        now = batches(spark, path)
        others = spark.read.parquet(*now[len(seen) :]).select(key)
        added, seen = remaining(spark.read.parquet(staged), others, key=key), now


def resume_points(posts: DataFrame, at: str = "epoch") -> DataFrame:
    """The latest recorded time per keyword."""
    return posts.groupBy("keyword").agg(F.max(at).alias("resume_at"))


def resumed_slots(keywords: DataFrame, posts: DataFrame, start: Column, end: Column, step_hours: int = 6) -> DataFrame:
    """The slots still to search: from the last recorded time, else from the start."""
    known = keywords.join(resume_points(posts), "keyword", "left")
    begin = F.coalesce(F.col("resume_at"), start)
    return slot_plan(known, begin, end, step_hours)
