"""The same operators over arriving files: tagging, de-duplication, volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom import schemas
from threadloom.functions.keywords import Dictionary
from threadloom.operators import posts as post_ops
from threadloom.session import discard, materialise
from threadloom.sources import pages as page_source


def arriving(spark: SparkSession, path: str, schema: T.StructType, kind: str, **options: str) -> DataFrame:
    """A folder watched for new files."""
    reader = spark.readStream.schema(schema).format(kind)
    return reader.options(**options).load(path)


def arriving_pages(spark: SparkSession, path: str, **options: str) -> DataFrame:
    raw = arriving(spark, path, schemas.PAGE, "json", ignoreCorruptFiles="true", **options)
    return page_source.with_filename(raw)


def tag_pages(pages: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Seed summaries of arriving pages; keeps no state."""
    return post_ops.seed_summary(page_source.page_posts(pages), dictionary)


def dedup_within(rows: DataFrame, key: str, at: str, horizon: str) -> DataFrame:
    """Posts that arrive more than once within ``horizon`` of each other, once.

    State is kept for one horizon only; choose it no shorter than the time in
    which a post can be retrieved again.
    """
    return rows.withWatermark(at, horizon).dropDuplicatesWithinWatermark([key])


def volume(rows: DataFrame, at: str = "ts", by: str = "keyword", width: str = "6 hours") -> DataFrame:
    """Posts per keyword and slot."""
    return (
        rows.groupBy(by, F.window(at, width).alias("slot"))
        .agg(F.count("*").alias("n"))
        .select(by, F.col("slot.start").alias("slot_start"), "n")
    )


def run_append(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process everything available now into a table, each row written exactly once."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_volume(
    rows: DataFrame, out: str, checkpoint: str, at: str = "ts", by: str = "keyword", width: str = "6 hours"
) -> DataFrame:
    """:func:`volume` of everything that has arrived, over any number of runs.

    Each trigger counts what it brought and adds these counts to a table; they
    are summed when the table is read. The stream keeps no state, a late post
    counts like any other, and a trigger that is retried replaces its own part.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        volume(batch, at, by, width).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    parts = rows.sparkSession.read.parquet(out)
    return parts.groupBy(by, "slot_start").agg(F.sum("n").alias("n"))


def unseen(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The rows of a written batch whose key is not stored yet, each key once; rows without a key all stay.

    Only the key column of what is stored is read, and reduced to the keys that came again before
    anything else is joined. The planner knows the size of the written batch: a small one is broadcast to
    the stored keys, which are then not shuffled; before a larger one's shuffle they pass a Bloom filter of
    the batch where the session's runtime filters allow it.
    """
    arrived = batch.select(key).where(F.col(key).isNotNull())
    again = stored.select(key).join(arrived, key, "left_semi")
    keyed = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
    fresh = keyed.join(again, key, "left_anti").select(*batch.columns)
    return fresh.unionByName(batch.where(F.col(key).isNull()))


def run_dedup_ever(rows: DataFrame, out: str, checkpoint: str, key: str) -> DataFrame:
    """Add what is available now to a table that has every key once, however long ago it first came.

    The stream has no state: the table itself says what has been seen, so that memory does not grow with
    time. A trigger writes its own part and compares with the parts before it, hence a trigger that is
    retried replaces its part and changes no other. ``out`` and ``checkpoint`` belong together.
    Of rows with one key in one trigger any one stays.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        arrived = materialise(batch, "arrivals")
        if epoch:
            stored = batch.sparkSession.read.parquet(out).where(F.col("epoch") < epoch)
            fresh = unseen(arrived, stored, key)
        else:
            fresh = unseen(arrived, arrived.limit(0), key)
        fresh.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        discard(arrived)

    query = (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return rows.sparkSession.read.parquet(out).select(*rows.columns)
