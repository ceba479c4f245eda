"""Search-result pages: JSON objects with a ``data`` arm and an ``includes`` arm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.functions import text as tx


def read_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Page objects and the file each came from. Unreadable files are left out, with what they hold.

    :func:`threadloom.sources.packed.read_packed` reads them up to their damage and reports it.

    One object per line, any number per file; ``multi_line`` reads objects that
    were written over several lines. Pages packed into larger files carry the
    name of their own file in ``filename``.
    """
    raw = (
        spark.read.schema(schemas.PAGE)
        .option("ignoreCorruptFiles", "true")
        .option("multiLine", str(multi_line).lower())
        .json(path)
    )
    return with_filename(raw)


def with_filename(raw: DataFrame, file: str = "_metadata.file_path") -> DataFrame:
    """The name a page carries, else that of its ``file``."""
    name = F.coalesce("filename", file).alias("filename")
    return raw.select("data", "includes", "meta", name)


def _arm(posts: Column, is_include: int) -> Column:
    return F.transform(
        F.coalesce(posts, F.array().cast(schemas.PAGE["data"].dataType)),
        lambda p: F.struct(p.alias("post"), F.lit(is_include).alias("is_include")),
    )


def page_posts(pages: DataFrame) -> DataFrame:
    """One row per post of either arm, in one pass over the pages.

    A page without ``data`` is skipped; a page without ``includes`` is not.
    """
    both = F.concat(_arm(F.col("data"), 0), _arm(F.col("includes.tweets"), 1))
    return (
        pages.where(F.col("data").isNotNull())
        .select("filename", F.explode(both).alias("_row"))
        .select("filename", "_row.is_include", "_row.post.*")
    )


def empty_conversations(pages: DataFrame) -> DataFrame:
    """Ids, from the file names, of pages that report no results."""
    return (
        pages.where(F.col("meta.result_count") == 0)
        .select(tx.key_before(F.col("filename"), "_").alias("conversation_id"))
        .distinct()
    )


def seed_locations(posts: DataFrame) -> DataFrame:
    """Where each post can be found again: page file and arm."""
    return posts.select(
        "conversation_id",
        F.col("id").alias("tweet_id"),
        "filename",
        F.col("is_include").alias("includes"),
    )
