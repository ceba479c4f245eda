"""Writers: the post table, tab-separated exports and set maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.keywords import join_topics
from threadloom.functions.text import clean_whitespace


def write_posts(posts: DataFrame, path: str, mode: str = "append") -> None:
    """Write posts by platform, in ranges of conversations.

    Files hold consecutive ranges and are sorted, so that a reader of few
    conversations skips most files and most of the rest; a conversation too
    large for one file may span neighbours. ``overwrite`` replaces only the
    platforms present in ``posts``.
    """
    order = ["platform", "conversation_id", "pid"]
    (
        posts.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("platform")
        .parquet(path)
    )


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated export, header in every file, sets joined, nothing quoted.

    Blanks in strings are collapsed, since a tab or line break would end a cell.
    """
    flat = df.select(*[_cell(f).alias(f.name) for f in df.schema])
    (
        flat.write.mode(mode)
        .option("sep", "\t")
        .option("header", "true")
        .option("quote", "")
        .option("escape", "")
        .option("emptyValue", "")
        .csv(path)
    )


def _cell(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.ArrayType):
        column = join_topics(column)
    elif not isinstance(field.dataType, T.StringType):
        return column
    return clean_whitespace(column)


def write_topic_map(pairs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``topic -> ids`` as JSON lines in one folder per topic.

    A topic may own any share of the ids, so its set is a folder of lines and
    never one value.
    """
    pairs.select("topic", "conversation_id").distinct().write.mode(mode).partitionBy("topic").json(path)


def write_conversation_map(pairs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``id -> [topics]``, one JSON object per conversation."""
    conversation_topics(pairs).write.mode(mode).json(path)


def conversation_topics(pairs: DataFrame) -> DataFrame:
    """The sorted topics of each conversation; their number is bounded by the dictionary."""
    return pairs.groupBy("conversation_id").agg(
        F.array_sort(F.collect_set("topic")).alias("topics")
    )
