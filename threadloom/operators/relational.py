"""Joins, set algebra, de-duplication and the search-slot plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as tx


def join_loadings(posts: DataFrame, loadings: DataFrame) -> DataFrame:
    """Topic loadings with the conversation of their post."""
    return posts.select("pid", "conversation_id").join(loadings, "pid")


def join_codes(posts: DataFrame, codes: DataFrame) -> DataFrame:
    """Every post of every hand-coded conversation, with the codes.

    The small side is broadcast by the planner when it is small; otherwise a
    long conversation is split by the runtime's skew handling.
    """
    return posts.join(codes, "conversation_id")


def join_stats_labels(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Conversation statistics with the topic the conversation was given."""
    return stats.join(labels, "conversation_id")


def sample_overlay(stats: DataFrame, coded: DataFrame) -> DataFrame:
    """On-topic hand-coded conversations, both scores in units of a grid cell."""
    joined = join_stats_labels(stats, coded).where(F.col("final_on_topic") == "Yes")
    return joined.withColumns(
        {name: F.col(name) * 10 for name in ("tox_mean", "new_topic_spread")}
    )


def label_coverage(labeled: DataFrame, corpus: DataFrame) -> DataFrame:
    """Posts and distinct conversations per label, of the labelled posts in a corpus."""
    per_conversation = (
        labeled.select("pid", "final_topic")
        .join(corpus.select("pid", "conversation_id"), "pid")
        .groupBy("final_topic", "conversation_id")
        .agg(F.count("*").alias("_posts"))
    )
    return per_conversation.groupBy("final_topic").agg(
        F.sum("_posts").alias("n_posts"), F.count("conversation_id").alias("n_conversations")
    )


def remaining(wanted: DataFrame, *done: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Rows of ``wanted`` whose key is in none of the ``done`` sets."""
    for seen in done:
        wanted = wanted.join(seen.select(key).distinct(), key, "left_anti")
    return wanted


def restrict(rows: DataFrame, ids: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Rows whose key is in ``ids``."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def set_union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right).distinct()


def set_intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def stack(**tables: DataFrame) -> DataFrame:
    """Tables one below the other, each row tagged with the name of its table."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in tables.items()]
    stacked = tagged[0]
    for df in tagged[1:]:
        stacked = stacked.unionByName(df, allowMissingColumns=True)
    return stacked


def dedup_rows(df: DataFrame) -> DataFrame:
    """One of each set of identical rows."""
    return df.dropDuplicates()


def dedup_keep(df: DataFrame, key: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """The first or last row per key in an explicit order.

    A partial aggregate: a key with very many rows is reduced where they are
    read, never gathered and sorted in one task.
    """
    pick = {"first": F.min_by, "last": F.max_by}[keep]
    rest = [c for c in df.columns if c not in key]
    chosen = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(chosen).select(*key, "_row.*").select(*df.columns)


def seed_threads(seeds: DataFrame, row_order: str) -> DataFrame:
    """``thread_id`` to its keyword and thread path; the last seed row wins."""
    latest = dedup_keep(
        seeds.select("thread_id", "keyword", "permalink", row_order), ["thread_id"], [row_order], "last"
    )
    return latest.select(
        "thread_id", "keyword", tx.thread_path(F.col("permalink")).alias("path")
    )


def slot_plan(
    keywords: DataFrame, start: Column, end: Column, step_hours: int = 6
) -> DataFrame:
    """Search slots per keyword, from ``start`` while the slot begins no later than ``end``.

    ``start`` and ``end`` are epoch seconds and may differ by keyword. Each row
    of ``keywords`` unfolds its own slots; nothing is joined.
    """
    step = step_hours * 3600
    return keywords.where(start <= end).select(
        "keyword", F.explode(F.sequence(start, end, F.lit(step).cast("long"))).alias("after")
    ).withColumn("before", F.col("after") + step)
