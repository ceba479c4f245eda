"""From raw documents to the one flat post table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.functions import text as tx
from threadloom.functions.keywords import Dictionary


def project_page_posts(posts: DataFrame, dictionary: Dictionary, platform: str = "a") -> DataFrame:
    """Posts read from pages, cleaned, tagged and with their references resolved."""
    flat = posts.select(
        F.lit(platform).alias("platform"),
        F.col("id").alias("pid"),
        "conversation_id",
        F.col("author_id").alias("author"),
        tx.last_reference(F.col("referenced_tweets"), "replied_to").alias("parent_id"),
        F.col("in_reply_to_user_id").alias("parent_author"),
        tx.last_reference(F.col("referenced_tweets"), "quoted").alias("quote_id"),
        tx.clean_whitespace(F.col("text")).alias("text"),
        "created_at",
        F.lit(False).alias("is_stub"),
    )
    return conform(dictionary.tag(flat))


def project_thread_posts(posts: DataFrame, stubs: DataFrame, dictionary: Dictionary, platform: str = "b") -> DataFrame:
    """Posts read from threads, tagged, followed by the stubs of hidden replies."""
    return conform(
        dictionary.tag(posts)
        .unionByName(stubs, allowMissingColumns=True)
        .withColumn("platform", F.lit(platform))
    )


def conform(posts: DataFrame) -> DataFrame:
    """The columns of the post table, absent ones null."""
    present = set(posts.columns)
    return posts.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.POSTS
        ]
    )


def seed_summary(posts: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Matched posts of the ``data`` arm with their topics."""
    searched = posts.where(F.col("is_include") == 0).select(
        F.col("id").alias("tweet_id"), "conversation_id", "text"
    )
    return (
        dictionary.tag(searched)
        .where(F.size("topics") > 0)
        .select("tweet_id", "conversation_id", "topics")
    )


def own_conversation(posts: DataFrame, key: Column) -> DataFrame:
    """Fill a missing conversation id from the table's key, keep rows of that key only."""
    filled = posts.withColumn("conversation_id", F.coalesce("conversation_id", key))
    return filled.where(F.col("conversation_id") == key)


def drop_null_text(corpus: DataFrame, text: str = "text", clean: str | None = None) -> DataFrame:
    """Drop rows without text and, if a cleaned column is named, rows cleaned to nothing."""
    kept = corpus.dropna(subset=[text])
    return kept if clean is None else kept.where(F.col(clean) != "")


def harmonise(posts: DataFrame, platform: str, renames: dict[str, str]) -> DataFrame:
    """Common names and a platform tag, ready to stack."""
    return posts.withColumnsRenamed(renames).withColumn("platform", F.lit(platform))


OFF_TOPIC = "Off_topic"
UNDECIDED = ("Not sure", "discuss")


def recode_off_topic(df: DataFrame, topic: str = "final_topic", flags: tuple[str, ...] = schemas.TOPICS) -> DataFrame:
    """Undecided, missing or keyword-free posts become off topic."""
    no_keyword = sum((F.col(f) for f in flags), F.lit(0)) == 0
    undecided = F.col(topic).isNull() | F.col(topic).isin(*UNDECIDED)
    return df.withColumn(topic, F.when(undecided | no_keyword, OFF_TOPIC).otherwise(F.col(topic)))


def recover_missing(posts: DataFrame, page_posts: DataFrame, locations: DataFrame) -> DataFrame:
    """Seed posts that a retrieved conversation lacks, fetched again from their pages.

    ``locations`` says in which page file and arm a seed was seen. Only
    conversations that have a table are completed. Returns raw page posts, to
    be projected like any other.
    """
    retrieved = posts.select("conversation_id").distinct()
    have = posts.select("conversation_id", F.col("pid").alias("tweet_id"))
    wanted = (
        locations.join(retrieved, "conversation_id", "left_semi")
        .join(have, ["conversation_id", "tweet_id"], "left_anti")
        .select("filename", F.col("includes").alias("is_include"), F.col("tweet_id").alias("id"))
        .distinct()
    )
    return page_posts.join(wanted, ["filename", "is_include", "id"], "left_semi")
