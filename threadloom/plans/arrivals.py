"""Incremental batches and Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import keywords as kw
from threadloom.functions import text as tx
from threadloom.operators import incremental as inc
from threadloom.plans import fixtures as fx
from threadloom.plans.registry import query, table
from threadloom.plans.tables import SLOTS, keyword_spans
from threadloom.session import scratch_path
from threadloom.streaming import streams

# each keyword's search had got as far as its last event among the even users
RESUMED = """
seen as (select event_type as keyword, max(cast(floor(epoch(ts)) as bigint)) as resume_at from events
         where user_id % 2 = 0 and event_type <> 'signup' group by event_type)
"""


@query(
    "resume_point",
    f"""with {SLOTS.strip()}, {RESUMED.strip()}
        select keyword, after, after + 21600 as before
        from (select keyword, unnest(generate_series(coalesce(resume_at, first_at), last_at, 21600)) as after
              from span left join seen using (keyword)) s""",
)
def resume_point(spark: SparkSession, sf: str) -> DataFrame:
    recorded = (
        table(spark, sf, "events")
        .where((F.col("user_id") % 2 == 0) & (F.col("event_type") != "signup"))
        .select(F.col("event_type").alias("keyword"), tx.epoch_seconds(F.col("ts")).alias("epoch"))
    )
    return inc.resumed_slots(keyword_spans(spark, sf), recorded, F.col("first_at"), F.col("last_at"))


@query(
    "process_new_only",
    fx.with_views(
        """select conversation_id, count(*) as n_posts, case when conv_id % 4 = 0 then 1 else 2 end as batch
           from posts_fx group by conversation_id, conv_id"""
    ),
)
def process_new_only(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs over overlapping input; the second must leave the first one's rows alone."""
    posts = fx.raw_posts(spark, sf).select("conversation_id", "conv_id")
    path = scratch_path(spark, "incremental")

    def summarise(batch: int):
        return lambda rows: rows.groupBy("conversation_id").agg(
            F.count("*").alias("n_posts"), F.lit(batch).alias("batch")
        )

    inc.process_new_only(posts.where(F.col("conv_id") % 4 == 0), path, "conversation_id", summarise(1))
    return inc.process_new_only(posts, path, "conversation_id", summarise(2))


@query(
    "stream_seed_summary",
    fx.with_views("select pid as tweet_id, conversation_id, topics from posts_fx where turn % 4 <> 3 and topics <> ''"),
)
def stream_seed_summary(spark: SparkSession, sf: str) -> DataFrame:
    pages = streams.arriving_pages(spark, fx.write_pages(spark, sf))
    tagged = streams.tag_pages(pages, fx.dictionary(spark))
    summary = tagged.withColumn("topics", kw.join_topics(F.col("topics")))
    return streams.run_append(summary, scratch_path(spark, "summaries"), scratch_path(spark, "state"))



def arriving_events(spark: SparkSession, sf: str) -> DataFrame:
    """The event table as a stream of post arrivals."""
    schema = table(spark, sf, "events").schema
    # a pattern, so that the table may be one file as well as a folder
    raw = streams.arriving(spark, f"{sf.rstrip('/')}/events.parquet*", schema, "parquet")
    return raw.select("event_id", "ts", F.col("event_type").alias("keyword"))


#: Time within which a post may arrive again.
DEDUP_HORIZON = "2 days"


@query("stream_dedup", "select event_id, event_type as keyword from events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every event arrives three times, the copies well within the horizon."""
    arrivals = arriving_events(spark, sf)
    copies = arrivals.withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    once = streams.dedup_within(
        copies.withColumn("ts", F.col("ts").cast("timestamp")), "event_id", "ts", DEDUP_HORIZON
    )
    return streams.run_append(
        once.select("event_id", "keyword"), scratch_path(spark, "posts"), scratch_path(spark, "state")
    )


@query(
    "stream_dedup_ever",
    """select event_id, event_type as keyword,
              cast(floor(epoch(ts)) as bigint) + case when user_id % 2 = 0 then 0 else 2592000 end as arrived
       from events""",
)
def stream_dedup_ever(spark: SparkSession, sf: str) -> DataFrame:
    """Events of even users arrive twice, and all events again 30 days later, in a second run of the stream."""
    events = table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("keyword"),
        tx.epoch_seconds(F.col("ts")).alias("arrived"),
        (F.col("user_id") % 2 == 0).alias("early"),
    )
    source, out, state = (scratch_path(spark, name) for name in ("arrivals", "posts", "state"))
    columns = ("event_id", "keyword", "arrived")
    first = events.where("early").select(*columns)
    first.union(first).write.parquet(source)
    arrivals = streams.arriving(spark, source, first.schema, "parquet")
    streams.run_dedup_ever(arrivals, out, state, "event_id")
    later = events.withColumn("arrived", F.col("arrived") + 30 * 24 * 3600)
    later.select(*columns).write.mode("append").parquet(source)
    return streams.run_dedup_ever(arrivals, out, state, "event_id")


@query(
    "stream_volume_6h",
    """select keyword, slot_start, count(*) as n
       from (select event_type as keyword, cast(floor(epoch(ts)) as bigint) // 21600 * 21600 as slot_start from events) t
       group by 1, 2""",
)
def stream_volume_6h(spark: SparkSession, sf: str) -> DataFrame:
    counted = streams.run_volume(
        arriving_events(spark, sf), scratch_path(spark, "volume"), scratch_path(spark, "state")
    )
    return counted.select("keyword", tx.epoch_seconds(F.col("slot_start")).alias("slot_start"), "n")
