"""Counts, coverage tables and the one-row-per-conversation statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from threadloom import schemas
from threadloom.functions.keywords import split_topics
from threadloom.operators import graph
from threadloom.session import materialise, materialise_buckets

LOADINGS = tuple(f"t{i}" for i in range(10))
CONVERSATION = "conversation_id"
SCORE_CELLS = 4096


def share(part: Column, whole: Column) -> Column:
    """A ratio that is null when there is nothing to divide by."""
    return part / F.nullif(whole, F.lit(0))


# --- topics -----------------------------------------------------------------


def explode_topics(posts: DataFrame, serialised: str = "topics") -> DataFrame:
    """One row per post and topic; posts without a topic give none."""
    return posts.withColumn("topic", F.explode(split_topics(F.col(serialised)))).where(
        F.col("topic") != ""
    )


def topic_pairs(posts: DataFrame) -> DataFrame:
    """Distinct ``(topic, conversation_id)``."""
    return explode_topics(posts).select("topic", CONVERSATION).distinct()


def topic_counts(posts: DataFrame) -> DataFrame:
    """Posts per topic and their share of all posts.

    Every post counts once more under no topic, which gives the total.
    """
    named = F.filter(topic_pieces(posts), lambda t: t != "")
    rows = posts.select(F.explode(F.concat(_total(), named)).alias("topic"))
    return _shares(rows.groupBy("topic").agg(F.count("*").alias("n_posts")), "n_posts")


def _total() -> Column:
    """The entry that stands for all rows where topics are counted."""
    return F.array(F.lit(None).cast("string"))


def _shares(counts: DataFrame, n: str) -> DataFrame:
    """Counts per topic with their share of the row without a topic; one row per topic."""
    total = F.max(F.when(F.col("topic").isNull(), F.col(n))).over(W.partitionBy(F.lit(0)))
    shares = counts.select("topic", n, share(F.col(n), total).alias("share"))
    return shares.where(F.col("topic").isNotNull())


def topic_contains(posts: DataFrame, topics: tuple[str, ...] = schemas.TOPICS) -> DataFrame:
    """Posts whose serialised topics contain each name, in one pass."""
    hits = posts.select(
        F.explode(
            F.filter(
                F.array(*[F.lit(t) for t in topics]), lambda t: F.contains(F.col("topics"), t)
            )
        ).alias("topic")
    )
    return hits.groupBy("topic").agg(F.count("*").alias("n_posts"))


def topic_conversations(pairs: DataFrame) -> DataFrame:
    """Distinct conversations per topic and their share of all conversations with a topic."""
    topics = pairs.groupBy(CONVERSATION).agg(F.collect_set("topic").alias("_topics"))
    rows = topics.select(F.explode(F.concat(_total(), "_topics")).alias("topic"))
    return _shares(rows.groupBy("topic").agg(F.count("*").alias("n_conversations")), "n_conversations")


def topic_outcome_share(pairs: DataFrame, **outcomes: DataFrame) -> DataFrame:
    """Per outcome id set: conversations of each topic, as a share of that outcome's ids.

    The denominator is all ids of the outcome, matched to a topic or not.
    """
    tagged = [ids.select(F.lit(name).alias("outcome"), CONVERSATION) for name, ids in outcomes.items()]
    ids = reduce(DataFrame.unionByName, tagged).distinct()
    totals = ids.groupBy("outcome").agg(F.count("*").alias("_total"))
    counts = (
        pairs.join(ids, CONVERSATION)
        .groupBy("outcome", "topic")
        .agg(F.count("*").alias("n_conversations"))
    )
    return counts.join(totals, "outcome").select(
        "outcome", "topic", "n_conversations", share(F.col("n_conversations"), F.col("_total")).alias("share")
    )


def coverage_by_topic(pairs: DataFrame, collected: DataFrame, empty: DataFrame) -> DataFrame:
    """Per topic: how many conversations were found, found empty, searched, and remain."""
    def flag(ids: DataFrame, name: str) -> DataFrame:
        return ids.select(CONVERSATION).distinct().withColumn(name, F.lit(1))

    flagged = pairs.join(flag(collected, "_data"), CONVERSATION, "left").join(
        flag(empty, "_none"), CONVERSATION, "left"
    )
    counts = flagged.groupBy("topic").agg(
        F.count("*").alias("total"),
        F.count("_data").alias("with_data"),
        F.count("_none").alias("without_data"),
        F.count(F.coalesce("_data", "_none")).alias("searched"),
    )
    counts = counts.withColumn("remaining", F.col("total") - F.col("searched"))
    return counts.withColumns(
        {
            f"{name}_share": share(F.col(name), F.col("total"))
            for name in ("with_data", "without_data", "searched", "remaining")
        }
    )


def funnel(seeds: DataFrame, searched: DataFrame, retrieved: DataFrame, order: list[str]) -> DataFrame:
    """Seeds, threads searched and threads retrieved, per topic and overall.

    ``seeds`` has ``thread_id`` and ``topic``; a thread counts for the topic
    of its first seed. The overall row (topic null) counts every searched and
    retrieved thread, seeded or not, and compares with distinct seed threads.
    Seeds and both id sets are stacked and reduced to one row per thread.
    """
    steps = [
        seeds.select("thread_id", "topic", F.struct(*order).alias("_at"), F.lit(1).alias("_seeds")),
        searched.select("thread_id", F.lit(1).alias("_tried")),
        retrieved.select("thread_id", F.lit(1).alias("_tried"), F.lit(1).alias("_found")),
    ]
    stacked = steps[0]
    for step in steps[1:]:
        stacked = stacked.unionByName(step, allowMissingColumns=True)
    threads = stacked.groupBy("thread_id").agg(
        F.min_by("topic", "_at").alias("topic"),
        F.sum("_seeds").alias("_seeds"),
        F.max("_tried").alias("_tried"),
        F.max("_found").alias("_found"),
    )
    counts = threads.rollup("topic").agg(
        F.grouping("topic").alias("_all"),
        F.sum("_seeds").alias("seeds"),
        F.count("_tried").alias("searched"),
        F.count("_found").alias("retrieved"),
        F.count("_seeds").alias("_threads"),
    )
    own = seeds.groupBy("topic").agg(F.count("*").alias("_own"))
    overall = F.col("_all") == 1
    return (
        counts.where(overall | F.col("topic").isNotNull())
        .join(own, "topic", "left")
        .withColumn("seeds", F.when(overall, F.col("seeds")).otherwise(F.col("_own")))
        .select(
            "topic",
            F.coalesce("seeds", F.lit(0)).alias("seeds"),
            "searched",
            "retrieved",
            share(F.col("searched"), F.when(overall, F.col("_threads")).otherwise(F.col("seeds"))).alias(
                "searched_share"
            ),
            share(F.col("retrieved"), F.col("searched")).alias("retrieved_share"),
        )
    )


def platform_totals(counts: DataFrame) -> DataFrame:
    """Counts per platform and stage, with a total over platforms (platform null)."""
    return counts.groupingSets(
        [("stage", "platform"), ("stage",)], "stage", "platform"
    ).agg(F.sum("n").alias("n"))


# --- one value per conversation -------------------------------------------------


def gini(values: Column) -> Column:
    """Gini coefficient of an array of non-negative numbers; null if they sum to zero."""
    ordered = F.array_sort(values)
    n = F.size(values)
    ranked = F.aggregate(
        F.transform(ordered, lambda x, i: x * (2 * (i + 1) - n - 1)), F.lit(0.0), lambda a, x: a + x
    )
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(total != 0, ranked / (n * total))


def topic_spread(loadings: DataFrame) -> DataFrame:
    """Both spreads of the topic loadings: one minus the range of means, and Gini of sums."""
    sums = loadings.groupBy(CONVERSATION).agg(
        F.count("*").alias("_n"), *[F.sum(t).alias(t) for t in LOADINGS]
    )
    spread = (F.greatest(*LOADINGS) - F.least(*LOADINGS)) / F.col("_n")
    return sums.select(
        CONVERSATION,
        (1 - spread).alias("old_topic_spread"),
        gini(F.array(*LOADINGS)).alias("new_topic_spread"),
    )


def median_by_key(df: DataFrame, key: str, value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """The exact median per key, for keys of any size.

    Values are counted per key and cell of ``[low, high]``; running totals over
    the at most 4,096 cells tell which one or two cells hold the middle, and
    only their values are put in order.
    """
    return _median(score_counts(df, key, value, low, high), key, value)


def score_counts(df: DataFrame, key: str, value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """``_n`` rows per key, cell and value ``_v``; missing values have no cell. Written once."""
    scaled = F.floor((F.col(value) - low) / (high - low) * SCORE_CELLS).cast("long")
    cell = F.greatest(F.lit(0), F.least(F.lit(SCORE_CELLS - 1), scaled))
    cell = F.when(F.col(value).isNotNull(), cell)
    counts = df.groupBy(key, cell.alias("_cell"), F.col(value).alias("_v"))
    return materialise(counts.agg(F.count("*").alias("_n")), "scores")


def _median(counts: DataFrame, key: str, value: str) -> DataFrame:
    counts = counts.where(F.col("_v").isNotNull())
    cells = W.partitionBy(key)
    earlier = cells.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    middle = (
        counts.groupBy(key, "_cell")
        .agg(F.sum("_n").alias("_in_cell"))
        .select(
            key,
            "_cell",
            "_in_cell",
            F.coalesce(F.sum("_in_cell").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_in_cell").over(cells).alias("_total"),
        )
        .withColumn("_low_at", F.floor((F.col("_total") - 1) / 2))
        .withColumn("_high_at", F.floor(F.col("_total") / 2))
        .where(
            (F.col("_before") <= F.col("_high_at"))
            & (F.col("_before") + F.col("_in_cell") > F.col("_low_at"))
        )
    )
    inside = W.partitionBy(key, "_cell").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        counts.join(middle, [key, "_cell"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_from", F.col("_upto") - F.col("_n"))
    )

    def at(position: str) -> Column:
        holds = (F.col("_from") <= F.col(position)) & (F.col(position) < F.col("_upto"))
        return F.max(F.when(holds, F.col("_v")))

    return placed.groupBy(key).agg(((at("_low_at") + at("_high_at")) / 2).alias(f"{value}_median"))


def tox_summary(posts: DataFrame) -> DataFrame:
    """Mean, median and maximum score per conversation, missing scores skipped."""
    counts = score_counts(posts, CONVERSATION, "tox")
    known = F.when(F.col("_v").isNotNull(), F.col("_n"))
    plain = counts.groupBy(CONVERSATION).agg(
        share(F.sum(F.col("_v") * F.col("_n")), F.sum(known)).alias("tox_mean"),
        F.max("_v").alias("tox_max"),
    )
    return plain.join(_median(counts, CONVERSATION, "tox"), CONVERSATION, "left").select(
        CONVERSATION, "tox_mean", "tox_median", "tox_max"
    )


def user_stats(posts: DataFrame) -> DataFrame:
    """Distinct authors and the number of posts of the most active one."""
    per_author = posts.groupBy(CONVERSATION, "author").agg(F.count("*").alias("_posts"))
    return per_author.groupBy(CONVERSATION).agg(
        F.count("*").alias("n_users"), F.max("_posts").alias("most_comments")
    )


def topic_profile(posts: DataFrame, order: str, topics: tuple[str, ...] = schemas.TOPICS) -> DataFrame:
    """The dominant topic of each conversation, and its posts on exactly one topic.

    The dominant topic is the one most posts carry; ties go to the one seen
    first. A post without a topic votes for "missing", which comes out as null.
    """
    pieces = topic_pieces(posts)
    votes = posts.select(
        CONVERSATION,
        order,
        (F.size(pieces) == 1).cast("int").alias("_alone"),
        F.posexplode(pieces).alias("_at", "topic"),
    )
    tallies = votes.groupBy(CONVERSATION, "topic").agg(
        F.count("*").alias("_n"),
        F.sum("_alone").alias("_exact"),
        F.min(F.struct(order, "_at")).alias("_seen"),
    )
    rank = F.struct(-F.col("_n"), "_seen")
    return tallies.groupBy(CONVERSATION).agg(
        F.min_by(F.nullif("topic", F.lit("")), rank).alias("keyword_topic"),
        *[F.coalesce(F.sum(F.when(F.col("topic") == t, F.col("_exact"))), F.lit(0)).alias(t) for t in topics],
    )


def topic_pieces(posts: DataFrame, topics: str = "topics") -> Column:
    """The topics of a post, serialised or an array; one empty piece if it has none."""
    none = F.array(F.lit(""))
    if isinstance(posts.schema[topics].dataType, ArrayType):
        return F.when(F.size(F.coalesce(topics, F.array().cast("array<string>"))) > 0, F.col(topics)).otherwise(none)
    return split_topics(F.coalesce(F.col(topics), F.lit("")))


def posts_per_user(stats: DataFrame) -> DataFrame:
    return stats.select(
        CONVERSATION, share(F.col("size"), F.col("n_users")).alias("posts_per_user")
    )


def conversation_label(
    posts: DataFrame, topics: tuple[str, ...]
) -> DataFrame:
    """The topic with the most classified posts; null when no post has one.

    ``topics`` are 0/1 columns, and ties go to the first of them.
    """
    sums = posts.groupBy(CONVERSATION).agg(*[F.sum(F.col(f"`{t}`")).alias(t) for t in topics])
    best = F.greatest(*[F.col(f"`{t}`") for t in topics])
    chosen = F.when(best <= 0, None)
    for topic in topics:
        chosen = chosen.when(F.col(f"`{topic}`") == best, topic)
    return sums.select(CONVERSATION, chosen.alias("classified_topic"))


def post_rollup(posts: DataFrame) -> DataFrame:
    """User statistics, mean and maximum score in one aggregation.

    Posts are first summed per author, which keeps a very long conversation
    spread over many tasks.
    """
    per_author = posts.groupBy(CONVERSATION, "author").agg(
        F.count("*").alias("_posts"),
        F.sum("tox").alias("_tox"),
        F.count("tox").alias("_scored"),
        F.max("tox").alias("tox_max"),
    )
    return per_author.groupBy(CONVERSATION).agg(
        share(F.sum("_tox"), F.sum("_scored")).alias("tox_mean"),
        F.max("tox_max").alias("tox_max"),
        F.count("*").alias("n_users"),
        F.max("_posts").alias("most_comments"),
    )


def convo_stats(posts: DataFrame, loadings: DataFrame, order: str, buckets: int | None = None) -> DataFrame:
    """One row per conversation: spread, toxicity, reply network, users and topics.

    ``posts`` has the post columns with ``tox`` and ``topics``, serialised or an
    array; ``order`` is any column that can be ordered. ``loadings`` has
    ``conversation_id`` and the ten loadings. Every conversation of ``posts``
    gets a row, with or without loadings and links. Every part is reduced to
    one row per conversation before parts are joined, all on the same key. The
    columns that several parts read are written once, and so are the links.
    With ``buckets``, the posts are a stored table dealt by conversation into as
    many; then they are not written again, the links are dealt alike, and no
    post or link is moved to reduce it.
    """
    if buckets:
        edges = materialise_buckets(graph.reply_edges(posts), "edges", CONVERSATION, buckets)
    else:
        columns = [CONVERSATION, "pid", "parent_id", "author", "tox", "topics", order]
        posts = materialise(posts.select(*dict.fromkeys(columns)), "posts")
        edges = materialise(graph.reply_edges(posts), "edges")
    depth, irregular = graph.reply_walks(edges)
    links = (
        graph.network_summary(edges)
        .drop("connected")
        .join(graph.connected(edges, irregular), CONVERSATION)
        .join(depth, CONVERSATION)
    )
    parts = (
        post_rollup(posts)
        .join(topic_spread(loadings), CONVERSATION, "left")
        .join(median_by_key(posts, CONVERSATION, "tox"), CONVERSATION, "left")
        .join(topic_profile(posts, order), CONVERSATION, "left")
        .join(links, CONVERSATION, "left")
    )
    without_links = {"size": 0, "depth": -1, "breadth": 0, "connected": 0}
    for name, value in without_links.items():
        known = F.col("n_links").isNotNull()
        parts = parts.withColumn(name, F.when(known, F.col(name)).otherwise(F.lit(value)))
    return parts.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.CONVO_STATS]
    )
