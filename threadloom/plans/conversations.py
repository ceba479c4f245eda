"""Counts and coverage per topic, reply graphs, and statistics per conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.functions import keywords as kw
from threadloom.operators import graph, models
from threadloom.operators import posts as post_ops
from threadloom.operators import relational as rel
from threadloom.operators import rollups as ops
from threadloom.plans import fixtures as fx
from threadloom.plans.registry import query, table
from threadloom.plans.scans import PAIRS, clean_sql
from threadloom.plans.tables import coded_conversations
from threadloom.session import scratch_path
from threadloom.sources import dealt, pages

EXPLODED = """
exploded as (select pid, conversation_id, turn, pos, trim(parts[pos]) as topic
             from (select *, string_split(topics, '|') as parts, unnest(generate_series(1, len(string_split(topics, '|')))) as pos
                   from posts_fx) t)
"""


# --- counts and coverage -----------------------------------------------------------


@query(
    "topic_counts",
    fx.with_views(
        """select topic, count(*) as n_posts, 1e0 * count(*) / (select count(*) from posts_fx) as share
           from exploded where topic <> '' group by topic""",
        EXPLODED.strip(),
    ),
)
def topic_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ops.topic_counts(fx.posts(spark, sf))


@query(
    "topic_convos",
    fx.with_views(
        """select topic, count(*) as n_conversations,
                  1e0 * count(*) / (select count(distinct conversation_id) from pairs) as share
           from pairs group by topic""",
        PAIRS.strip(),
    ),
)
def topic_convos(spark: SparkSession, sf: str) -> DataFrame:
    return ops.topic_conversations(ops.topic_pairs(fx.posts(spark, sf)))


@query(
    "topic_outcome_share",
    fx.with_views(
        """select 'collected' as outcome, topic, count(*) as n_conversations, 1e0 * count(*) / (select count(*) from done_fx) as share
           from pairs where conversation_id in (from done_fx) group by topic
           union all
           select 'empty', topic, count(*), 1e0 * count(*) / (select count(*) from failed_fx)
           from pairs where conversation_id in (from failed_fx) group by topic""",
        PAIRS.strip(),
    ),
)
def topic_outcome_share(spark: SparkSession, sf: str) -> DataFrame:
    return ops.topic_outcome_share(
        ops.topic_pairs(fx.posts(spark, sf)), collected=fx.done_ids(spark, sf), empty=fx.failed_ids(spark, sf)
    )


@query(
    "coverage_by_topic",
    fx.with_views(
        """select topic, total, with_data, without_data, searched, total - searched as remaining,
                  1e0 * with_data / total as with_data_share, 1e0 * without_data / total as without_data_share,
                  1e0 * searched / total as searched_share, 1e0 * (total - searched) / total as remaining_share
           from (select topic, count(*) as total,
                        count(*) filter (conversation_id in (from done_fx)) as with_data,
                        count(*) filter (conversation_id in (from failed_fx)) as without_data,
                        count(*) filter (conversation_id in (from done_fx) or conversation_id in (from failed_fx)) as searched
                 from pairs group by topic) t""",
        PAIRS.strip(),
    ),
)
def coverage_by_topic(spark: SparkSession, sf: str) -> DataFrame:
    return ops.coverage_by_topic(
        ops.topic_pairs(fx.posts(spark, sf)), fx.done_ids(spark, sf), fx.failed_ids(spark, sf)
    )


# threads searched: ids divisible by 2 or 5, and one never seeded; retrieved: those divisible by 4
FUNNEL = """
searched as (select distinct thread_id from seeds_fx where cast(thread_id as bigint) % 2 = 0 or cast(thread_id as bigint) % 5 = 0
             union all select 'unseeded'),
retrieved as (select distinct thread_id from seeds_fx where cast(thread_id as bigint) % 4 = 0),
threads as (select thread_id, arg_min(topic, event_id) as topic from seeds_fx where topic is not null group by thread_id)
"""


@query(
    "funnel",
    fx.with_views(
        """select topic, seeds, searched, retrieved, 1e0 * searched / base as searched_share, 1e0 * retrieved / searched as retrieved_share
           from (select topic, count(*) as seeds,
                        (select count(*) from threads t where t.topic = s.topic and t.thread_id in (from searched)) as searched,
                        (select count(*) from threads t where t.topic = s.topic and t.thread_id in (from retrieved)) as retrieved,
                        count(*) as base
                 from seeds_fx s where topic is not null group by topic
                 union all
                 select null, (select count(*) from seeds_fx where topic is not null),
                        (select count(*) from (from searched union from retrieved) u), (select count(*) from retrieved),
                        (select count(distinct thread_id) from seeds_fx where topic is not null)) t""",
        FUNNEL.strip(),
    ),
)
def funnel(spark: SparkSession, sf: str) -> DataFrame:
    seeds, _ = kw.lookup_topic(
        fx.seeds(spark, sf).select("event_id", "thread_id", "keyword"), fx.seed_dictionary(spark)
    )
    ids = fx.seeds(spark, sf).select("thread_id").distinct()
    number = F.col("thread_id").cast("long")
    searched = ids.where((number % 2 == 0) | (number % 5 == 0)).unionByName(
        ids.select(F.lit("unseeded").alias("thread_id")).distinct()
    )
    retrieved = ids.where(number % 4 == 0)
    return ops.funnel(seeds, searched, retrieved, ["event_id"])


@query(
    "platform_totals",
    fx.with_views(
        """select stage, platform, count(*) as n from staged group by stage, platform
           union all select stage, null, count(*) from staged group by stage""",
        """staged as (select 'seeds' as stage, platform from posts_fx where topics <> ''
                      union all select 'searched', platform from (select distinct platform, conversation_id from posts_fx) c
                      union all select 'retrieved', platform from (select distinct platform, conversation_id from posts_fx where conversation_id in (from done_fx)) d
                      union all select 'coded', 'b' from documents)""",
    ),
)
def platform_totals(spark: SparkSession, sf: str) -> DataFrame:
    posts = fx.posts(spark, sf)
    conversations = posts.select("platform", "conv_id").distinct()

    def count(rows: DataFrame, stage: str) -> DataFrame:
        return rows.groupBy("platform").agg(F.count("*").alias("n")).withColumn("stage", F.lit(stage))

    staged = [
        count(posts.where(F.col("topics") != ""), "seeds"),
        count(conversations, "searched"),
        count(conversations.where(F.col("conv_id") % 4 == 0), "retrieved"),
        count(table(spark, sf, "documents").select(F.lit("b").alias("platform")), "coded"),
    ]
    stacked = staged[0]
    for part in staged[1:]:
        stacked = stacked.unionByName(part)
    return ops.platform_totals(stacked)


# --- values per conversation ----------------------------------------------------------


TOX = """
tox_fx as (select conversation_id, avg(tox) as tox_mean, median(tox) as tox_median, max(tox) as tox_max
           from posts_fx group by conversation_id)
"""
USERS = """
users_fx as (select conversation_id, count(*) as n_users, max(n) as most_comments
             from (select conversation_id, author, count(*) as n from posts_fx group by 1, 2) a group by 1)
"""
MODE = """
mode_fx as (select conversation_id, arg_max(topic_or_none, (n, -seen, -place)) as topic_or_none
            from (select conversation_id, topic as topic_or_none, count(*) as n, min(turn) as seen, arg_min(pos, turn) as place
                  from exploded group by 1, 2) m group by 1)
"""
EXACT = """
exact_fx as (select conversation_id, count(*) filter (topics = 'russia') as russia,
                    count(*) filter (topics = 'midterms') as midterms, count(*) filter (topics = 'childcare') as childcare
             from posts_fx group by conversation_id)
"""
_LONG = " union all ".join(
    f"select conversation_id, sum(t{j}) as s, avg(t{j}) as a from loading_fx group by 1" for j in range(10)
)
SPREAD = f"""
spread_fx as (select conversation_id, 1 - (max(a) - min(a)) as old_topic_spread,
                     sum((2 * i - 11) * s) / (10 * sum(s)) as new_topic_spread
              from (select *, row_number() over (partition by conversation_id order by s) as i from ({_LONG}) l) r group by 1)
"""
EDGES = """
edges_fx as (select distinct conversation_id, pid as src, parent_id as dst from posts_fx where parent_id is not null)
"""
NODES = "nodes_fx as (select conversation_id, src as node from edges_fx union select conversation_id, dst from edges_fx)"
SIZE = "size_fx as (select conversation_id, count(*) as size from nodes_fx group by 1)"
BREADTH = """
breadth_fx as (select conversation_id, max(n) as breadth
               from (select conversation_id, dst, count(*) as n from edges_fx group by 1, 2) b group by 1)
"""
DEPTH = """
walks as (select conversation_id, src, dst, 1 as steps from edges_fx
          union all select w.conversation_id, w.src, e.dst, w.steps + 1
          from walks w join edges_fx e on e.conversation_id = w.conversation_id and e.src = w.dst),
depth_fx as (select conversation_id, cast(max(steps) as bigint) as depth from walks group by 1)
"""
# everything reachable from the least node, links taken both ways
CONNECTED = """
both_ways as (select conversation_id, src as u, dst as v from edges_fx union select conversation_id, dst, src from edges_fx),
reached as (select conversation_id, min(node) as node from nodes_fx group by 1
            union select r.conversation_id, b.v from reached r join both_ways b on b.conversation_id = r.conversation_id and b.u = r.node),
connected_fx as (select s.conversation_id, cast((select count(*) from reached r where r.conversation_id = s.conversation_id) = s.size as integer) as connected
                 from size_fx s)
"""


@query("tox_summary", fx.with_views("select * from tox_fx", TOX.strip()))
def tox_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ops.tox_summary(fx.raw_posts(spark, sf))


@query("user_stats", fx.with_views("select * from users_fx", USERS.strip()))
def user_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ops.user_stats(fx.raw_posts(spark, sf))


@query(
    "keyword_topic_mode",
    fx.with_views(
        "select conversation_id, nullif(topic_or_none, '') as keyword_topic from mode_fx",
        EXPLODED.strip(),
        MODE.strip(),
    ),
)
def keyword_topic_mode(spark: SparkSession, sf: str) -> DataFrame:
    return ops.topic_profile(fx.posts(spark, sf), "turn").select("conversation_id", "keyword_topic")


@query("topic_exact_counts", fx.with_views("select * from exact_fx", EXACT.strip()))
def topic_exact_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ops.topic_profile(fx.posts(spark, sf), "turn").drop("keyword_topic")


@query(
    "topic_spread_range",
    fx.with_views("select conversation_id, old_topic_spread from spread_fx", SPREAD.strip()),
)
def topic_spread_range(spark: SparkSession, sf: str) -> DataFrame:
    return ops.topic_spread(fx.loadings(spark, sf)).drop("new_topic_spread")


@query(
    "topic_spread_gini",
    fx.with_views("select conversation_id, new_topic_spread from spread_fx", SPREAD.strip()),
)
def topic_spread_gini(spark: SparkSession, sf: str) -> DataFrame:
    return ops.topic_spread(fx.loadings(spark, sf)).drop("old_topic_spread")


LABEL_TOPICS = ("Childcare/parenting", "Russia/Ukraine war", "US midterm elections")


@query(
    "convo_label",
    """select conversation_id, case when greatest(c, r, m) <= 0 then null when c >= r and c >= m then 'Childcare/parenting'
              when r >= m then 'Russia/Ukraine war' else 'US midterm elections' end as classified_topic
       from (select source as conversation_id, sum(case when quality = 1 and doc_id % 3 = 0 then 1 else 0 end) as c,
                    sum(case when toxic = 1 then 1 else 0 end) as r,
                    sum(case when quality = 0 and doc_id % 2 = 0 then 1 else 0 end) as m
             from labels join documents using (doc_id) group by 1) t""",
)
def convo_label(spark: SparkSession, sf: str) -> DataFrame:
    quality, toxic, doc = F.col("quality"), F.col("toxic"), F.col("doc_id")
    classified = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("conversation_id"),
        *[
            hit.cast("int").alias(name)
            for name, hit in zip(
                LABEL_TOPICS,
                [(quality == 1) & (doc % 3 == 0), toxic == 1, (quality == 0) & (doc % 2 == 0)],
            )
        ],
    )
    return ops.conversation_label(classified, LABEL_TOPICS)


# --- reply graphs -----------------------------------------------------------------------


@query("reply_edges", fx.with_views("select * from edges_fx", EDGES.strip()))
def reply_edges(spark: SparkSession, sf: str) -> DataFrame:
    posts = fx.raw_posts(spark, sf).select("conversation_id", "pid", "parent_id")
    return graph.reply_edges(posts.unionByName(posts))


@query("convo_size", fx.with_views("select * from size_fx", EDGES.strip(), NODES, SIZE))
def convo_size(spark: SparkSession, sf: str) -> DataFrame:
    return graph.network_summary(graph.reply_edges(fx.raw_posts(spark, sf))).select("conversation_id", "size")


@query("convo_breadth", fx.with_views("select * from breadth_fx", EDGES.strip(), BREADTH.strip()))
def convo_breadth(spark: SparkSession, sf: str) -> DataFrame:
    return graph.network_summary(graph.reply_edges(fx.raw_posts(spark, sf))).select("conversation_id", "breadth")


@query("convo_depth", fx.with_views("select * from depth_fx", EDGES.strip(), DEPTH.strip(), recursive=True))
def convo_depth(spark: SparkSession, sf: str) -> DataFrame:
    return graph.conversation_depth(graph.reply_edges(fx.raw_posts(spark, sf)))


TORN = "posts_torn as (select * from posts_fx where substr(md5(pid), 1, 1) not in ('0', '1', '2', '3'))"


@query(
    "convo_connected",
    fx.with_views(
        "select * from connected_fx",
        TORN,
        EDGES.replace("posts_fx", "posts_torn").strip(),
        NODES,
        SIZE,
        CONNECTED.strip(),
        recursive=True,
    ),
)
def convo_connected(spark: SparkSession, sf: str) -> DataFrame:
    """Posts are lost by hash so that some conversations fall apart."""
    posts = fx.raw_posts(spark, sf)
    torn = posts.where(~F.substring(F.md5("pid"), 1, 1).isin("0", "1", "2", "3"))
    return graph.connected(graph.reply_edges(torn))


# --- the flagship -----------------------------------------------------------------------

STATS_VIEWS = [
    EXPLODED.strip(), TOX.strip(), USERS.strip(), MODE.strip(), EXACT.strip(), SPREAD.strip(), EDGES.strip(), NODES, SIZE,
    BREADTH.strip(), DEPTH.strip(), CONNECTED.strip(),
    """
stats_fx as (select conversation_id, old_topic_spread, new_topic_spread, tox_mean, tox_median, tox_max,
                    coalesce(size, 0) as size, coalesce(depth, -1) as depth, coalesce(breadth, 0) as breadth,
                    coalesce(connected, 0) as connected, n_users, most_comments, nullif(topic_or_none, '') as keyword_topic,
                    russia, midterms, childcare
             from spread_fx join tox_fx using (conversation_id) join users_fx using (conversation_id)
             join mode_fx using (conversation_id) join exact_fx using (conversation_id)
             left join size_fx using (conversation_id) left join depth_fx using (conversation_id)
             left join breadth_fx using (conversation_id) left join connected_fx using (conversation_id))
""".strip(),
]


def stats(spark: SparkSession, sf: str) -> DataFrame:
    return ops.convo_stats(fx.posts(spark, sf), fx.loadings(spark, sf), "turn")


@query("convo_stats", fx.with_views("select * from stats_fx", *STATS_VIEWS, recursive=True))
def convo_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats(spark, sf)


# turn 0 of some conversations answers itself, turn 3 of others has a second parent
ODD = """
posts_odd as (select * replace (case when turn = 0 and conv_id % 5 = 0 then pid else parent_id end as parent_id) from posts_fx
              union all select * replace (concat(conv_id, '-0') as parent_id) from posts_fx where turn = 3 and conv_id % 4 = 1)
"""
REACHED = """
walks as (select conversation_id, src, dst from edges_fx where src <> dst
          union select w.conversation_id, w.src, e.dst
          from walks w join edges_fx e on e.conversation_id = w.conversation_id and e.src = w.dst where e.dst <> w.src),
depth_fx as (select conversation_id, coalesce(max(n), 0) as depth
             from (select distinct conversation_id from edges_fx) c
             left join (select conversation_id, src, count(*) as n from walks group by 1, 2) a using (conversation_id) group by 1)
"""


def views_over(posts: str, view: str, depth: str = DEPTH) -> list[str]:
    """The views of the flagship over another view of posts."""
    swapped = [depth if v == DEPTH.strip() else v for v in STATS_VIEWS]
    return [view.strip(), *(v.replace("posts_fx", posts).strip() for v in swapped)]


@query(
    "convo_stats_odd",
    fx.with_views("select * from stats_fx", *views_over("posts_odd", ODD, REACHED), recursive=True),
)
def convo_stats_odd(spark: SparkSession, sf: str) -> DataFrame:
    """Null topics, posts with two parents and posts that answer themselves."""
    posts = fx.posts(spark, sf)
    conv, turn = F.col("conv_id"), F.col("turn")
    own = F.when((turn == 0) & (conv % 5 == 0), F.col("pid")).otherwise(F.col("parent_id"))
    second = posts.where((turn == 3) & (conv % 4 == 1)).withColumn("parent_id", F.concat(conv, F.lit("-0")))
    odd = posts.withColumn("parent_id", own).unionByName(second)
    return ops.convo_stats(odd.withColumn("topics", F.nullif("topics", F.lit(""))), fx.loadings(spark, sf), "turn")


SCORED = f"""
posts_scored as (select * replace (1e0 * len(list_filter(words, lambda w: list_contains([{fx.LEXICON_SQL}], w))) / nullif(len(words), 0) as tox)
                 from (select *, list_filter(string_split({clean_sql('lower(text)')}, ' '), lambda w: w <> '') as words from posts_fx) w)
"""


@query(
    "pipeline_stats",
    fx.with_views("select * from stats_fx", *views_over("posts_scored", SCORED), recursive=True),
)
def pipeline_stats(spark: SparkSession, sf: str) -> DataFrame:
    """From raw pages to the flagship: read, project, score, write, read again, roll up."""
    read = pages.page_posts(pages.read_pages(spark, fx.write_pages(spark, sf)))
    table = post_ops.project_page_posts(read, fx.dictionary(spark)).drop("tox")
    scored = models.score_missing(table, models.lexicon_scorer(fx.LEXICON))
    path = scratch_path(spark, "posts")
    dealt.write_dealt(post_ops.conform(scored), path)
    stored = dealt.read_dealt(spark, path, schemas.POSTS)
    loadings = fx.loadings(spark, sf)
    return stored.per_conversation(lambda posts, n: ops.convo_stats(posts, loadings, "created_at", n))


@query(
    "dealt_stats",
    fx.with_views("select * from stats_fx", *views_over("posts_scored", SCORED), recursive=True),
)
def dealt_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship over a table dealt by conversation, with the larger conversations kept apart."""
    posts = models.score_missing(fx.posts(spark, sf).drop("tox"), models.lexicon_scorer(fx.LEXICON))
    path = scratch_path(spark, "posts")
    dealt.write_dealt(posts, path, buckets=8, large=6)
    stored = dealt.read_dealt(spark, path, posts.schema)
    loadings = fx.loadings(spark, sf)
    return stored.per_conversation(lambda own, n: ops.convo_stats(own, loadings, "turn", n))


@query(
    "posts_per_user",
    fx.with_views(
        "select conversation_id, 1e0 * size / n_users as posts_per_user from size_fx join users_fx using (conversation_id)",
        USERS.strip(), EDGES.strip(), NODES, SIZE,
    ),
)
def posts_per_user(spark: SparkSession, sf: str) -> DataFrame:
    posts = fx.raw_posts(spark, sf)
    sizes = graph.network_summary(graph.reply_edges(posts)).select("conversation_id", "size")
    return ops.posts_per_user(sizes.join(ops.user_stats(posts), "conversation_id"))


# every conversation's classified topic, as if labelled
CLASSIFIED = """
classified as (select distinct conversation_id,
                      case conv_id % 4 when 0 then 'Childcare/parenting' when 1 then 'Russia/Ukraine war' when 2 then 'US midterm elections' end as classified_topic
               from posts_fx where conv_id % 4 < 3)
"""


def classified(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("conv_id") % 4
    named = F.when(kind == 0, LABEL_TOPICS[0]).when(kind == 1, LABEL_TOPICS[1]).otherwise(LABEL_TOPICS[2])
    return fx.conversation_ids(spark, sf).where(kind < 3).select("conversation_id", named.alias("classified_topic"))


@query(
    "join_stats_labels",
    fx.with_views(
        """select conversation_id, classified_topic, tox_mean, new_topic_spread
           from tox_fx join spread_fx using (conversation_id) join classified using (conversation_id)""",
        TOX.strip(), SPREAD.strip(), CLASSIFIED.strip(),
    ),
)
def join_stats_labels(spark: SparkSession, sf: str) -> DataFrame:
    return rel.join_stats_labels(spread_and_tox(spark, sf), classified(spark, sf)).select(
        "conversation_id", "classified_topic", "tox_mean", "new_topic_spread"
    )


@query(
    "sample_overlay",
    fx.with_views(
        """select conversation_id, tox_mean * 10 as tox_mean, new_topic_spread * 10 as new_topic_spread
           from tox_fx join spread_fx using (conversation_id) join coded using (conversation_id) where final_on_topic = 'Yes'""",
        TOX.strip(), SPREAD.strip(),
        "coded as (select distinct conversation_id, case when conv_id % 5 = 0 then 'No' else 'Yes' end as final_on_topic from posts_fx where conv_id % 3 <> 1)",
    ),
)
def sample_overlay(spark: SparkSession, sf: str) -> DataFrame:
    return rel.sample_overlay(spread_and_tox(spark, sf), coded_conversations(spark, sf)).select(
        "conversation_id", "tox_mean", "new_topic_spread"
    )


def spread_and_tox(spark: SparkSession, sf: str) -> DataFrame:
    """The two scores the density plots need."""
    tox = fx.raw_posts(spark, sf).groupBy("conversation_id").agg(F.avg("tox").alias("tox_mean"))
    return ops.topic_spread(fx.loadings(spark, sf)).join(tox, "conversation_id")
