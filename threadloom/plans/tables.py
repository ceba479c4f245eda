"""Projection, cleaning, joins, lookups, set algebra and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import keywords as kw
from threadloom.functions import text as tx
from threadloom.operators import posts as post_ops
from threadloom.operators import relational as rel
from threadloom.operators import rollups
from threadloom.plans import fixtures as fx
from threadloom.plans.registry import query, table
from threadloom.plans.scans import clean_sql
from threadloom.sources import pages, threads


# --- posts ------------------------------------------------------------------------

POST_TEXT = "case when platform = 'b' then concat(case when turn = 0 then concat('Thread ', conv_id) else '' end, ' ', text) else text end"


@query(
    "project_posts",
    fx.with_views(
        f"""select platform, pid, case when platform = 'b' then concat(conv_id, '-0') else conversation_id end as conversation_id,
                   case when not stub then author end as author, parent_id,
                   case when platform = 'a' and turn > 0 then author end as parent_author,
                   case when platform = 'a' and turn > 0 then concat('q', pid) end as quote_id,
                   case when not stub then {clean_sql(POST_TEXT)} end as text,
                   case when not stub then {fx.CREATED_SQL} end as created_at,
                   case when not stub then topics end as topics,
                   case when not stub then russia end as russia, case when not stub then midterms end as midterms,
                   case when not stub then childcare end as childcare, stub as is_stub
            from (select *, platform = 'b' and {fx.HIDDEN} as stub from posts_fx p) s"""
    ),
)
def project_posts(spark: SparkSession, sf: str) -> DataFrame:
    words = fx.dictionary(spark)
    read = pages.page_posts(pages.read_pages(spark, fx.write_pages(spark, sf)))
    # the pages hold all conversations; thread platform posts come from the thread documents
    of_a = read.where(F.split_part("id", F.lit("-"), F.lit(1)).cast("long") % 3 != 0)
    nodes = threads.thread_nodes(
        threads.read_threads(spark, fx.write_threads(spark, sf, "platform = 'b'"))
    )
    of_b = post_ops.project_thread_posts(threads.thread_posts(nodes), threads.thread_stubs(nodes), words)
    both = post_ops.project_page_posts(of_a, words).unionByName(of_b)
    return both.select(
        "platform", "pid", "conversation_id", "author", "parent_id", "parent_author", "quote_id", "text",
        "created_at", kw.join_topics(F.col("topics")).alias("topics"), "russia", "midterms", "childcare", "is_stub",
    )


@query(
    "seed_summary",
    fx.with_views("select pid as tweet_id, conversation_id, topics from posts_fx where turn % 4 <> 3 and topics <> ''"),
)
def seed_summary(spark: SparkSession, sf: str) -> DataFrame:
    read = pages.page_posts(pages.read_pages(spark, fx.write_pages(spark, sf)))
    found = post_ops.seed_summary(read, fx.dictionary(spark))
    return found.withColumn("topics", kw.join_topics(F.col("topics")))


@query(
    "seed_locations",
    fx.with_views(
        f"select conversation_id, pid as tweet_id, {fx.PAGE_FILE} as filename, {fx.IS_INCLUDE} as includes from posts_fx"
    ),
)
def seed_locations(spark: SparkSession, sf: str) -> DataFrame:
    return pages.seed_locations(
        pages.page_posts(pages.read_pages(spark, fx.write_pages(spark, sf)))
    )


# a table keyed by conversation in which some rows lack the id and some belong elsewhere
KEYED = """
keyed as (select pid, concat('c', conv_id) as key,
                 case when (conv_id + turn) % 5 = 0 then null when (conv_id + turn) % 11 = 0 then concat('c', conv_id + 1)
                      else conversation_id end as conversation_id
          from posts_fx)
"""


@query(
    "own_conversation",
    fx.with_views(
        "select pid, coalesce(conversation_id, key) as conversation_id from keyed where coalesce(conversation_id, key) = key",
        KEYED.strip(),
    ),
)
def own_conversation(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("conv_id") + F.col("turn")
    other = F.concat(F.lit("c"), F.col("conv_id") + 1)
    keyed = fx.raw_posts(spark, sf).select(
        "pid",
        F.concat(F.lit("c"), "conv_id").alias("key"),
        F.when(at % 5 == 0, None).when(at % 11 == 0, other).otherwise(F.col("conversation_id")).alias("conversation_id"),
    )
    return post_ops.own_conversation(keyed, F.col("key")).drop("key")


@query(
    "drop_null_text",
    f"""select d.doc_id, coalesce(l.quality, -1) as quality, {clean_sql('d.text')} as clean
        from documents d left join labels l using (doc_id)
        where l.toxic is not null and {clean_sql('d.text')} <> ''""",
)
def drop_null_text(spark: SparkSession, sf: str) -> DataFrame:
    labelled = table(spark, sf, "documents").select("doc_id", "text").join(
        table(spark, sf, "labels"), "doc_id", "left"
    )
    cleaned = labelled.withColumn("clean", tx.clean_whitespace(F.col("text")))
    kept = post_ops.drop_null_text(cleaned.dropna(subset=["toxic"]), "text", "clean")
    return kept.fillna({"quality": -1}).select("doc_id", "quality", "clean")


# hand codes per conversation: every third conversation, from CODING's answers
CODED = """
coded as (select distinct conversation_id,
                 case conv_id % 4 when 0 then 'Not sure' when 1 then null when 2 then 'discuss' else 'Russia/Ukraine war' end as final_topic,
                 case when conv_id % 5 = 0 then 'No' else 'Yes' end as final_on_topic
          from posts_fx where conv_id % 3 <> 1)
"""


def coded_conversations(spark: SparkSession, sf: str) -> DataFrame:
    conv = F.col("conv_id")
    return (
        fx.conversation_ids(spark, sf)
        .where(conv % 3 != 1)
        .select(
            "conversation_id",
            F.when(conv % 4 == 0, "Not sure")
            .when(conv % 4 == 1, None)
            .when(conv % 4 == 2, "discuss")
            .otherwise("Russia/Ukraine war")
            .alias("final_topic"),
            F.when(conv % 5 == 0, "No").otherwise("Yes").alias("final_on_topic"),
        )
    )


@query(
    "recode_offtopic",
    fx.with_views(
        """select pid, case when final_topic is null or final_topic in ('Not sure', 'discuss') or russia + midterms + childcare = 0
                            then 'Off_topic' else final_topic end as final_topic
           from posts_fx join coded using (conversation_id)""",
        CODED.strip(),
    ),
)
def recode_offtopic(spark: SparkSession, sf: str) -> DataFrame:
    coded = rel.join_codes(fx.posts(spark, sf), coded_conversations(spark, sf))
    return post_ops.recode_off_topic(coded).select("pid", "final_topic")


CORPUS = """
corpus as (select pid, 'a' as platform, conversation_id, text from posts_fx
           union all select cast(doc_id as varchar), 'b', source, text from documents)
"""


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    of_a = fx.raw_posts(spark, sf).select(F.col("pid").alias("tweet_id"), "conversation_id", "text")
    of_b = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("pid"), F.col("source").alias("conversation_id"), "text"
    )
    return post_ops.harmonise(of_a, "a", {"tweet_id": "pid"}).unionByName(
        post_ops.harmonise(of_b, "b", {})
    )


@query(
    "harmonise_platforms",
    fx.with_views("select platform, pid, conversation_id, text from corpus", CORPUS.strip()),
)
def harmonise_platforms(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf)


@query(
    "union_all",
    fx.with_views(
        """select 'posts' as source, pid, null as lang, length(text) as n_chars from posts_fx
           union all select 'documents', cast(doc_id as varchar), lang, length(text) from documents"""
    ),
)
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    length = F.length("text").cast("long").alias("n_chars")
    posts = fx.raw_posts(spark, sf).select("pid", length)
    documents = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("pid"), "lang", length
    )
    return rel.stack(posts=posts, documents=documents)


# --- joins ------------------------------------------------------------------------


@query(
    "join_loadings",
    fx.with_views(
        "select pid, p.conversation_id, "
        + ", ".join(f"round(l.t{j}, 6) as t{j}" for j in range(10))
        + " from posts_fx p join loading_fx l using (pid)"
    ),
)
def join_loadings(spark: SparkSession, sf: str) -> DataFrame:
    loadings = fx.loadings(spark, sf).drop("conversation_id")
    joined = rel.join_loadings(fx.raw_posts(spark, sf), loadings)
    return joined.select("pid", "conversation_id", *[F.round(t, 6).alias(t) for t in rollups.LOADINGS])


@query(
    "join_codes",
    fx.with_views("select pid, conversation_id, final_on_topic, final_topic from posts_fx join coded using (conversation_id)", CODED.strip()),
)
def join_codes(spark: SparkSession, sf: str) -> DataFrame:
    posts = fx.raw_posts(spark, sf).select("pid", "conversation_id")
    return rel.join_codes(posts, coded_conversations(spark, sf))


@query(
    "join_label_corpus",
    """select case when quality = 1 then 'good' else 'poor' end as final_topic, count(*) as n_posts,
              count(distinct source) as n_conversations
       from labels join documents using (doc_id) group by 1""",
)
def join_label_corpus(spark: SparkSession, sf: str) -> DataFrame:
    labeled = table(spark, sf, "labels").select(
        F.col("doc_id").alias("pid"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("final_topic")
    )
    documents = table(spark, sf, "documents").select(
        F.col("doc_id").alias("pid"), F.col("source").alias("conversation_id")
    )
    return rel.label_coverage(labeled, documents)


@query(
    "remaining_ids",
    fx.with_views(
        """select distinct conversation_id from posts_fx
           where conversation_id not in (from done_fx) and conversation_id not in (from failed_fx)"""
    ),
)
def remaining_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = fx.conversation_ids(spark, sf).select("conversation_id")
    return rel.remaining(ids, fx.done_ids(spark, sf), fx.failed_ids(spark, sf))


@query(
    "restrict_ids",
    fx.with_views("select pid, conversation_id from posts_fx where conversation_id in (from done_fx)"),
)
def restrict_ids(spark: SparkSession, sf: str) -> DataFrame:
    posts = fx.raw_posts(spark, sf).select("pid", "conversation_id")
    return rel.restrict(posts, fx.done_ids(spark, sf))


@query("lookup_topic", fx.with_views("select event_id, keyword, topic from seeds_fx where topic is not null"))
def lookup_topic(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = kw.lookup_topic(fx.seeds(spark, sf).select("event_id", "keyword"), fx.seed_dictionary(spark))
    return found


@query(
    "lookup_unmatched",
    fx.with_views("select keyword, count(*) as n_rows from seeds_fx where topic is null group by keyword"),
)
def lookup_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    _, missing = kw.lookup_topic(fx.seeds(spark, sf).select("event_id", "keyword"), fx.seed_dictionary(spark))
    return missing


# conversations divisible by seven have no table; a third of the other posts were lost
LOST = "substr(md5(pid), 1, 1) in ('0', '1', '2', '3', '4')"


@query(
    "recover_missing",
    fx.with_views(
        f"""select pid, p.conversation_id, {clean_sql('text')} as text, parent_id, topics from posts_fx p
            where conv_id % 7 <> 0 and exists (select 1 from posts_fx k where k.conversation_id = p.conversation_id and not {LOST.replace('pid', 'k.pid')})"""
    ),
)
def recover_missing(spark: SparkSession, sf: str) -> DataFrame:
    """The retrieved posts plus those recovered from the pages make every post again."""
    words = fx.dictionary(spark)
    read = pages.page_posts(pages.read_pages(spark, fx.write_pages(spark, sf)))
    conv = F.split_part("pid", F.lit("-"), F.lit(1)).cast("long")
    lost = F.substring(F.md5("pid"), 1, 1).isin("0", "1", "2", "3", "4")
    retrieved = post_ops.project_page_posts(read, words).where((conv % 7 != 0) & ~lost)
    found = post_ops.recover_missing(retrieved, read, pages.seed_locations(read))
    completed = rel.dedup_rows(retrieved.unionByName(post_ops.project_page_posts(found, words)))
    return completed.select(
        "pid", "conversation_id", "text", "parent_id", kw.join_topics(F.col("topics")).alias("topics")
    )


@query(
    "seed_threads",
    fx.with_views(
        """select thread_id, arg_max(keyword, event_id) as keyword,
                  concat('/r/x/comments/', thread_id, '/title') as path
           from seeds_fx group by thread_id"""
    ),
)
def seed_threads(spark: SparkSession, sf: str) -> DataFrame:
    return rel.seed_threads(fx.seeds(spark, sf), "event_id")


SLOTS = """
span as (select event_type as keyword, min(cast(floor(epoch(ts)) as bigint)) // 86400 * 86400 as first_at,
                max(cast(floor(epoch(ts)) as bigint)) as last_at from events group by event_type)
"""


def keyword_spans(spark: SparkSession, sf: str) -> DataFrame:
    at = tx.epoch_seconds(F.col("ts"))
    spans = table(spark, sf, "events").groupBy(F.col("event_type").alias("keyword")).agg(
        F.min(at).alias("_first"), F.max(at).alias("last_at")
    )
    return spans.select("keyword", (F.col("_first") - F.col("_first") % 86400).alias("first_at"), "last_at")


@query(
    "slot_plan",
    f"""with {SLOTS.strip()}
        select keyword, after, after + 21600 as before
        from (select keyword, unnest(generate_series(first_at, last_at, 21600)) as after from span) s""",
)
def slot_plan(spark: SparkSession, sf: str) -> DataFrame:
    return rel.slot_plan(keyword_spans(spark, sf), F.col("first_at"), F.col("last_at"))


# --- sets -------------------------------------------------------------------------


@query(
    "set_algebra",
    fx.with_views(
        """select 'union' as op, conversation_id from (from done_fx union from failed_fx) u
           union all select 'intersection', conversation_id from (from done_fx intersect from failed_fx) i
           union all select 'difference', conversation_id from (from done_fx except from failed_fx) d"""
    ),
)
def set_algebra(spark: SparkSession, sf: str) -> DataFrame:
    done, failed = fx.done_ids(spark, sf), fx.failed_ids(spark, sf)
    results = {
        "union": rel.set_union(done, failed),
        "intersection": rel.set_intersection(done, failed),
        "difference": rel.set_difference(done, failed),
    }
    return rel.stack(**results).withColumnRenamed("source", "op")


@query("dedup_rows", fx.with_views("select platform, pid, conversation_id, author, parent_id, text, topics, tox from posts_fx"))
def dedup_rows(spark: SparkSession, sf: str) -> DataFrame:
    posts = fx.posts(spark, sf).select(
        "platform", "pid", "conversation_id", "author", "parent_id", "text", "topics", "tox"
    )
    return rel.dedup_rows(posts.unionByName(posts))


KEEP = """
select conversation_id, arg_min(pid, turn) as first_pid, arg_min(author, turn) as first_author,
       arg_max(pid, turn) as last_pid, arg_max(author, turn) as last_author
from posts_fx group by conversation_id
"""


@query("dedup_keep", fx.with_views(KEEP))
def dedup_keep(spark: SparkSession, sf: str) -> DataFrame:
    posts = fx.raw_posts(spark, sf).select("conversation_id", "pid", "author", "turn")
    first = rel.dedup_keep(posts, ["conversation_id"], ["turn"], "first")
    last = rel.dedup_keep(posts, ["conversation_id"], ["turn"], "last")
    return first.select(
        "conversation_id", F.col("pid").alias("first_pid"), F.col("author").alias("first_author")
    ).join(
        last.select("conversation_id", F.col("pid").alias("last_pid"), F.col("author").alias("last_author")),
        "conversation_id",
    )
