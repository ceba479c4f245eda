"""Sources and sinks, round-tripped through files written from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.functions import text as tx
from threadloom.functions.keywords import join_topics
from threadloom.operators import posts as post_ops
from threadloom.operators import ranking, rollups
from threadloom.plans import fixtures as fx
from threadloom.plans.registry import query, table
from threadloom.session import scratch_path
from threadloom.sources import packed, pages, sinks, survey, tables, threads

SPACES = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def clean_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SPACES}', ' ', 'g'))"


@query(
    "scan_pages",
    fx.with_views(
        f"""select pid as id, conversation_id, {fx.IS_INCLUDE} as is_include, author as author_id, text,
                   {fx.CREATED_SQL} as created_at, {fx.PAGE_FILE} as filename
            from posts_fx"""
    ),
)
def scan_pages(spark: SparkSession, sf: str) -> DataFrame:
    read = pages.page_posts(pages.read_pages(spark, fx.write_pages(spark, sf)))
    return read.select(
        "id", "conversation_id", "is_include", "author_id", "text", "created_at", "filename"
    )


@query(
    "unreadable_pages",
    fx.with_views(
        f"""select min(page) filter (pack = 5 or block = 0) as first_page,
                   count(*) filter (pack = 5 or block = 0) as pages_read,
                   case when pack = 5 then 1 else 0 end::bigint as bad_lines, case when pack <> 5 then 'cut off' end as problem
            from (select distinct conv_id % {fx.PACKED_FILES} as pack, {fx.PAGE_FILE} as page, turn // 4 as block
                  from posts_fx) p
            where pack in (3, 5, 7) group by pack"""
    ),
)
def unreadable_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Files that are cut off or hold a line that is no page, with the first of the pages read."""
    lines = packed.read_packed(spark, fx.write_packed_pages(spark, sf))
    name = F.get_json_object("value", "$.filename")
    first = lines.groupBy("file").agg(F.min(name).alias("first_page"))
    return packed.unreadable_pages(lines).join(first, "file").select("first_page", "pages_read", "bad_lines", "problem")


@query(
    "scan_packed_pages",
    fx.with_views(
        f"""select pid as id, conversation_id, {fx.IS_INCLUDE} as is_include, author as author_id, text,
                   {fx.CREATED_SQL} as created_at, {fx.PAGE_FILE} as filename
            from posts_fx where turn < 4 or conv_id % {fx.PACKED_FILES} not in {fx.CUT_FILES}"""
    ),
)
def scan_packed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The posts of packed files, up to the damage of two of them."""
    lines = packed.read_packed(spark, fx.write_packed_pages(spark, sf))
    return pages.page_posts(packed.packed_pages(lines)).select(
        "id", "conversation_id", "is_include", "author_id", "text", "created_at", "filename"
    )


@query(
    "scan_threads",
    fx.with_views(
        f"""select pid, concat(conv_id, '-0') as conversation_id, author, parent_id,
                   case when turn = 0 then concat('/r/x/', pid, '/') else '' end as permalink,
                   turn = 0 and conv_id % 2 = 0 as over18, {fx.CREATED_SQL} as created_at,
                   {clean_sql("concat(case when turn = 0 then concat('Thread ', conv_id) else '' end, ' ', text)")} as text
            from posts_fx p where not {fx.HIDDEN}"""
    ),
)
def scan_threads(spark: SparkSession, sf: str) -> DataFrame:
    nodes = threads.thread_nodes(threads.read_threads(spark, fx.write_threads(spark, sf)))
    return threads.thread_posts(nodes).select(
        "pid", "conversation_id", "author", "parent_id", "permalink", "over18", "created_at", "text"
    )


@query(
    "thread_stubs",
    fx.with_views(
        f"select pid, concat(conv_id, '-0') as conversation_id, parent_id, true as is_stub from posts_fx p where {fx.HIDDEN}"
    ),
)
def thread_stubs(spark: SparkSession, sf: str) -> DataFrame:
    return threads.thread_stubs(
        threads.thread_nodes(threads.read_threads(spark, fx.write_threads(spark, sf)))
    )


def _tsv_posts(spark: SparkSession, sf: str) -> DataFrame:
    return fx.posts(spark, sf).select(
        "pid",
        "conversation_id",
        "author",
        "parent_id",
        tx.clean_whitespace(F.col("text")).alias("text"),
        tx.epoch_iso(fx.created_epoch()).alias("created_at"),
        "topics",
        *schemas.TOPICS,
        "tox",
    )


@query(
    "scan_tsv",
    fx.with_views(
        f"""select pid, conversation_id, author, parent_id, {clean_sql('text')} as text, {fx.CREATED_SQL} as created_at,
                   nullif(topics, '') as topics, russia, midterms, childcare, tox
            from posts_fx"""
    ),
)
def scan_tsv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "tsv")
    sinks.write_tsv(_tsv_posts(spark, sf), path)
    return tables.read_tsv(spark, path, schemas.POSTS_TSV)


@query(
    "scan_survey",
    fx.with_views(
        """select cid, 'Coder1' as coder, 'on_topic' as field, c1_on_topic as code from coding_fx
           union all select cid, 'Coder2', 'on_topic', c2_on_topic from coding_fx
           union all select cid, 'Coder1', 'topic', c1_topic from coding_fx
           union all select cid, 'Coder2', 'topic', c2_topic from coding_fx
           union all select cid, 'Coder1', 'english', c1_english from coding_fx where doc_id % 4 != 0
           union all select cid, 'Coder2', 'english', null from coding_fx where doc_id % 4 != 0"""
    ),
)
def scan_survey(spark: SparkSession, sf: str) -> DataFrame:
    return survey.read_survey(spark, fx.write_sheets(spark, sf)).drop("sheet")


@query(
    "scan_keywords",
    """select p_brand as topic, p_name as keyword from part
       union all select p_brand, concat('#', replace(p_name, ' ', '')) from part""",
)
def scan_keywords(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array("p_name", F.concat(F.lit("#"), F.replace(F.col("p_name"), F.lit(" "), F.lit(""))))
    path = scratch_path(spark, "keywords")
    document = F.to_json(F.create_map("p_brand", words)).alias("value")
    table(spark, sf, "part").select(document).write.text(path)
    return tables.read_keywords(spark, path)


@query("scan_id_list", "select distinct cast(user_id as varchar) as id from events")
def scan_id_list(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.array(
        F.concat(F.lit("  "), "user_id"), F.lit(""), F.concat("user_id", F.lit("\t503\tgone"))
    )
    path = scratch_path(spark, "ids")
    table(spark, sf, "events").select(F.explode(lines).alias("value")).write.text(path)
    return tables.read_id_list(spark, path)


@query(
    "scan_comment_dump",
    """select cast(event_id as varchar) as id, concat('u', user_id) as author, props as body,
              strftime(ts, '%Y-%m-%d %H:%M:%S') as utc_datetime_str, event_type as keyword
       from events""",
)
def scan_comment_dump(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "comments")
    (
        table(spark, sf, "events")
        .select(
            F.col("event_id").cast("string").alias("id"),
            F.concat(F.lit("u"), "user_id").alias("author"),
            F.col("props").alias("body"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("utc_datetime_str"),
            F.col("event_type").alias("keyword"),
        )
        .write.partitionBy("keyword")
        .json(path)
    )
    # one folder per keyword; files named by keyword are read the same way
    return tables.read_comment_dump(spark, f"{path}/*/").select(
        "id", "author", "body", "utc_datetime_str", "keyword"
    )


@query(
    "key_from_path",
    """select doc_id, source as first_key, cast(doc_id as varchar) as last_key from documents""",
)
def key_from_path(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("/data/raw_files/"), "source", F.lit("_page_"), "doc_id", F.lit(".json.gz"))
    return table(spark, sf, "documents").select(
        "doc_id", tx.key_before(path, "_").alias("first_key"), tx.key_after_last(path).alias("last_key")
    )


@query("empty_conversations", "select distinct concat('c', conv_id) as conversation_id from conversations where conv_id % 9 = 1")
def empty_conversations(spark: SparkSession, sf: str) -> DataFrame:
    failed = F.col("conv_id") % 9 == 1
    page = F.struct(
        F.when(~failed, F.array(F.struct(F.lit("1").alias("id")))).alias("data"),
        F.struct(F.when(failed, 0).otherwise(1).alias("result_count")).alias("meta"),
        F.concat(F.lit("/errors/c"), F.col("conv_id"), F.lit("_"), F.col("turn"), F.lit(".json.gz")).alias("filename"),
    )
    path = scratch_path(spark, "errors")
    table(spark, sf, "conversations").select(F.to_json(page).alias("value")).write.text(path)
    return pages.empty_conversations(pages.read_pages(spark, path))


@query(
    "sink_posts",
    fx.with_views(
        f"""select platform, pid, conversation_id, author, parent_id, {clean_sql('text')} as text,
                   {fx.CREATED_SQL} as created_at, topics, russia, midterms, childcare
            from posts_fx"""
    ),
)
def sink_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Written in two appends; the second replaces one platform and must leave the other."""
    source = fx.posts(spark, sf).select(
        "platform",
        "pid",
        "conversation_id",
        "author",
        "parent_id",
        tx.clean_whitespace(F.col("text")).alias("text"),
        tx.epoch_iso(fx.created_epoch()).alias("created_at"),
        F.filter(F.split("topics", r" \| "), lambda t: t != "").alias("topics"),
        *schemas.TOPICS,
    )
    posts = post_ops.conform(source)
    path = scratch_path(spark, "posts")
    sinks.write_posts(posts, path)
    sinks.write_posts(posts.where(F.col("platform") == "b"), path, mode="overwrite")
    stored = spark.read.schema(schemas.POSTS).parquet(path)
    return stored.select(
        *[c for c in source.columns if c != "topics"], join_topics(F.col("topics")).alias("topics")
    )


PAIRS = """
pairs as (select distinct topic, conversation_id
          from (select conversation_id, unnest(string_split(topics, ' | ')) as topic from posts_fx) t where topic <> '')
"""


@query("topic_convo_map", fx.with_views("select topic, conversation_id from pairs", PAIRS.strip()))
def topic_convo_map(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "topic-map")
    sinks.write_topic_map(rollups.topic_pairs(fx.posts(spark, sf)), path)
    return spark.read.schema("conversation_id string, topic string").json(path)


@query(
    "convo_topic_map",
    fx.with_views(
        "select conversation_id, string_agg(topic, ' | ' order by topic) as topics from pairs group by conversation_id",
        PAIRS.strip(),
    ),
)
def convo_topic_map(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "conversation-map")
    sinks.write_conversation_map(rollups.topic_pairs(fx.posts(spark, sf)), path)
    stored = spark.read.schema("conversation_id string, topics array<string>").json(path)
    return stored.select("conversation_id", join_topics(F.col("topics")).alias("topics"))


@query("chunk_split", "select doc_id, ntile(50) over (order by doc_id) as chunk from documents")
def chunk_split(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.chunk_split(table(spark, sf, "documents").select("doc_id"), ["doc_id"])
