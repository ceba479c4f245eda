"""Dictionary and text scalars over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import keywords as kw
from threadloom.functions import text as tx
from threadloom.operators import models, rollups
from threadloom.plans import fixtures as fx
from threadloom.plans.registry import query, table
from threadloom.plans.scans import clean_sql
from threadloom.sources import pages

STOP = ("that", "with", "this", "there", "where", "dans", "nicht", "eine", "para", "the", "and", "thand")
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
TERMS = {
    "russia": ["#thingount", "thing", "ount", "nicht"],
    "midterms": ["thtion", "#demnow", "dem"],
    "childcare": ["#therehand", "there", "hand", "where"],
}


# --- the dictionary, built from the part names ------------------------------

# 'small ring' of a brand becomes the keyword '#SmallRing'
KEYWORDS_FX = """
select p_brand as topic, p_partkey as position,
       concat('#', upper(p_name[1]), substr(split_part(p_name, ' ', 1), 2),
              upper(split_part(p_name, ' ', 2)[1]), substr(split_part(p_name, ' ', 2), 2)) as keyword
from part
"""
EXCLUDED_SQL = ", ".join(f"'{w}'" for w in kw.EXCLUDED_PIECES)
LISTED = f"""
listed as (
  select topic, 0 as origin, position, 0 as piece, lower(keyword) as term from ({KEYWORDS_FX}) k
  union all
  select topic, 0, position, piece, lower(parts[piece]) from (
    select topic, position, parts, unnest(generate_series(1, len(parts))) as piece
    from (select topic, position, regexp_extract_all(keyword, '[A-Z][^A-Z]*') as parts from ({KEYWORDS_FX}) k) p) q
  where lower(parts[piece]) not in ({EXCLUDED_SQL}))
"""
EXTRA = """
extra as (select p_type as topic, 1 as origin, p_partkey as position, 0 as piece,
                 split_part(p_name, ' ', 2) as term from part where p_size % 3 = 0)
"""


def part_keywords(spark: SparkSession, sf: str) -> DataFrame:
    joined = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("topic"),
        F.concat(F.lit("#"), joined).alias("keyword"),
        F.col("p_partkey").alias("position"),
    )


@query(
    "expand_keywords",
    f"with {LISTED.strip()} select term, arg_max(topic, (position, piece)) as topic from listed group by term",
)
def expand_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return kw.expand_keywords(part_keywords(spark, sf))


@query(
    "expand_keywords_ext",
    f"""with {LISTED.strip()}, {EXTRA.strip()}
        select term, arg_max(topic, (origin, position, piece)) as topic
        from (select * from listed union all select * from extra) u group by term""",
)
def expand_keywords_ext(spark: SparkSession, sf: str) -> DataFrame:
    extra = (
        table(spark, sf, "part")
        .where(F.col("p_size") % 3 == 0)
        .select(
            F.col("p_type").alias("topic"),
            F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)).alias("keyword"),
            F.col("p_partkey").alias("position"),
        )
    )
    return kw.expand_keywords(part_keywords(spark, sf), extra=extra)


# --- matching ------------------------------------------------------------------

MATCHED = ", ".join(
    f"case when contains(lower(text), '{t}') then '{t}' end" for t in sorted(sum(TERMS.values(), []))
)


@query(
    "match_terms",
    fx.with_views(f"select pid, concat_ws(' | ', {MATCHED}) as matched_words, topics from posts_fx"),
)
def match_terms(spark: SparkSession, sf: str) -> DataFrame:
    tagged = fx.dictionary(spark).tag(fx.raw_posts(spark, sf).select("pid", "text"))
    return tagged.select(
        "pid",
        kw.join_topics(F.col("matched_words")).alias("matched_words"),
        kw.join_topics(F.col("topics")).alias("topics"),
    )


#: Every word of a part's name and its last three letters, with the least of its types.
PART_TERMS = """
words as (select unnest(string_split(lower(p_name), ' ')) as word, lower(p_type) as topic from part),
terms as (select term, min(topic) as topic
          from (select word as term, topic from words union all select right(word, 3), topic from words) w group by term)
"""


def part_terms(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "part").select(
        F.explode(F.split(F.lower("p_name"), " ")).alias("word"), F.lower("p_type").alias("topic")
    )
    terms = words.select(F.explode(F.array("word", F.expr("right(word, 3)"))).alias("term"), "topic")
    return terms.groupBy("term").agg(F.min("topic").alias("topic"))


@query(
    "match_terms_large",
    f"""with {PART_TERMS.strip()}
        select doc_id, coalesce(string_agg(term, ' | ' order by term), '') as matched_words,
               coalesce(string_agg(distinct topic, ' | ' order by topic), '') as topics
        from documents left join terms on contains(lower(text), term) group by doc_id""",
)
def match_terms_large(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "text")
    tagged = kw.tag_terms(documents, part_terms(spark, sf), "doc_id")
    return tagged.select(
        "doc_id",
        kw.join_topics(F.col("matched_words")).alias("matched_words"),
        kw.join_topics(F.col("topics")).alias("topics"),
    )


@query("topic_flags", fx.with_views("select pid, russia, midterms, childcare from posts_fx"))
def topic_flags(spark: SparkSession, sf: str) -> DataFrame:
    tagged = fx.dictionary(spark).tag(fx.raw_posts(spark, sf).select("pid", "text"))
    return kw.topic_flags(tagged.select("pid", "topics"), ("russia", "midterms", "childcare")).drop(
        "topics"
    )


@query(
    "join_topics",
    fx.with_views("select pid, case when topics = '' then 'None' else topics end as topics from posts_fx"),
)
def join_topics(spark: SparkSession, sf: str) -> DataFrame:
    tagged = fx.dictionary(spark).tag(fx.raw_posts(spark, sf).select("pid", "text"))
    return tagged.select("pid", kw.join_topics(F.col("topics"), "None").alias("topics"))


@query(
    "explode_topics",
    fx.with_views(
        """select pid, trim(topic) as topic
           from (select pid, unnest(string_split(topics, '|')) as topic from posts_fx) t where trim(topic) <> ''"""
    ),
)
def explode_topics(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.explode_topics(fx.posts(spark, sf)).select("pid", "topic")


@query(
    "topic_contains",
    fx.with_views(
        """select topic, count(*) as n_posts from posts_fx, (values ('russia'), ('midterms'), ('childcare')) v(topic)
           where contains(topics, topic) group by topic"""
    ),
)
def topic_contains(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.topic_contains(fx.posts(spark, sf))


# --- scalars --------------------------------------------------------------------


@query("clean_whitespace", f"select doc_id, {clean_sql('text')} as clean from documents")
def clean_whitespace(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.clean_whitespace(F.col("text")).alias("clean"))


@query(
    "assemble_text",
    """select page_id, concat(url, ' ', case page_id % 3 when 0 then html when 1 then substr(html, 2) else '' end) as text
       from pages""",
)
def assemble_text(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("page_id") % 3
    selftext = F.when(kind == 0, F.col("html"))
    body = F.when(kind <= 1, F.col("html").substr(F.lit(2), F.length("html")))
    return table(spark, sf, "pages").select(
        "page_id", tx.assemble_text(F.col("url"), selftext, body).alias("text")
    )


@query(
    "strip_id_prefix",
    "select conv_id, turn, concat(conv_id, '-', turn) as id from conversations",
)
def strip_id_prefix(spark: SparkSession, sf: str) -> DataFrame:
    prefix = F.when(F.col("turn") == 0, "t3_").when(F.col("turn") < 4, "t1_").otherwise("")
    plain = F.concat_ws("-", "conv_id", "turn")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.strip_id_prefix(F.concat(prefix, plain)).alias("id")
    )


@query(
    "thread_path",
    """select page_id, array_to_string(list_slice(string_split(url, '/'), 1, len(string_split(url, '/')) - 2), '/') as path
       from pages""",
)
def thread_path(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.thread_path(F.col("url")).alias("path"))


@query(
    "epoch_iso",
    "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') as created_at from events",
)
def epoch_iso(spark: SparkSession, sf: str) -> DataFrame:
    seconds = tx.epoch_seconds(F.col("ts"))
    return table(spark, sf, "events").select("event_id", tx.epoch_iso(seconds).alias("created_at"))


@query(
    "resolve_refs",
    fx.with_views(
        "select pid, parent_id, case when turn > 0 then concat('q', pid) end as quote_id from posts_fx"
    ),
)
def resolve_refs(spark: SparkSession, sf: str) -> DataFrame:
    read = pages.page_posts(pages.read_pages(spark, fx.write_pages(spark, sf)))
    refs = F.col("referenced_tweets")
    return read.select(
        F.col("id").alias("pid"),
        tx.last_reference(refs, "replied_to").alias("parent_id"),
        tx.last_reference(refs, "quoted").alias("quote_id"),
    )


def kept_sql(tokens: str) -> str:
    mark = tx.PUNCTUATION.replace("'", "''")
    return (
        f"list_filter({tokens}, lambda t: length(t) >= 4 and not contains('{mark}', t)"
        f" and not list_contains([{STOP_SQL}], t))"
    )


NORMALIZED = f"""
cut as (select doc_id, string_split({clean_sql(
    "regexp_replace(trim(regexp_replace(lower(text), '@[\\pL\\pM\\p{Nd}\\p{Pc}]+', '', 'g')), 'https?://[A-Za-z0-9./]+', ' ', 'g')"
)}, ' ') as first from documents),
recut as (select doc_id, flatten(list_transform(first, lambda t: [
    regexp_extract(t, '^([[:punct:]]*)(.*?)([[:punct:]]*)$', 1),
    regexp_extract(t, '^([[:punct:]]*)(.*?)([[:punct:]]*)$', 2),
    regexp_extract(t, '^([[:punct:]]*)(.*?)([[:punct:]]*)$', 3)])) as edges from cut)
"""


@query(
    "normalize_text",
    f"""with {NORMALIZED.strip()}
        select doc_id, array_to_string({kept_sql('edges')}, ' ') as clean_text
        from recut""",
)
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return documents.select("doc_id", tx.normalize_text(F.col("text"), STOP).alias("clean_text"))


TOKENS_SQL = (
    "list_filter(regexp_extract_all(strip_accents(lower(text)), '[\\pL\\pM\\p{Pc}]+'),"
    f" lambda t: length(t) between 2 and 15 and not starts_with(t, '_') and not list_contains([{STOP_SQL}], t))"
)


@query(
    "simple_tokens",
    fx.with_views(f"select pid, array_to_string({TOKENS_SQL}, ' ') as tokens from posts_fx"),
)
def simple_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = tx.simple_tokens(F.col("text"), STOP)
    return fx.raw_posts(spark, sf).select("pid", F.array_join(tokens, " ").alias("tokens"))


@query(
    "doc_bow",
    fx.with_views(
        f"""select pid, token, count(*) as n from (select pid, unnest({TOKENS_SQL}) as token from posts_fx) t
            group by pid, token"""
    ),
)
def doc_bow(spark: SparkSession, sf: str) -> DataFrame:
    return models.doc_bow(fx.raw_posts(spark, sf), "pid", tx.simple_tokens(F.col("text"), STOP))
