"""Posts, loadings, codes and raw documents derived from the given tables.

Each comes twice: as a DataFrame made with our operators, and as plain SQL for
the checks.
"""

from __future__ import annotations

import gzip
import json
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.keywords import Dictionary, join_topics
from threadloom.plans.registry import table
from threadloom.session import scratch_path
from threadloom.sources.survey import METADATA_COLUMNS

KEYWORDS = {
    "russia": ["#ThingOunt", "nicht"],
    "midterms": ["thtion", "#DemNow"],
    "childcare": ["#ThereHand", "where"],
}
CODED = ("Childcare/parenting", "Russia/Ukraine war", "US midterm elections")
LEXICON = ("the", "that", "dans", "nicht", "was", "eine")
LEXICON_SQL = ", ".join(f"'{w}'" for w in LEXICON)
PAGE_POSTS = 4
THREAD_POSTS = 500
THREADS_AT_ONCE = 50
SHEET_ITEMS = 200


@lru_cache(maxsize=4)
def dictionary(spark: SparkSession) -> Dictionary:
    return Dictionary.of(spark, KEYWORDS)


# --- posts -------------------------------------------------------------------

POSTS = """
select platform, pid, conversation_id, conv_id, turn, author, parent_id, text, russia, midterms, childcare, tox,
       concat_ws(' | ', case when childcare=1 then 'childcare' end, case when midterms=1 then 'midterms' end,
                 case when russia=1 then 'russia' end) as topics
from (
  select case when conv_id % 3 = 0 then 'b' else 'a' end as platform, conv_id,
         concat(conv_id,'-',turn) as pid, concat('c',conv_id) as conversation_id, turn,
         concat('u',(conv_id*7+turn*3)%5) as author,
         case when turn>0 then concat(conv_id,'-',(conv_id*31+turn*17)%turn) end as parent_id,
         text,
         case when contains(lower(text),'thing') or contains(lower(text),'ount') or contains(lower(text),'nicht') then 1 else 0 end as russia,
         case when contains(lower(text),'thtion') or contains(lower(text),'dem') then 1 else 0 end as midterms,
         case when contains(lower(text),'there') or contains(lower(text),'hand') or contains(lower(text),'where') then 1 else 0 end as childcare,
         case when (conv_id+turn)%7=0 then null else ((conv_id*37+turn*53)%101)/100e0 end as tox
  from conversations) p
"""

EPOCH = 1664496000  # 2022-09-30


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untagged posts: ids, author, parent and text."""
    conv, turn = F.col("conv_id"), F.col("turn")
    parent = F.concat_ws("-", conv, F.pmod(conv * 31 + turn * 17, F.greatest(turn, F.lit(1))))
    return table(spark, sf_dir, "conversations").select(
        F.when(conv % 3 == 0, "b").otherwise("a").alias("platform"),
        "conv_id",
        F.concat_ws("-", conv, turn).alias("pid"),
        F.concat(F.lit("c"), conv).alias("conversation_id"),
        "turn",
        F.concat(F.lit("u"), (conv * 7 + turn * 3) % 5).alias("author"),
        F.when(turn > 0, parent).alias("parent_id"),
        "text",
        F.when((conv + turn) % 7 != 0, ((conv * 37 + turn * 53) % 101) / F.lit(100.0)).alias("tox"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts tagged with the fixture dictionary, topics serialised."""
    tagged = dictionary(spark).tag(raw_posts(spark, sf_dir))
    return tagged.drop("matched_words").withColumn("topics", join_topics(F.col("topics")))


def created_epoch() -> Column:
    return F.lit(EPOCH) + F.col("conv_id") * 86400 + F.col("turn") * 61


CREATED_SQL = (
    f"strftime(timestamp '1970-01-01' + to_seconds({EPOCH} + conv_id * 86400 + turn * 61), '%Y-%m-%dT%H:%M:%S.000Z')"
)

# --- loadings -----------------------------------------------------------------

_RAW = [f"(1 + (conv_id*{j + 3} + turn*{2 * j + 1}) % 11)" for j in range(10)]
LOADINGS = (
    "select concat(conv_id,'-',turn) as pid, concat('c',conv_id) as conversation_id, "
    + ", ".join(f"r{j} / total as t{j}" for j in range(10))
    + " from (select conv_id, turn, "
    + ", ".join(f"{raw} * 1e0 as r{j}" for j, raw in enumerate(_RAW))
    + ", ("
    + " + ".join(_RAW)
    + ") * 1e0 as total from conversations) l"
)


def loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten loadings per post that add up to one."""
    conv, turn = F.col("conv_id"), F.col("turn")
    parts = [((conv * (j + 3) + turn * (2 * j + 1)) % 11 + 1).cast("double") for j in range(10)]
    total = sum(parts[1:], parts[0])
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", conv, turn).alias("pid"),
        F.concat(F.lit("c"), conv).alias("conversation_id"),
        *[(part / total).alias(f"t{j}") for j, part in enumerate(parts)],
    )


# --- codes --------------------------------------------------------------------

CODING = """
select doc_id, concat('d',doc_id) as cid, 1 + doc_id % 3 as round,
       case when doc_id%13=0 then 'Not sure' when quality=1 then 'Yes' else 'No' end as c1_on_topic,
       case when doc_id%17=0 then null when doc_id%11=0 then 'No' when toxic=1 then 'Not sure' when quality=1 then 'Yes' else 'No' end as c2_on_topic,
       case doc_id%3 when 0 then 'Childcare/parenting' when 1 then 'Russia/Ukraine war' else 'US midterm elections' end as c1_topic,
       case (doc_id + case when doc_id%5=0 then 1 else 0 end)%3 when 0 then 'Childcare/parenting' when 1 then 'Russia/Ukraine war' else 'US midterm elections' end as c2_topic,
       case when doc_id%19=0 then 'No' else 'Yes' end as c1_english
from labels
"""
# rows of CODING that were settled later, null answers included
SETTLED = """
select cid as convo_id, case when doc_id % 4 = 0 then 'Yes' end as final_on_topic,
       case when doc_id % 4 = 0 then 'Russia/Ukraine war' end as final_is_topic
from coding_fx where doc_id % 22 = 0
"""


def coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of two coders, one row per item."""
    doc, quality, toxic = F.col("doc_id"), F.col("quality"), F.col("toxic")
    by_quality = F.when(quality == 1, "Yes").otherwise("No")

    def topic(key: Column) -> Column:
        return F.element_at(F.array(*[F.lit(t) for t in CODED]), (key % 3 + 1).cast("int"))

    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.concat(F.lit("d"), doc).alias("cid"),
        (1 + doc % 3).alias("round"),
        F.when(doc % 13 == 0, "Not sure").otherwise(by_quality).alias("c1_on_topic"),
        F.when(doc % 17 == 0, None)
        .when(doc % 11 == 0, "No")
        .when(toxic == 1, "Not sure")
        .otherwise(by_quality)
        .alias("c2_on_topic"),
        topic(doc).alias("c1_topic"),
        topic(doc + F.when(doc % 5 == 0, 1).otherwise(0)).alias("c2_topic"),
        F.when(doc % 19 == 0, "No").otherwise("Yes").alias("c1_english"),
    )


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes = F.col("doc_id") % 4 == 0
    return (
        coding(spark, sf_dir)
        .where(F.col("doc_id") % 22 == 0)
        .select(
            F.col("cid").alias("convo_id"),
            F.when(yes, "Yes").alias("final_on_topic"),
            F.when(yes, "Russia/Ukraine war").alias("final_is_topic"),
        )
    )


# --- seeds --------------------------------------------------------------------

SEED_TOPICS = {"click": "russia", "view": "midterms", "purchase": "childcare", "signup": "russia"}
SEEDS = """
select event_id, cast(user_id as varchar) as thread_id, event_type as keyword,
       concat('/r/x/comments/', user_id, '/title/', event_id, '/') as permalink,
       case event_type when 'click' then 'russia' when 'view' then 'midterms' when 'purchase' then 'childcare'
                       when 'signup' then 'russia' end as topic
from events
"""


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        "event_id",
        user.alias("thread_id"),
        F.col("event_type").alias("keyword"),
        F.concat(
            F.lit("/r/x/comments/"), user, F.lit("/title/"), F.col("event_id"), F.lit("/")
        ).alias("permalink"),
    )


def seed_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEED_TOPICS.items()), "term string, topic string")


# --- id sets ------------------------------------------------------------------

DONE = "select distinct conversation_id from posts_fx where conv_id % 4 = 0"
FAILED = "select distinct conversation_id from posts_fx where conv_id % 9 = 1"


def conversation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_posts(spark, sf_dir).select("conv_id", "conversation_id").distinct()


def done_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_ids(spark, sf_dir).where(F.col("conv_id") % 4 == 0).select("conversation_id")


def failed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_ids(spark, sf_dir).where(F.col("conv_id") % 9 == 1).select("conversation_id")


def with_views(body: str, *extra: str, recursive: bool = False) -> str:
    """``body`` after the fixture views it mentions. ``extra`` are further views, in order."""
    known = {
        "posts_fx": POSTS,
        "loading_fx": LOADINGS,
        "coding_fx": CODING,
        "settled_fx": SETTLED,
        "seeds_fx": SEEDS,
        "done_fx": DONE,
        "failed_fx": FAILED,
    }
    text = body + " ".join(extra)
    for name in reversed(known):  # a view may mention earlier ones
        text += known[name] if name in text else ""
    views = [f"{name} as ({sql})" for name, sql in known.items() if name in text] + list(extra)
    return ("with recursive " if recursive else "with ") + ",\n".join(views) + "\n" + body


# --- raw documents ------------------------------------------------------------


def write_pages(spark: SparkSession, sf_dir: str) -> str:
    """Search-result pages of four posts, the fourth in the ``includes`` arm."""
    references = F.when(
        F.col("turn") > 0,
        F.array(
            F.struct(F.lit("quoted").alias("type"), F.concat(F.lit("q"), F.col("pid")).alias("id")),
            F.struct(F.lit("replied_to").alias("type"), F.lit("earlier").alias("id")),
            F.struct(F.lit("replied_to").alias("type"), F.col("parent_id").alias("id")),
        ),
    )
    post = F.struct(
        F.col("pid").alias("id"),
        "conversation_id",
        "text",
        F.col("author").alias("author_id"),
        F.when(F.col("turn") > 0, F.col("author")).alias("in_reply_to_user_id"),
        references.alias("referenced_tweets"),
        tx.epoch_iso(created_epoch()).alias("created_at"),
    )
    include = F.col("turn") % PAGE_POSTS == PAGE_POSTS - 1
    pages = (
        raw_posts(spark, sf_dir)
        .withColumn("block", F.floor(F.col("turn") / PAGE_POSTS))
        .groupBy("conversation_id", "block")
        .agg(
            F.collect_list(F.when(~include, post)).alias("data"),
            F.collect_list(F.when(include, post)).alias("tweets"),
            F.count("*").cast("int").alias("n"),
        )
    )
    document = F.struct(
        "data",
        F.when(F.size("tweets") > 0, F.struct("tweets")).alias("includes"),
        F.struct(F.col("n").alias("result_count")).alias("meta"),
        F.concat(F.lit("/raw/"), F.col("conversation_id"), F.lit("_"), F.col("block"), F.lit(".json.gz")).alias(
            "filename"
        ),
    )
    path = scratch_path(spark, "pages")
    pages.select(F.to_json(document).alias("value")).write.option("compression", "gzip").text(path)
    return path


#: Packed files, and those of them that are cut off behind the pages of the first block.
PACKED_FILES, CUT_FILES = 11, (3, 7)


def write_packed_pages(spark: SparkSession, sf_dir: str) -> str:
    """The same pages packed into one compressed file per group of conversations.

    In two files the pages behind the first of each conversation are lost with the end of the file,
    and one holds a line that is no page.
    """
    lines = spark.read.text(write_pages(spark, sf_dir))
    name = F.get_json_object("value", "$.filename")
    group = F.regexp_extract(name, r"/raw/c([0-9]+)_", 1).cast("long") % PACKED_FILES
    block = F.regexp_extract(name, r"_([0-9]+)\.json", 1).cast("long")
    folder = scratch_path(spark, "packed")
    packed = lines.select(group.alias("pack"), block.alias("block"), "value").groupBy("pack").applyInArrow(
        _packed, "pack long, content binary"
    )
    # A text is written as it is, whatever its bytes; what follows it is padding of the last member.
    packed.select("pack", F.col("content").cast("string")).write.partitionBy("pack").option("lineSep", "\0").text(folder)
    return folder


def _packed(rows: pa.Table) -> pa.Table:
    pack = rows.column("pack")[0].as_py()
    pages = sorted(zip(rows.column("block").to_pylist(), rows.column("value").to_pylist(), strict=True))
    first = "".join(f"{value}\n" for block, value in pages if block == 0)
    later = "".join(f"{value}\n" for block, value in pages if block > 0)
    if pack == 5:
        later += "<html>busy</html>\n"
    second = gzip.compress(later.encode(), mtime=0)
    content = gzip.compress(first.encode(), mtime=0) + (second[:10] if pack in CUT_FILES else second)
    return pa.table({"pack": [pack], "content": pa.array([content], pa.binary())})


PAGE_FILE = "concat('/raw/', conversation_id, '_', turn // 4, '.json.gz')"
IS_INCLUDE = "case when turn % 4 = 3 then 1 else 0 end"

HIDDEN = "(turn > 0 and (conv_id * 3 + turn) % 4 = 0 and not exists (select 1 from posts_fx k where k.parent_id = p.pid))"


def _thread_document(rows: list) -> str:
    """One nested document for one block of a conversation, posts in order of turn."""
    ids = {r.pid for r in rows}
    children: dict[str, list] = {}
    for row in rows:
        children.setdefault(row.parent_id, []).append(row)
    hidden = {
        r.pid for r in rows if r.turn > 0 and (r.conv_id * 3 + r.turn) % 4 == 0 and r.pid not in children
    }
    nodes: dict[str, dict] = {}
    listings: dict[str, list] = {}
    for row in reversed(rows):
        below = children.get(row.pid, [])
        listing = [nodes[c.pid] for c in below if c.pid not in hidden]
        collapsed = [c.pid for c in below if c.pid in hidden]
        if collapsed:
            listing.append({"kind": "more", "data": {"parent_id": f"t1_{row.pid}", "children": collapsed}})
        listings[row.pid] = listing
        post = {"id": row.pid, "author": row.author, "created_utc": float(row.created)}
        if row.turn == 0:
            post |= {
                "title": f"Thread {row.conv_id}",
                "selftext": row.text,
                "permalink": f"/r/x/{row.pid}/",
                "over_18": row.conv_id % 2 == 0,
            }
        else:
            post |= {
                "parent_id": f"t1_{row.parent_id}",
                "body": row.text,
                "replies": {"data": {"children": listing}} if listing else "",
            }
        nodes[row.pid] = {"kind": "t1", "data": post}
    roots = [r.pid for r in rows if r.turn == 0]
    top = [node for pid in roots for node in listings[pid]]
    top += [nodes[r.pid] for r in rows if r.turn > 0 and r.parent_id not in ids]
    document = [{"data": {"children": [nodes[pid] for pid in roots]}}, {"data": {"children": top}}]
    return json.dumps(document)


def _thread_documents(rows: pd.DataFrame) -> pd.DataFrame:
    ordered = rows.sort_values(["conv_id", "turn"]).itertuples()
    documents = [_thread_document(list(part)) for _, part in groupby(ordered, key=lambda r: r.conv_id)]
    return pd.DataFrame({"value": documents})


def write_threads(spark: SparkSession, sf_dir: str, where: str = "true") -> str:
    """Nested threads with collapsed nodes, one document per 500 posts of a conversation.

    A task builds the documents of fifty conversations at a time.
    """
    rows = raw_posts(spark, sf_dir).where(where).select(
        "conv_id",
        "turn",
        "pid",
        "author",
        "parent_id",
        "text",
        created_epoch().alias("created"),
        F.floor(F.col("turn") / THREAD_POSTS).alias("block"),
        F.floor(F.col("conv_id") / THREADS_AT_ONCE).alias("batch"),
    )
    path = scratch_path(spark, "threads")
    rows.groupBy("batch", "block").applyInPandas(_thread_documents, "value string").write.text(path)
    return path


def write_sheets(spark: SparkSession, sf_dir: str) -> str:
    """Survey exports of up to 200 items each: header, two sub-headers, one row per coder."""
    coded = coding(spark, sf_dir).withColumn("sheet", F.floor(F.col("doc_id") / SHEET_ITEMS))
    has_english = F.col("doc_id") % 4 != 0
    meta = [c for c in METADATA_COLUMNS if c != "coder"]

    def cells(on_topic: Column, topic: Column, english: Column) -> Column:
        values = [F.coalesce(v, F.lit("")) for v in (on_topic, topic)]
        return F.concat_ws(",", *values, F.when(has_english, F.coalesce(english, F.lit(""))))

    cid = F.col("cid")
    item = F.struct(
        "doc_id",
        cells(cid, F.concat(cid, F.lit("_topic")), F.concat(cid, F.lit("_english"))).alias("header"),
        cells(F.col("c1_on_topic"), F.col("c1_topic"), F.col("c1_english")).alias("Coder1"),
        cells(F.col("c2_on_topic"), F.col("c2_topic"), F.lit(None)).alias("Coder2"),
    )

    def line(head: list[str], column: str) -> Column:
        joined = F.array_join(F.transform("items", lambda i: i[column]), ",")
        return F.concat(F.lit(",".join(head) + ","), joined)

    def row(coder: str) -> list[str]:
        fixed = {"ResponseId": f"R_{coder}", "RecipientLastName": coder, "IPAddress": '"10.0,0.1"'}
        return [fixed.get(c, "x") for c in meta]

    sub_header = [f'"{{""ImportId"":""{c}""}}"' for c in meta]
    content = F.concat_ws(
        "\n",
        line(meta, "header"),
        line(["Question text" for _ in meta], "header"),
        line(sub_header, "header"),
        line(row("Coder1"), "Coder1"),
        line(row("Coder2"), "Coder2"),
    )
    path = scratch_path(spark, "sheets")
    (
        coded.groupBy("sheet")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .select("sheet", content.alias("value"))
        .write.partitionBy("sheet")
        .text(path)
    )
    return path
