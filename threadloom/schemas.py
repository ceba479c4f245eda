"""Explicit schemas of every input and output. Identifiers are always strings."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D, _B, _L = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TOPICS = ("russia", "midterms", "childcare")

# --- raw documents: key names are the input format (fixed values) ---
REFERENCE = _struct(type=_S, id=_S)
PAGE_POST = _struct(
    id=_S,
    conversation_id=_S,
    text=_S,
    author_id=_S,
    in_reply_to_user_id=_S,
    referenced_tweets=T.ArrayType(REFERENCE),
    created_at=_S,
)
PAGE = _struct(
    data=T.ArrayType(PAGE_POST),
    includes=_struct(tweets=T.ArrayType(PAGE_POST)),
    meta=_struct(result_count=_I, next_token=_S),
    filename=_S,
)
COMMENT_DUMP = _struct(id=_S, author=_S, body=_S, link_id=_S, permalink=_S, utc_datetime_str=_S)

# --- tables ---
POSTS = _struct(
    platform=_S,
    pid=_S,
    conversation_id=_S,
    author=_S,
    parent_id=_S,
    parent_author=_S,
    quote_id=_S,
    permalink=_S,
    over18=_B,
    text=_S,
    created_at=_S,
    topics=T.ArrayType(_S),
    matched_words=T.ArrayType(_S),
    russia=_I,
    midterms=_I,
    childcare=_I,
    is_stub=_B,
    tox=_D,
)
POSTS_TSV = _struct(
    pid=_S,
    conversation_id=_S,
    author=_S,
    parent_id=_S,
    text=_S,
    created_at=_S,
    topics=_S,
    russia=_I,
    midterms=_I,
    childcare=_I,
    tox=_D,
)
CONVO_STATS = _struct(
    conversation_id=_S,
    old_topic_spread=_D,
    new_topic_spread=_D,
    tox_mean=_D,
    tox_median=_D,
    tox_max=_D,
    size=_L,
    depth=_L,
    breadth=_L,
    connected=_I,
    n_users=_L,
    most_comments=_L,
    keyword_topic=_S,
    russia=_L,
    midterms=_L,
    childcare=_L,
)
