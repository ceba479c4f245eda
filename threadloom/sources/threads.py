"""Nested discussion threads: a two-element JSON array per thread."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as tx

_POST = (
    "id string, author string, created_utc double, parent_id string, permalink string, "
    "over_18 boolean, title string, selftext string, body string, children array<string>"
)
_NODE = f"struct<data: struct<{_POST.replace(' ', ':').replace(',:', ',')}>>"
_FIELDS = [field.split()[0] for field in _POST.split(", ")]
_FLAT = "struct<root: string, nodes: array<string>>"

#: A token of JSON as the parser of Spark reads it: quotes may be single, numbers not finite.
_TOKEN = re.compile(
    r"""[ \t\r\n]*([{}\[\],:]
    |"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*"
    |'[^'\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^'\\\x00-\x1f]*)*'
    |true|false|null|NaN|[+-]?INF(?:inity)?|[+-]?Infinity
    |-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)""",
    re.VERBOSE,
)
#: What an object or array holds by what holds it; the rest is read over.
_INSIDE = {
    ("document", None): "listing",
    ("listing", "data"): "listing data",
    ("listing data", "children"): "nodes",
    ("nodes", None): "node",
    ("node", "data"): "post",
    ("post", "replies"): "listing",
}
_ARRAYS = {"document", "nodes"}


def _name(token: str) -> str:
    return json.loads(token) if token[0] == '"' else json.loads('"' + token[1:-1].replace('"', '\\"') + '"')


def _parsed(text: str) -> list | None:
    """The listings of a document, read without recursion, or null if it is no JSON.

    Of every object only the fields of the schema are kept: a listing and its data as dicts, the
    fields of a post as their JSON text. Later fields of the same name replace earlier ones.
    """
    at, stack = 0, []
    # one frame per open object or array: its role, its value, where it begins, the field it is at
    while True:
        token = _TOKEN.match(text, at)
        if token is None:
            return None
        begin, at = token.start(1), token.end(1)
        mark = token[1]
        if stack and mark in "}]":
            role, value, opened, field, is_array, state = stack.pop()
            if (mark == "]") != is_array or state not in ("first", "after"):
                return None
            raw, here = text[opened:at], role
        elif stack and mark == ",":
            if stack[-1][5] != "after":
                return None
            stack[-1][5] = "next"
            continue
        elif stack and mark == ":":
            if stack[-1][5] != "colon":
                return None
            stack[-1][5] = "value"
            continue
        elif stack and not stack[-1][4] and stack[-1][5] in ("first", "next"):
            if mark[0] not in "\"'":
                return None
            stack[-1][3], stack[-1][5] = _name(mark), "colon"
            continue
        elif mark in "}],:" or (stack and stack[-1][5] not in ("first", "next", "value")):
            return None
        elif mark in "{[":
            if stack:
                role = _INSIDE.get((stack[-1][0], stack[-1][3]))
            else:
                role = "document" if mark == "[" else "listing"
            if (mark == "[") != (role in _ARRAYS):
                role = None
            stack.append([role, [] if mark == "[" else {}, begin, None, mark == "[", "first"])
            continue
        else:
            value, raw, here = None, mark, None
        if not stack:
            # what follows the document is not read, as in the parser of Spark
            return None if here is None else value if here == "document" else [value]
        holder = stack[-1]
        holder[5] = "after"
        if holder[0] in _ARRAYS:
            holder[1].append(value if here else None)
        elif holder[0] == "post" and holder[3] in (*_FIELDS, "replies"):
            holder[1][holder[3]] = value if here else _text_field(holder[3], raw)
        elif (holder[0], holder[3]) in _INSIDE:
            holder[1][holder[3]] = value if here else None


def _text_field(field: str, raw: str) -> str:
    """The JSON of a field; an object in place of a text is its text, at any depth."""
    if raw[0] not in "[{" or field == "children":
        return raw
    if field == "replies":
        return "null"
    return json.dumps("".join(m[1] for m in _TOKEN.finditer(raw)), ensure_ascii=False)


class _Number(str):
    """The digits of a number as written."""


_DECODER = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_Number)
_quoted = json.encoder.encode_basestring


def _written(value) -> str:
    """The JSON of a decoded value, without blanks."""
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, str):
        return _quoted(value)
    if isinstance(value, list):
        return "[" + ",".join(map(_written, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{_quoted(k)}:{_written(v)}" for k, v in value.items()) + "}"
    return {None: "null", True: "true", False: "false"}[value]


def _decoded_field(field: str, value) -> str:
    """The JSON of a field; an object in place of a text is its text."""
    if isinstance(value, dict) or (isinstance(value, list) and field != "children"):
        return _quoted(_written(value))
    return _written(value)


def _held(value, name: str, kind: type):
    """Field ``name`` of an object if it is of this kind, else an empty one."""
    found = value.get(name) if isinstance(value, dict) else None
    return found if isinstance(found, kind) else kind()


def _quoted_listing(text: str):
    """Replies that came as a text: the JSON in it, if any."""
    try:
        return _DECODER.decode(text) if text else None
    except (ValueError, RecursionError):
        return None


def _parsed_listing(token: str):
    listings = _parsed(_name(token)) if token[:1] in ("'", '"') and len(token) > 2 else None
    return listings[0] if listings else None


def _flat(text: str | None) -> tuple[str | None, list[str]] | None:
    """The root and all nodes of a document, each as JSON of its own; null if it is no JSON.

    Documents nested deeper than the standard decoder goes, or that only the parser of Spark takes
    for JSON, are read token by token.
    """
    if text is None:
        return None
    try:
        value = _DECODER.raw_decode(text.lstrip(" \t\r\n"))[0]
        if not isinstance(value, (list, dict)):
            return None
        listings, written, quoted = value if isinstance(value, list) else [value], _decoded_field, _quoted_listing
    except (ValueError, RecursionError):
        listings, written, quoted = _parsed(text), lambda field, raw: raw, _parsed_listing
        if listings is None:
            return None

    def children(listing) -> list:
        return _held(_held(listing, "data", dict), "children", list)

    def node(value) -> str:
        post = _held(value, "data", dict)
        fields = [f'"{k}":{written(k, post[k])}' for k in _FIELDS if k in post]
        return '{"data":{' + ",".join(fields) + "}}"

    waiting = [n for listing in listings[:2] for n in children(listing)]
    root = next((node(n) for n in children(listings[0])[:1]), None) if listings else None
    nodes = []
    while waiting:
        value = waiting.pop()
        nodes.append(node(value))
        replies = _held(value, "data", dict).get("replies")
        waiting.extend(children(quoted(replies) if isinstance(replies, str) else replies))
    return root, nodes


def _flatten(texts: pa.Array) -> pa.Array:
    kind = pa.struct([("root", pa.string()), ("nodes", pa.list_(pa.string()))])
    found = map(_flat, texts.to_pylist())
    return pa.array([f and {"root": f[0], "nodes": f[1]} for f in found], kind)


def _documents(spark: SparkSession, path: str, whole_file: bool) -> DataFrame:
    """Every document with its text, and its root and nodes if it is JSON."""
    lines = spark.read.text(path, wholetext=whole_file).where(F.trim("value") != "")
    # not deterministic for the planner, so that it is not called again by every filter
    flat = F.arrow_udf(_flatten, _FLAT).asNondeterministic()
    return lines.select(
        F.col("_metadata.file_path").alias("filename"),
        "value",
        flat("value").alias("flat"),
    )


def _is_thread() -> Column:
    return F.coalesce(F.size("flat.nodes") > 0, F.lit(False))


def read_threads(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Thread documents as ``(filename, root, nodes)``, one per line or per file.

    ``nodes`` has the JSON of every node at any depth, without the replies to it: a document is read
    once, in the memory of one task, and nothing is written. Documents that are no thread are left
    out here and listed by :func:`unreadable_threads`.
    """
    return _documents(spark, path, whole_file).where(_is_thread()).select("filename", "flat.root", "flat.nodes")


def unreadable_threads(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """``filename, length, reason`` of the documents that :func:`read_threads` leaves out."""
    reason = F.when(F.col("flat").isNull(), "no JSON array of listings").otherwise("no posts")
    return _documents(spark, path, whole_file).where(~_is_thread()).select(
        "filename", F.length("value").alias("length"), reason.alias("reason")
    )


def thread_nodes(threads: DataFrame) -> DataFrame:
    """One row per node of every thread, at any depth of nesting."""
    root = F.from_json("root", _NODE)["data"]["id"].alias("root_id")
    nodes = threads.select("filename", root, F.explode("nodes").alias("_n"))
    nodes = nodes.select("filename", "root_id", F.from_json("_n", _NODE)["data"].alias("_p"))
    return nodes.select("filename", "root_id", *[F.col("_p")[f].alias(f) for f in _FIELDS])


def is_collapsed(author: str = "author") -> Column:
    """A collapsed node carries hidden child ids instead of a post."""
    return F.col(author).isNull() & F.col("children").isNotNull()


def thread_stubs(nodes: DataFrame) -> DataFrame:
    """One row per hidden child of a collapsed node: its id and its parent's id."""
    return nodes.where(is_collapsed()).select(
        F.explode("children").alias("pid"),
        F.col("root_id").alias("conversation_id"),
        tx.strip_id_prefix(F.col("parent_id")).alias("parent_id"),
        F.lit(True).alias("is_stub"),
    )


def thread_posts(nodes: DataFrame) -> DataFrame:
    """The full posts of a thread, flat, text assembled and cleaned."""
    return nodes.where(~is_collapsed()).select(
        F.col("id").alias("pid"),
        F.coalesce("root_id", tx.key_after_last(F.col("filename"))).alias("conversation_id"),
        "author",
        tx.strip_id_prefix(F.col("parent_id")).alias("parent_id"),
        F.coalesce("permalink", F.lit("")).alias("permalink"),
        F.coalesce("over_18", F.lit(False)).alias("over18"),
        tx.clean_whitespace(
            tx.assemble_text(F.col("title"), F.col("selftext"), F.col("body"))
        ).alias("text"),
        tx.epoch_iso(F.col("created_utc")).alias("created_at"),
        F.lit(False).alias("is_stub"),
    )
