"""Flat files: tab-separated tables, lists, dictionaries and comment dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom import schemas
from threadloom.functions import text as tx

MISSING_TOKENS = ("", "nan")


def read_tsv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    quote: str | None = None,
    missing: tuple[str, ...] = MISSING_TOKENS,
) -> DataFrame:
    """A tab-separated table with a header, types pinned by ``schema``.

    Quoting is off unless a quote character is given. Cells that spell a
    missing value become null before any cast.
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = (
        spark.read.schema(as_text)
        .option("sep", "\t")
        .option("header", "true")
        .option("quote", quote or "")
        .option("escape", "")
        .csv(path)
    )
    return raw.select(
        *[
            F.when(~F.col(f.name).isin(*missing), F.col(f.name))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema
        ]
    )


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed lines; for lines with tabs, the first column."""
    first = F.trim(F.substring_index("value", "\t", 1))
    return spark.read.text(path).select(first.alias("id")).where(F.col("id") != "").distinct()


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """JSON ``topic -> [keyword]`` objects as rows ``(topic, keyword)``."""
    parsed = F.from_json("value", "map<string,array<string>>")
    return (
        spark.read.text(path)
        .select(F.explode(parsed).alias("topic", "_words"))
        .select("topic", F.explode("_words").alias("keyword"))
    )


def read_comment_dump(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines comments; the keyword is the stem of the file, or its folder."""
    name = tx.key_before(F.col("_metadata.file_path"), ".")
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"keyword=([^/]+)/", 1)
    return spark.read.schema(schemas.COMMENT_DUMP).json(path).select(
        "*", F.coalesce(F.nullif(folder, F.lit("")), name).alias("keyword")
    )
