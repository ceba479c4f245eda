"""The pipeline over ``documents``: stages that each apply one operator to what the last one kept.

Every stage returns the columns of ``documents``; the last one returns pieces of packed sequences.
Each result is written as Parquet and read again. Ids are not assumed to be unique: rows of one id
are judged by their own texts, which a stage tells apart by their hashes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontam, langid, neardup, packing, secrets
from threadloom.session import materialise

#: A text needs this mean probability of its language; of a mixed text no language may have it.
MIN_LANGUAGE_SCORE = 0.35
#: Near-duplicates share this percentage of their sets of five-word shingles.
SHINGLE, PERCENT = 5, 80
TOKENIZER = "word_bpe_49k.json"


def _held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def _with(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text are in ``judged`` (``doc_id, text_key``), each once.

    The id may be null. The rows are held as one struct, so that their columns may have any names.
    """
    keys = ["id", "none", "key"]
    wanted = judged.select(*_keys(F.col("doc_id"), F.col("text_key"))).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_keys(F.col("doc_id"), F.xxhash64("text")))
    kept = rows.join(wanted, keys, "left_semi").dropDuplicates(keys)
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _keys(doc: Column, text: Column) -> list[Column]:
    empty = F.lit(0).cast("long")
    return [F.coalesce(doc, empty).alias("id"), doc.isNull().alias("none"), F.coalesce(text, empty).alias("key")]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, which becomes their ``lang`` where none is given.

    Documents without letters, and those in which no language stands out, go. If no document that may
    be learned from has a language, none can be told apart, and those with letters stay as they are.
    """
    model = langid.train(docs, ~F.coalesce(_held_out(), F.lit(False)))
    if not model.labels:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = langid.annotate(docs, model)
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    lang = F.coalesce("row.lang", "lang_pred").alias("lang")
    return found.filter(known).select(
        *[lang if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns]
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the least id, if any has an id."""
    found = neardup.near_duplicates(docs, SHINGLE, PERCENT)
    return _with(docs, neardup.one_of_each(found))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = decontam.contamination(docs, items)
    return _with(docs, found.filter(~F.col("contaminated")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: The language model and the tokenizer have no SQL; the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage in turn; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
