"""Survey exports: one wide sheet per file, coders as rows, conversations as columns."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: columns of the export that are not codes ---
METADATA_COLUMNS = (
    "StartDate", "EndDate", "Status", "IPAddress", "Progress", "Duration (in seconds)",
    "Finished", "RecordedDate", "ResponseId", "RecipientLastName", "RecipientFirstName",
    "RecipientEmail", "ExternalReference", "LocationLatitude", "LocationLongitude",
    "DistributionChannel", "UserLanguage", "coder",
)
CODER_COLUMN = "RecipientLastName"
RESPONSE_COLUMN = "ResponseId"
RESPONSE_PATTERN = "R_"
FIELD_SUFFIXES = ("_topic", "_english")
# --- end of fixed values ---

_SUFFIX = "(" + "|".join(FIELD_SUFFIXES) + ")$"


def _unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells of each sheet as rows; every sheet has its own header."""
    for batch in batches:
        for sheet, content in zip(batch["sheet"], batch["content"]):
            rows = csv.DictReader(io.StringIO(content))
            coders = [r for r in rows if (r.get(RESPONSE_COLUMN) or "").startswith(RESPONSE_PATTERN)]
            cells = [
                (sheet, row[CODER_COLUMN], name, value or None)
                for row in coders
                for name, value in row.items()
                if name not in METADATA_COLUMNS
            ]
            yield pd.DataFrame(cells, columns=["sheet", "coder", "name", "code"])


def read_survey(spark: SparkSession, path: str) -> DataFrame:
    """Sheets as long rows ``(sheet, coder, cid, field, code)``.

    The two sub-header rows carry no response id and are dropped by that, not
    by their position. Columns with personal data never leave the reader.
    """
    sheets = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("sheet"), F.col("value").alias("content")
    )
    cells = sheets.mapInPandas(_unfold, "sheet string, coder string, name string, code string")
    suffix = F.regexp_extract("name", _SUFFIX, 0)
    return cells.select(
        "sheet",
        "coder",
        F.regexp_replace("name", _SUFFIX, "").alias("cid"),
        F.when(suffix == "", "on_topic").otherwise(F.ltrim(suffix, F.lit("_"))).alias("field"),
        "code",
    )
