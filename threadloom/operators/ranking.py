"""Exact ranks without putting a whole group, or the whole table, into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.session import materialise

SLICE_DIGITS = 3


def random_key(identifier: Column, seed: int = 42) -> Column:
    """A reproducible random order: the md5 of seed and id, as hex."""
    return F.md5(F.concat(F.lit(f"{seed}:"), identifier.cast("string")))


def random_rank(
    df: DataFrame,
    identifier: str,
    groups: tuple[str, ...] = (),
    seed: int = 42,
    out: str = "rank",
    at_most: str | None = None,
) -> DataFrame:
    """The 1-based position of every row in the random order of its group.

    The first hex digits cut each group into 4,096 equal slices. Slices are
    counted, their running totals give each slice its offset, and rows are
    ranked inside their slice only. With ``at_most``, a column constant within
    its group, just the rows up to that rank are kept, and slices that lie
    beyond it are dropped before any sort.
    """
    keyed = df.withColumn("_key", random_key(F.col(identifier), seed))
    keyed = keyed.withColumn("_slice", F.substring("_key", 1, SLICE_DIGITS))
    scope = [F.col(g) for g in groups] or [F.lit(0)]
    before = W.partitionBy(*scope).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*groups, "_slice")
        .agg(F.count("*").alias("_n"))
        .select(*groups, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    placed = keyed.join(offsets, [*groups, "_slice"])
    if at_most is not None:
        placed = placed.where(F.col("_offset") < F.col(at_most))
    inside = W.partitionBy(*groups, "_slice").orderBy("_key", identifier)
    ranked = placed.withColumn(out, F.col("_offset") + F.row_number().over(inside))
    if at_most is not None:
        ranked = ranked.where(F.col(out) <= F.col(at_most))
    return ranked.drop("_key", "_slice", "_offset")


def row_positions(df: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """The 1-based position of every row in a total order of the table.

    Rows are range-partitioned and sorted where they land; a partition's
    offset is the size of all partitions before it, so one number per
    partition is all that is ever brought together. ``order`` should end in a
    unique column.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(
        df.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "positions",
    )
    part = F.shiftright("_at", 33)
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    index = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per range partition
        .withColumn(out, F.col("_offset") + index + 1)
        .drop("_at", "_part", "_offset")
    )


def chunk_split(df: DataFrame, order: list[str], chunks: int = 50, out: str = "chunk") -> DataFrame:
    """Contiguous chunks of near-equal size; the first ``n % chunks`` are one larger."""
    placed = row_positions(df, order, "_position")
    small, larger = divmod(placed.count(), chunks)
    head = larger * (small + 1)
    at = F.col("_position") - 1
    number = F.when(at < head, F.floor(at / (small + 1))).otherwise(
        larger + F.floor((at - head) / max(small, 1))
    )
    return placed.withColumn(out, (number + 1).cast("long")).drop("_position")
