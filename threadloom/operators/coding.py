"""Hand-coding: pivot, clean, reconcile, and agreement between coders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_SURE = "Not sure"
FIELDS = ("on_topic", "topic", "english")


def pivot_codes(codes: DataFrame, coders: tuple[str, ...], keys: tuple[str, ...] = ("cid",)) -> DataFrame:
    """Long codes to one row per conversation with ``{coder}_{field}`` columns.

    A field no coder filled in gives a null column.
    """
    names = [f"{coder}_{field}" for coder in coders for field in FIELDS]
    return (
        codes.withColumn("_name", F.concat_ws("_", "coder", "field"))
        .groupBy(*keys)
        .pivot("_name", names)
        .agg(F.max("code"))
    )


def melt_codes(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Wide coder columns to rows ``(keys, coder, code)``."""
    return df.unpivot(keys, columns, "coder", "code")


def english_only(df: DataFrame, column: str) -> DataFrame:
    """Drop rows the first coder marked as not English; unmarked rows stay."""
    return df.where(F.col(column).isNull() | (F.col(column) != "No"))


def consensus(first: Column, second: Column) -> Column:
    """The shared code, null when coders differ or either is missing."""
    return F.when(first == second, first)


def apply_overrides(
    codes: DataFrame, overrides: DataFrame, columns: dict[str, str], key: str = "cid", keep_null: bool = True
) -> DataFrame:
    """Replace values by those of a settled or corrected row with the same key.

    ``columns`` maps a target column to the override's column. A null override
    replaces too, unless ``keep_null`` is off.
    """
    chosen = overrides.select(
        key, F.lit(True).alias("_hit"), *[F.col(src).alias(f"_{dst}") for dst, src in columns.items()]
    )
    joined = codes.join(chosen, key, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    for dst in columns:
        use = hit if keep_null else hit & F.col(f"_{dst}").isNotNull()
        joined = joined.withColumn(dst, F.when(use, F.col(f"_{dst}")).otherwise(F.col(dst)))
    return joined.select(*codes.columns)


def open_disagreements(df: DataFrame) -> DataFrame:
    """Rows still without an agreed answer, and what is open about them."""
    kind = F.when(F.col("final_on_topic").isNull(), "on_topic").when(
        (F.col("final_on_topic") == "Yes") & F.col("final_topic").isNull(), "topic"
    )
    return df.withColumn("open", kind).where(F.col("open").isNotNull())


def percent_agreement(df: DataFrame, first: Column, second: Column, by: Column) -> DataFrame:
    """Share of items with equal codes, per value of ``by`` and for all (``by`` null).

    ``agreement_sure`` leaves out items on which the coders differ and one is
    not sure. A missing code never agrees.
    """
    agree = F.coalesce(first == second, F.lit(False))
    unsure = F.coalesce(first == NOT_SURE, F.lit(False)) | F.coalesce(second == NOT_SURE, F.lit(False))
    marked = df.select(
        by.alias("scope"),
        agree.cast("long").alias("agree"),
        (agree | ~unsure).cast("long").alias("sure"),
    )
    counts = marked.rollup("scope").agg(
        F.sum("agree").alias("n_agree"), F.count("*").alias("n_items"), F.sum("sure").alias("n_sure")
    )
    return counts.withColumns(
        {
            "agreement": F.try_divide("n_agree", "n_items"),
            "agreement_sure": F.try_divide("n_agree", "n_sure"),
        }
    )


def with_and_without_unsure(codes: DataFrame, code: str = "code") -> DataFrame:
    """Every code for ``drop_not_sure`` false, and all but "Not sure" again for true."""
    sure = F.when(F.col(code) != NOT_SURE, True)
    variants = F.array_compact(F.array(F.lit(False), sure))
    return codes.withColumn("drop_not_sure", F.explode(variants))


def krippendorff_alpha(codes: DataFrame, scope: list[str], unit: str = "unit", code: str = "code") -> DataFrame:
    """Nominal alpha per value of the ``scope`` columns: ``1 - Do / De`` over units with at least two codes.

    ``codes`` has one row per coder and unit. Codes are counted per unit
    first, so a unit is a handful of distinct codes however often it was coded.
    """
    per_code = (
        codes.where(F.col(code).isNotNull())
        .groupBy(*scope, unit, code)
        .agg(F.count("*").alias("n"))
    )
    per_unit = (
        per_code.groupBy(*scope, unit)
        .agg(
            F.sum("n").alias("m"),
            F.sum(F.col("n") * F.col("n")).alias("squares"),
            F.collect_list(F.struct(F.col(code).alias("code"), "n")).alias("codes"),
        )
        .where(F.col("m") >= 2)
    )
    marginals = (
        per_unit.select(
            *scope,
            F.posexplode("codes").alias("at", "c"),
            "m",
            ((F.col("m") * F.col("m") - F.col("squares")) / (F.col("m") - 1)).alias("_do"),
        )
        .groupBy(*scope, F.col("c.code").alias("code"))
        .agg(
            F.sum("c.n").alias("n_c"),
            F.sum(F.when(F.col("at") == 0, F.col("_do")).otherwise(0.0)).alias("do_sum"),
        )
    )
    totals = marginals.groupBy(*scope).agg(
        F.sum("n_c").alias("n"),
        F.sum("do_sum").alias("do_sum"),
        F.sum(F.col("n_c") * F.col("n_c")).alias("c_squares"),
    )
    observed = F.col("do_sum") / F.col("n")
    expected = (F.col("n") * F.col("n") - F.col("c_squares")) / (F.col("n") * (F.col("n") - 1))
    return totals.select(
        *scope,
        F.col("n").alias("n_codes"),
        F.when(expected > 0, 1 - observed / expected).alias("alpha"),
    )


def agreement_types(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """Unordered pairs of codes with their count and share; incomplete pairs are left out."""
    pair = F.array_join(F.array_sort(F.array_distinct(F.array(first, second))), "_")
    counts = (
        df.where(first.isNotNull() & second.isNotNull())
        .groupBy(pair.alias("pair"))
        .agg(F.count("*").alias("n"))
    )
    total = counts.select(F.sum("n")).scalar()
    return counts.select("pair", "n", (F.col("n") / total).alias("share"))
