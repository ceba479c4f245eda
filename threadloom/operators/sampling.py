"""Reproducible sampling and splitting by hashed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.ranking import random_rank
from threadloom.operators.rollups import CONVERSATION
from threadloom.session import materialise, materialise_counting

# --- Fixed values: quota, seed and split ---
QUOTA_SHARE = 0.05
QUOTA_EXTRA = 1
SEED = 42
TRAIN_SHARE = 0.8
# --- end of fixed values ---


def quota_sample(pairs: DataFrame, searched: DataFrame) -> DataFrame:
    """Conversations to search next, per topic, until its quota of searched ones is met.

    The quota is 5% of a topic's conversations plus one, less those searched
    already; the rest is drawn at random from those not searched yet. A
    conversation may be drawn for several topics.
    """
    seen = searched.select(CONVERSATION).distinct().withColumn("_seen", F.lit(1))
    # read by the counts, the ranks and the sample itself
    flagged = materialise(pairs.join(seen, CONVERSATION, "left"), "pairs")
    needs = flagged.groupBy("topic").agg(
        (
            F.floor(F.count("*") * QUOTA_SHARE) + QUOTA_EXTRA - F.count("_seen")
        ).alias("_need")
    )
    unsearched = flagged.where(F.col("_seen").isNull()).select("topic", CONVERSATION)
    wanted = unsearched.join(needs.where(F.col("_need") > 0), "topic")
    return random_rank(wanted, CONVERSATION, ("topic",), SEED, "rank", at_most="_need").select(
        "topic", CONVERSATION
    )


def quota_union(sample: DataFrame) -> DataFrame:
    """The conversations of a quota sample, each once."""
    return sample.select(CONVERSATION).distinct()


def balance_classes(rows: DataFrame, identifier: str, positive: str, seed: int = SEED) -> DataFrame:
    """All rows where ``positive`` holds and as many random others.

    Fewer others than positives are all kept. The rows are written once.
    """
    rows, seen = materialise_counting(rows, "classes", positives=F.count_if(positive))
    yes = rows.where(F.col(positive))
    no = rows.where(~F.col(positive)).withColumn("_need", F.lit(seen["positives"]))
    return yes.unionByName(
        random_rank(no, identifier, (), seed, "_rank", at_most="_need").drop("_rank", "_need")
    )


def split_sets(
    rows: DataFrame,
    identifier: str,
    shares: tuple[float, ...] = (TRAIN_SHARE,),
    names: tuple[str, ...] = ("train", "test"),
    seed: int = SEED,
) -> DataFrame:
    """Shuffle and cut at the given cumulative shares; sizes are exact. The rows are written once."""
    rows, seen = materialise_counting(rows, "rows", total=F.count("*"))
    ranked = random_rank(rows, identifier, (), seed, "_rank")
    part = F.lit(names[-1])
    for cut, name in reversed(list(zip(shares, names))):
        part = F.when(F.col("_rank") <= F.floor(F.lit(seen["total"]) * cut), name).otherwise(part)
    return ranked.withColumn("part", part).drop("_rank")
