import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import ranking, sampling


def test_random_rank_equals_sorting_by_hash(spark):
    rows = [("big" if i % 3 else "small", str(i)) for i in range(9000)]
    df = spark.createDataFrame(rows, "g string, id string")
    got = {(r.g, r.id): r["rank"] for r in ranking.random_rank(df, "id", ("g",)).collect()}
    for group in ("big", "small"):
        ids = sorted((i for g, i in rows if g == group), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        assert [got[group, i] for i in ids] == list(range(1, len(ids) + 1))


def test_positions_are_a_gapless_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    got = ranking.row_positions(df, ["v"]).collect()
    assert all(r.position == r.v + 1 for r in got) and len(got) == 5000


@pytest.mark.parametrize("n", [0, 1, 49, 50, 1007])
def test_chunks_have_the_sizes_of_an_array_split(spark, n):
    df = spark.range(n).select(F.col("id").alias("v"))
    got = ranking.chunk_split(df, ["v"]).groupBy("chunk").agg(F.count("*").alias("n"), F.min("v").alias("low")).collect()
    expected = [len(part) for part in np.array_split(np.arange(n), 50) if len(part)]
    assert [r.n for r in sorted(got, key=lambda r: r.chunk)] == expected
    assert [r.low for r in sorted(got, key=lambda r: r.chunk)] == list(np.cumsum([0] + expected[:-1]))[: len(got)]


def test_split_sizes_are_exact_and_parts_disjoint(spark):
    df = spark.range(1003)
    parts = sampling.split_sets(df, "id", (0.75, 0.9), ("train", "validate", "test"))
    sizes = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    assert sizes == {"train": 752, "validate": 150, "test": 101}


def test_balanced_classes(spark):
    df = spark.range(1000).select("id", (F.col("id") < 100).alias("yes"))
    got = sampling.balance_classes(df, "id", "yes")
    assert {r["yes"]: r["count"] for r in got.groupBy("yes").count().collect()} == {True: 100, False: 100}
    few = sampling.balance_classes(df.withColumn("yes", ~F.col("yes")), "id", "yes")
    assert {r["yes"]: r["count"] for r in few.groupBy("yes").count().collect()} == {True: 900, False: 100}


def test_quota_counts_searched_ones_and_skips_met_quotas(spark):
    pairs = spark.createDataFrame(
        [("a", f"c{i}") for i in range(100)] + [("b", f"c{i}") for i in range(30)], "topic string, conversation_id string"
    )
    searched = spark.createDataFrame([("c1",), ("c2",)], "conversation_id string")
    got = sampling.quota_sample(pairs, searched).collect()
    assert {r.topic for r in got} == {"a"}  # b wants int(1.5) + 1 = 2 and has 2
    assert len(got) == 4 and not {r.conversation_id for r in got} & {"c1", "c2"}
