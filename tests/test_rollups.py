import random
import statistics

import pytest
from pyspark.sql import functions as F

from threadloom.operators import rollups


def test_gini_of_known_arrays(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0],), ([0.0, 0.0],), ([1.0, 1.0],)], "x array<double>")
    got = [r.g for r in df.select(rollups.gini(F.col("x")).alias("g")).collect()]
    assert got[0] == pytest.approx(2 / 9) and got[1] is None and got[2] == pytest.approx(0)


def test_median_of_hot_small_and_out_of_range_keys(spark):
    rng = random.Random(3)
    groups = {
        "hot": [rng.random() for _ in range(5001)],
        "same": [0.25] * 400,
        "two": [0.1, 0.2],
        "wild": [-3.0, 7.0, 9.0, 0.5],
        "cell": [0.50001, 0.50002, 0.50003, 0.50004],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("none", None), ("two", None)]
    df = spark.createDataFrame(rows, "k string, tox double")
    got = {r.k: r.tox_median for r in rollups.median_by_key(df, "k", "tox").collect()}
    assert got == {k: pytest.approx(statistics.median(v)) for k, v in groups.items()}


def test_mode_prefers_the_topic_seen_first_and_lets_missing_vote(spark):
    rows = [
        ("tie", 0, "b | a"), ("tie", 1, "a"), ("tie", 2, "b"),
        ("none", 0, "a"), ("none", 1, ""), ("none", 2, ""),
    ]
    df = spark.createDataFrame(rows, "conversation_id string, turn long, topics string")
    got = {r.conversation_id: r for r in rollups.topic_profile(df, "turn", ("a", "b")).collect()}
    assert got["tie"].keyword_topic == "b" and got["none"].keyword_topic is None
    assert (got["tie"].a, got["tie"].b, got["none"].a, got["none"].b) == (1, 1, 1, 0)


def test_label_ties_go_to_the_first_topic(spark):
    df = spark.createDataFrame([("x", 1, 1), ("y", 0, 0), ("z", 0, 1)], "conversation_id string, p int, q int")
    got = {r[0]: r[1] for r in rollups.conversation_label(df, ("p", "q")).collect()}
    assert got == {"x": "p", "y": None, "z": "q"}


def test_searched_is_found_or_failed(spark):
    pairs = spark.createDataFrame([("t", str(i)) for i in range(10)], "topic string, conversation_id string")
    ids = lambda *values: spark.createDataFrame([(v,) for v in values], "conversation_id string")
    row = rollups.coverage_by_topic(pairs, ids("1", "2", "x"), ids("2", "3")).first()
    assert (row.total, row.with_data, row.without_data, row.searched, row.remaining) == (10, 2, 2, 3, 7)
