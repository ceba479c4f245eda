import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import distributions as dist


def frame(spark, values, extra=()):
    return spark.createDataFrame([(float(v), *extra) for v in values], "v double")


def numpy_bins(values, points, log):
    low, high = min(values), max(values) + 1
    if log:
        edges = np.logspace(np.log10(low) if low > 0 else 0, np.log10(high), points)
        if low > 0:
            edges[0] = low
    else:
        edges = np.linspace(low, high, points)
    n, _ = np.histogram(values, edges)
    mid = edges[1:] - np.diff(edges) / 2
    return [(i, pytest.approx(m), c, pytest.approx(c / n.sum())) for i, (m, c) in enumerate(zip(mid, n)) if c]


VALUES = {
    "skewed": [1, 1, 2, 3, 5, 8, 13, 400],
    "zero": [0, 1, 2, 50],
    "single": [7],
    "range": list(range(2, 500)),
    "negative": [-1, 0, 0.5, 3, 90],
}


@pytest.mark.parametrize("log", [True, False])
@pytest.mark.parametrize("points", [10, 50])
def test_bins_of_every_group_equal_numpy(spark, points, log):
    rows = [(name, float(v)) for name, values in VALUES.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double")
    got = dist.binned_density(df, "v", points, ("g",), log=log).collect()
    for name, values in VALUES.items():
        assert sorted((r.bin, r.midpoint, r.n, r.share) for r in got if r.g == name) == numpy_bins(values, points, log)


@pytest.mark.parametrize("name", ["skewed", "negative"])
def test_bins_without_groups_equal_numpy(spark, name):
    got = sorted(tuple(r) for r in dist.binned_density(frame(spark, VALUES[name]), "v", 20).collect())
    assert got == numpy_bins(VALUES[name], 20, True)


def test_histogram_equals_numpy(spark):
    values = [1, 2, 2, 3, 10, 10.5, 31]
    n, edges = np.histogram(values, bins=30)
    got = sorted(tuple(r) for r in dist.histogram(frame(spark, values), "v").collect())
    assert got == [(i, pytest.approx(edges[i]), c, pytest.approx(c / len(values))) for i, c in enumerate(n) if c]
    same = dist.histogram(frame(spark, [4, 4]), "v").collect()
    assert [tuple(r) for r in same] == [(15, pytest.approx(4.0), 2, 1.0)]


def test_grid_cells_are_half_open_and_whole(spark):
    scores = [(0.29, 0.0), (0.3, 0.99), (1.0, 0.5), (0.5, None), (0.0, 0.7)]
    df = spark.createDataFrame(scores, "new_topic_spread double, tox_mean double")
    grid = dist.density_grid(df).collect()
    assert len(grid) == 100 and sum(r.density for r in grid) == pytest.approx(1)
    assert {(r.spread_cell, r.tox_cell) for r in grid if r.n} == {(2, 0), (3, 9), (0, 7)}


def test_matrix_shares_sum_to_one(spark):
    rows = [("a" if i % 2 else "b", "x" if i % 3 else None, 1 + i % 17, 1.0 + i % 5, 1 + i % 7, 1 + i % 4) for i in range(300)]
    df = spark.createDataFrame(
        rows, "platform string, classified_topic string, size long, posts_per_user double, breadth long, depth long"
    )
    sums = dist.distribution_matrix(df, ("x",)).groupBy("metric", "platform", "scope").agg(F.sum("share").alias("s"))
    got = sums.collect()
    assert len(got) == 4 * 2 * 2 and all(r.s == pytest.approx(1) for r in got)
