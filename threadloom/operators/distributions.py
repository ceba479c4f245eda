"""Binned distributions: the numbers behind density plots and heat maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.session import materialise

# --- Fixed values: grid and bin counts ---
GRID_EDGES = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
HISTOGRAM_BINS = 30
LOG_POINTS = 50
MATRIX_POINTS = {"size": 20, "posts_per_user": 20, "breadth": 50, "depth": 20}
# --- end of fixed values ---

SCORE_DIGITS = 9


def _cell(value: Column) -> Column:
    """Index of the half-open grid cell holding ``value``; null outside the grid.

    Compared with the edges themselves: scaling by ten misplaces values such
    as 0.29. Means are rounded first, since the last digits of a sum depend on
    the order in which tasks add up.
    """
    value = F.round(value, SCORE_DIGITS)
    reached = sum(((value >= edge).cast("int") for edge in GRID_EDGES), F.lit(0))
    return F.when(value.isNotNull() & reached.between(1, len(GRID_EDGES) - 1), reached - 1)


def density_grid(stats: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Share of conversations per 0.1 x 0.1 cell of topical spread and mean toxicity.

    Every group gets all 100 cells; shares of a group add up to one.
    """
    side = len(GRID_EDGES) - 1
    filled = (
        stats.select(
            *groups,
            (_cell(F.col("new_topic_spread")) * side + _cell(F.col("tox_mean"))).alias("_cell"),
        )
        .where(F.col("_cell").isNotNull())
        .groupBy(*groups, "_cell")
        .agg(F.count("*").alias("n"))
    )
    # at most 100 counts per group
    grids = filled.groupBy(*groups).agg(
        F.map_from_entries(F.collect_list(F.struct("_cell", "n"))).alias("_counts"), F.sum("n").alias("_total")
    )
    cells = F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("_cell")
    n = F.coalesce(F.try_element_at("_counts", F.col("_cell")), F.lit(0))
    return grids.select(*groups, "_counts", "_total", cells).select(
        *groups,
        F.floor(F.col("_cell") / side).cast("int").alias("spread_cell"),
        (F.col("_cell") % side).alias("tox_cell"),
        n.alias("n"),
        F.try_divide(n, "_total").alias("density"),
    )


def histogram(df: DataFrame, value: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over the range of the data, last bin closed; share per bin.

    Only bins that hold a value are listed, each with its left edge.
    """
    values = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    low, high, total = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not total:
        low = high = 0.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    counts = values.groupBy(
        F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).alias("bin")
    ).agg(F.count("*").alias("n"))
    return counts.select(
        "bin",
        (F.lit(low) + F.col("bin") * width).alias("left_edge"),
        "n",
        (F.col("n") / total).alias("share"),
    )


def binned_density(
    df: DataFrame, value: str, points: Column | int = LOG_POINTS, groups: tuple[str, ...] = (), log: bool = True
) -> DataFrame:
    """Log- or equally spaced bins per group: midpoint and share of each bin that is not empty.

    ``points`` edges run from the least value (1 if that is not positive, for
    log bins) to the greatest plus one. A value is placed by formula and then
    moved by one bin where the rounded edge says so.
    """
    points = F.lit(points) if isinstance(points, int) else points
    values = df.select(*groups, F.col(value).cast("double").alias("v"), points.alias("points"))
    values = values.where(F.col("v").isNotNull())
    bounds = values.groupBy(*groups).agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.max("points").alias("points")
    )
    if log:
        start = F.when(F.col("low") > 0, F.log10("low")).otherwise(0.0)
        end = F.log10(F.col("high") + 1)
    else:
        start, end = F.col("low"), F.col("high") + 1
    bounds = bounds.select(
        *groups, "low", "points", start.alias("start"), ((end - start) / (F.col("points") - 1)).alias("step")
    )

    def edge(i: Column) -> Column:
        at = F.col("start") + i * F.col("step")
        if not log:
            return at
        return F.when((i == 0) & (F.col("low") > 0), F.col("low")).otherwise(F.pow(F.lit(10.0), at))

    if groups:  # written, so that the planner sees how small it is
        placed = values.drop("points").join(materialise(bounds, "bounds"), list(groups))
    else:
        placed = values.withColumns({name: F.lit(x) for name, x in bounds.first().asDict().items()})
    scale = F.when(F.col("v") > 0, F.log10("v")) if log else F.col("v")
    guess = F.floor((scale - F.col("start")) / F.col("step"))
    guess = F.greatest(F.lit(0), F.least(F.coalesce(guess, F.lit(0)), F.col("points") - 2))
    placed = placed.withColumn("_g", guess).withColumn(
        "bin",
        F.when(F.col("v") < edge(F.col("_g")), F.col("_g") - 1)
        .when(F.col("v") >= edge(F.col("_g") + 1), F.col("_g") + 1)
        .otherwise(F.col("_g")),
    )
    counts = (
        placed.where(F.col("bin").between(0, F.col("points") - 2))
        .groupBy(*groups, "bin")
        .agg(
            F.count("*").alias("n"),
            *[F.first(c).alias(c) for c in ("low", "start", "step")],
        )
    )
    middle = (edge(F.col("bin")) + edge(F.col("bin") + 1)) / 2
    # at most one row per group and bin
    of_group = F.sum("n").over(W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0)))
    return counts.select(
        *groups,
        F.col("bin").cast("long").alias("bin"),
        middle.alias("midpoint"),
        "n",
        (F.col("n") / of_group).alias("share"),
    )


def distribution_matrix(stats: DataFrame, topics: tuple[str, ...], metrics: dict[str, int] = MATRIX_POINTS) -> DataFrame:
    """Log-binned density of every metric, per platform, for all and for each topic.

    One grouped job: metrics are unpivoted, and a conversation counts once for
    "all" and once for its topic. The long table is written once, since the
    bounds and the bins both read it.
    """
    scopes = F.array_compact(
        F.array(F.lit("all"), F.when(F.col("classified_topic").isin(*topics), F.col("classified_topic")))
    )
    long = (
        stats.select(
            "platform", F.explode(scopes).alias("scope"), *[F.col(m).cast("double") for m in metrics]
        )
        .unpivot(["platform", "scope"], list(metrics), "metric", "v")
    )
    points = F.lit(None)
    for metric, count in metrics.items():
        points = F.when(F.col("metric") == metric, count).otherwise(points)
    return binned_density(materialise(long, "metrics"), "v", points, ("metric", "platform", "scope"))
