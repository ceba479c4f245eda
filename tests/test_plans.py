"""Tables are read once: scans and shuffles counted in the executed plans."""

from pyspark.sql import functions as F

from threadloom.operators import rollups, sampling
from threadloom.plans import fixtures as fx

SF_DIR = "/root/testdata/sf0.001"


def counted(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return final.count("FileScan"), final.count("Exchange hashpartitioning")


def test_topics_are_counted_in_one_scan(spark):
    posts = fx.posts(spark, SF_DIR)
    assert counted(rollups.topic_counts(posts))[0] == 1
    scans, shuffles = counted(rollups.topic_conversations(rollups.topic_pairs(posts)))
    assert (scans, shuffles <= 3) == (1, True)


def test_sampling_reads_its_input_once(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 3 == 0).alias("yes")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for df in (sampling.balance_classes(rows, "id", "yes"), sampling.split_sets(rows, "id")):
        df.collect()
        assert str(tmp_path) not in df._jdf.queryExecution().optimizedPlan().toString()
        assert set(df.inputFiles()).isdisjoint(rows.inputFiles())


def test_scores_are_counted_in_one_scan(spark):
    posts = fx.raw_posts(spark, SF_DIR)
    summary = rollups.tox_summary(posts)
    assert set(summary.inputFiles()).isdisjoint(posts.inputFiles())
