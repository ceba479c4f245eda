"""Post tables dealt by conversation: what is stored, and which plans move posts."""

import re

import harness
import pytest
from pyspark.sql import functions as F

from threadloom.operators import graph, rollups
from threadloom.plans import fixtures as fx
from threadloom.sources import dealt

SCHEMA = "conversation_id string, pid string, author string, parent_id string, tox double"


def moved(df):
    """The keys by which rows are exchanged when ``df`` is run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.findall(r"Exchange (\w+)", plan)


def hot(spark):
    """3,000 posts of one conversation, 1,000 of others, some without one, one row three times."""
    own = F.when(F.col("id") < 3000, "hot").when(F.col("id") % 50 > 0, F.concat(F.lit("c"), F.col("id") % 97))
    posts = spark.range(4000).select(
        own.alias("conversation_id"),
        F.col("id").cast("string").alias("pid"),
        F.concat(F.lit("u"), F.col("id") % 7).alias("author"),
        F.when(F.col("id") % 5 > 0, (F.col("id") - 1).cast("string")).alias("parent_id"),
        (F.col("id") % 8 / 8).alias("tox"),
    )
    first = posts.where("pid = '3001'")
    return posts.unionByName(first).unionByName(first)


def test_every_post_is_stored_once_and_large_conversations_apart(spark, tmp_path):
    posts = hot(spark)
    dealt.write_dealt(posts, str(tmp_path / "t"), buckets=8, large=100)
    stored = dealt.read_dealt(spark, str(tmp_path / "t"), posts.schema)
    assert sorted(map(repr, stored.posts().collect())) == sorted(map(repr, posts.collect()))
    assert {r[0] for r in stored.large.select("conversation_id").distinct().collect()} == {"hot"}
    assert (stored.buckets, stored.n_large) == (8, 1)
    rolled = stored.per_conversation(lambda own, _: rollups.post_rollup(own))
    assert sorted(map(repr, rolled.collect())) == sorted(map(repr, rollups.post_rollup(posts).collect()))


def test_posts_without_conversation_may_be_large(spark, tmp_path):
    dealt.write_dealt(hot(spark), str(tmp_path / "t"), buckets=4, large=19)
    stored = dealt.read_dealt(spark, str(tmp_path / "t"), hot(spark).schema)
    assert {r[0] for r in stored.large.select("conversation_id").distinct().collect()} == {"hot", None}


def test_rollups_and_joins_move_no_post(spark, tmp_path):
    posts = hot(spark)
    for name in ("a", "b"):
        dealt.write_dealt(posts, str(tmp_path / name), buckets=8, large=100)
    one, two = (dealt.read_dealt(spark, str(tmp_path / name), posts.schema).few for name in ("a", "b"))
    assert moved(rollups.post_rollup(one)) == []
    assert moved(rollups.user_stats(one)) == []
    assert moved(graph.network_summary(graph.reply_edges(one))) == []
    assert moved(one.hint("merge").join(rollups.post_rollup(two), "conversation_id")) == []
    assert moved(rollups.post_rollup(posts)) == ["hashpartitioning", "hashpartitioning"]


def test_flagship_reads_dealt_posts_without_moving_them(spark, tmp_path):
    posts = fx.posts(spark, "/root/testdata/sf0.001")
    loadings = fx.loadings(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "t")
    dealt.write_dealt(posts, path, buckets=8)
    stored = dealt.read_dealt(spark, path, posts.schema)
    got = stored.per_conversation(lambda own, n: rollups.convo_stats(own, loadings, "turn", n))
    expected = rollups.convo_stats(posts, loadings, "turn")
    assert moves_after_scan(got, "few") == 0 < moves_after_scan(expected, "posts")
    assert harness.rows_of(got.columns, got.collect()) == harness.rows_of(expected.columns, expected.collect())


def moves_after_scan(df, folder):
    """Shuffles of what is read from ``folder`` before any join; reduced sides may still be broadcast."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = [len(re.match(r"[\s:|]*", line).group()) for line in plan]
    found = 0
    for i, line in enumerate(plan):
        if not re.search(rf"FileScan parquet .*/{folder}[-\],/]", line):
            continue
        at = depth[i]
        for j in range(i - 1, -1, -1):
            if depth[j] < at:
                at = depth[j]
                if "Join" in plan[j] or "Union" in plan[j]:
                    break
                found += "Exchange hashpartitioning" in plan[j]
    return found


def test_empty_tables_and_unfinished_ones(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    dealt.write_dealt(empty, str(tmp_path / "t"))
    stored = dealt.read_dealt(spark, str(tmp_path / "t"), empty.schema)
    assert (stored.posts().count(), stored.buckets, stored.n_large) == (0, 1, 0)
    (tmp_path / "half" / "few").mkdir(parents=True)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        dealt.read_dealt(spark, str(tmp_path / "half"), empty.schema)


def test_tables_leave_no_name_behind(spark, tmp_path):
    dealt.write_dealt(hot(spark), str(tmp_path / "t'q"), buckets=2)
    assert dealt.read_dealt(spark, str(tmp_path / "t'q"), hot(spark).schema).posts().count() == 4002
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("threadloom_")]
