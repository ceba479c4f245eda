import json

from pyspark.sql import functions as F

from threadloom.functions.keywords import Dictionary
from threadloom.operators import posts as post_ops
from threadloom.sources import pages
from threadloom.streaming import streams


def page(*ids):
    rows = [{"id": str(i), "conversation_id": "c", "text": "vote now" if i % 2 else "no", "author_id": "u"} for i in ids]
    return json.dumps({"data": rows, "includes": {"tweets": rows[:1]}})


def test_tagging_stream_equals_batch_and_resumes(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1_0.json").write_text(page(1, 2, 3))
    words = Dictionary.of(spark, {"midterms": ["vote"]})

    def run():
        tagged = streams.tag_pages(streams.arriving_pages(spark, source, maxFilesPerTrigger="1"), words)
        return streams.run_append(tagged, out, state)

    assert sorted(r.tweet_id for r in run().collect()) == ["1", "3"]
    (tmp_path / "in" / "2_0.json").write_text(page(4, 5))
    batch = post_ops.seed_summary(pages.page_posts(pages.read_pages(spark, source)), words)
    assert sorted(map(tuple, run().collect())) == sorted(map(tuple, batch.collect()))


def test_duplicates_across_files_arrive_once(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([(str(i), f"2024-01-0{1 + i % 3} 00:00:00") for i in range(30)], "pid string, ts string")
    rows = rows.withColumn("ts", F.to_timestamp("ts"))
    for _ in range(3):
        rows.coalesce(1).write.mode("append").parquet(source)
    arrivals = streams.arriving(spark, source, rows.schema, "parquet", maxFilesPerTrigger="1")
    once = streams.dedup_within(arrivals, "pid", "ts", "10 days")
    got = streams.run_append(once, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.pid for r in got.collect()) == sorted(str(i) for i in range(30))


def test_volume_equals_batch_over_triggers_and_a_restart(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.range(500).select(
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 997).alias("ts"), (F.col("id") % 3).cast("string").alias("keyword")
    )

    def run():
        arrivals = streams.arriving(spark, source, rows.schema, "parquet", maxFilesPerTrigger="1")
        return sorted(map(tuple, streams.run_volume(arrivals, str(tmp_path / "out"), str(tmp_path / "state")).collect()))

    rows.where("id % 2 = 1").repartition(3).write.parquet(source)
    assert run() == sorted(map(tuple, streams.volume(rows.where("id % 2 = 1")).collect()))
    rows.where("id % 2 = 0").repartition(2).write.mode("append").parquet(source)  # late posts too
    batch = sorted(map(tuple, streams.volume(rows).collect()))
    assert run() == batch
    assert run() == batch


def test_copies_after_any_time_are_dropped_without_state(spark, tmp_path, monkeypatch):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(*rows):
        spark.createDataFrame(rows, "pid string, at int").coalesce(1).write.mode("append").parquet(source)

    def run():
        arrivals = streams.arriving(spark, source, "pid string, at int", "parquet", maxFilesPerTrigger="1")
        rows = streams.run_dedup_ever(arrivals, out, state, "pid").collect()
        return sorted(((r.pid, r.at) for r in rows), key=str)

    arrive(("a", 1), ("a", 1), ("b", 1), (None, 1), (None, 1))
    assert run() == [("a", 1), ("b", 1), (None, 1), (None, 1)]
    arrive(("a", 31), ("c", 31), (None, 31))
    arrive(("c", 400), ("b", 400))
    expected = [("a", 1), ("b", 1), ("c", 31), (None, 1), (None, 1), (None, 31)]

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(streams, "unseen", killed)
        try:
            run()
        except Exception as error:
            assert "killed" in str(error)
    assert run() == expected
    assert run() == expected
    assert not (tmp_path / "state" / "state").exists()  # no state store


def test_known_keys_are_found_by_a_scan_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "stored")
    spark.range(1000).selectExpr("id pid", "repeat('x', 100) text").write.parquet(path)
    batch = str(tmp_path / "batch")
    spark.range(990, 1010).selectExpr("id pid", "'new' text").write.parquet(batch)
    new = streams.unseen(spark.read.parquet(batch), spark.read.parquet(path), "pid")
    assert sorted(r.pid for r in new.collect()) == list(range(1000, 1010))
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    stored = [line for line in plan.splitlines() if "FileScan" in line and "stored" in line]
    assert stored and all("ReadSchema: struct<pid:bigint>" in line for line in stored)
