import math
import threading
import uuid

import harness
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from threadloom.operators import incremental as inc
from threadloom.operators import models
from threadloom.operators import posts as post_ops
from threadloom.plans import learning


def test_report_equals_hand_computation(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    df = spark.createDataFrame(rows, "t string, p string")
    got = {r.label: r for r in models.class_report(df, "t", "p").collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].support) == (0.75, 0.75, 4)
    assert got["b"].f1 == pytest.approx(0.8)
    assert (got["c"].precision, got["c"].recall, got["c"].f1, got["c"].support) == (0, 0, 0, 1)
    assert got["accuracy"].f1 == pytest.approx(5 / 7)
    assert got["macro avg"].recall == pytest.approx((0.75 + 1 + 0) / 3)
    assert got["weighted avg"].precision == pytest.approx((0.75 * 4 + 2 / 3 * 2) / 7)
    assert got["weighted avg"].support == 7


def test_only_missing_scores_reach_a_pandas_scorer(spark):
    @F.pandas_udf("double")
    def scorer(texts: pd.Series) -> pd.Series:
        if texts.str.startswith("done").any():
            raise ValueError("scored twice")
        return texts.str.len().where(texts != "").astype(float)

    rows = [("done 1", 0.5), ("abc", None), ("", None), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "text string, tox double")
    got = {r.text: r.tox for r in models.score_missing(df, scorer).collect()}
    assert got == {"done 1": 0.5, "abc": 3.0, "": None, "nan": 3.0}
    fresh = models.score_missing(df.drop("tox").where("text = 'abc'"), scorer)
    assert fresh.first().tox == 3.0


def test_lexicon_share(spark):
    df = spark.createDataFrame([("Bad  bad day",), ("",), (None,)], "text string")
    got = [r.s for r in df.select(models.lexicon_scorer(["bad"])(F.col("text")).alias("s")).collect()]
    assert got == [pytest.approx(2 / 3), None, None]


def test_threshold_is_strict_and_present_columns_stay(spark):
    df = spark.createDataFrame([(0.8, 5), (0.81, 6), (None, 7)], "s double, kept int")
    got = models.threshold_label(df, {"t": "s", "kept": "s"}).collect()
    assert [(r.t, r.kept) for r in got] == [(0, 5), (1, 6), (0, 7)]


def test_off_topic_recoding(spark):
    df = spark.createDataFrame(
        [("x", 1, 0, 0), ("Not sure", 1, 0, 0), ("discuss", 1, 0, 0), (None, 0, 1, 0), ("x", 0, 0, 0)],
        "final_topic string, russia int, midterms int, childcare int",
    )
    assert [r.final_topic for r in post_ops.recode_off_topic(df).collect()] == ["x"] + ["Off_topic"] * 4


def test_classifiers_tell_topics_apart_and_are_saved(spark, tmp_path):
    kinds = {"war": ["tank", "front"], "vote": ["ballot", "poll"], "none": ["cake", "tree"]}
    rows = [(i, kind, [kinds[kind][i % 2], "common"]) for i in range(90) for kind in [list(kinds)[i % 3]]]
    df = spark.createDataFrame(rows, "id long, kind string, tokens array<string>")
    tokens = df.select("id", "tokens")
    topics = {t: F.col("kind") == t for t in ("war", "vote")}
    fitted = models.fit_topic_classifiers(df.select("id", "kind"), tokens, "id", topics, features=1 << 10)
    got = fitted.classify(tokens, "id").join(df, "id").collect()
    report = {(r.topic, r.label): r for r in fitted.held_out_report().collect()}
    assert all(report[topic, "accuracy"].f1 > 0.9 for topic in topics)
    loose = fitted.classify(tokens, "id", models.MULTILABEL_THRESHOLD).join(df, "id").collect()
    assert sum(sum(r[t] for t in topics) for r in loose) >= sum(sum(r[t] for t in topics) for r in got)
    assert len(got) == 90
    assert all((r.war, r.vote) == (int(r.kind == "war"), int(r.kind == "vote")) for r in got)
    assert all((r.score_war > 0.8) == bool(r.war) for r in got)

    nothing = spark.createDataFrame([(1, None), (2, [])], tokens.schema)
    assert len({r.score_war for r in fitted.classify(nothing, "id").collect()}) == 1

    path = str(tmp_path / "saved")
    fitted.save(path)
    loaded = models.Trained.load(spark, path)
    order = lambda rows: sorted(map(tuple, rows.collect()), key=str)
    assert order(loaded.classify(tokens, "id")) == order(fitted.classify(tokens, "id"))
    assert order(loaded.held_out_report()) == order(fitted.held_out_report())
    fitted.save(path)  # what is there stays
    assert list(models.Trained.load(spark, path).models) == ["war", "vote"]
    plan = loaded.classify(spark.createDataFrame(rows, df.schema), "id")._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_fitting_stops_when_the_checked_loss_rises(spark, monkeypatch):
    rows = [(float(i % 2 == 0), int(i % 2 == 0)) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, label int")
    vectors = VectorAssembler(inputCols=["x"], outputCol="weights").transform(df)
    wrong = vectors.withColumn("label", 1 - F.col("label"))
    assert models.fit_until_worse(vectors, vectors).getRegParam() == models.REGULARISATION[-1]
    fits = []
    monkeypatch.setattr(models, "log_loss", lambda rows: fits.append(1) or float(len(fits)))
    assert models.fit_until_worse(vectors, wrong).getRegParam() == models.REGULARISATION[0]
    assert len(fits) == 1 + models.PATIENCE
    monkeypatch.undo()
    assert models.log_loss(vectors.withColumn("score", F.lit(0.5)).limit(0)) == float("inf")


def test_texts_are_cut_into_words_once_for_fit_and_scores(spark, tmp_path, monkeypatch):
    sf = str(tmp_path / "sf")  # own paths, so that nothing is there yet
    for name in ("documents", "labels"):
        spark.read.parquet(f"{harness.DATA}/sf0.001/{name}.parquet").write.parquet(f"{sf}/{name}.parquet")
    cut, tokens = [], learning.tokens
    monkeypatch.setattr(learning, "tokens", lambda *given: cut.append(1) or tokens(*given))
    order = lambda rows: sorted(map(tuple, rows.collect()))
    exclusive, loose = learning.classify_topic(spark, sf), learning.classify_multilabel(spark, sf)
    assert learning.classify_report(spark, sf).count() > 0
    assert len(cut) == 1
    for scored, limit in ((exclusive, models.SCORE_THRESHOLD), (loose, models.MULTILABEL_THRESHOLD)):
        plan = scored._jdf.queryExecution().toString()
        assert "regexp" not in plan and "Exchange" not in plan
        direct = learning.trained(spark, sf).classify(tokens(spark, sf), "doc_id", limit)
        assert scored.columns == direct.columns and order(scored) == order(direct)


def test_topics_are_fitted_side_by_side(spark, monkeypatch):
    rows = [(str(i), ["war" if i % 2 else "vote"], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, tokens array<string>, kind int")
    topics = {"war": F.col("kind") == 1, "vote": F.col("kind") == 0}
    both, fit = threading.Barrier(2, timeout=120), models.fit_until_worse
    monkeypatch.setattr(models, "fit_until_worse", lambda *parts: both.wait() + 1 and fit(*parts))
    fitted = models.fit_topic_classifiers(df.select("id", "kind"), df, "id", topics, features=1 << 10)
    assert list(fitted.models) == ["war", "vote"]
    assert {r.id: (r.war, r.vote) for r in fitted.classify(df, "id", 0.5).collect()}["1"] == (1, 0)


def test_words_of_topics_are_exact(spark):
    texts = ["apple banana fruit", "banana fruit apple apple", "engine wheel motor", "motor wheel engine"] * 5
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate([*texts, "", None])], "pid string, text string")
    counts = models.word_counts(df, ())
    names = ["apple", "banana", "engine", "fruit", "motor", "wheel"]
    ids = sorted((r.word_id, r.word, r.n_posts) for r in models.dictionary(counts).collect())
    assert ids == [(i, w, 10) for i, w in enumerate(names)]
    model = models.fit_topics(counts, k=2)
    loads = {r.pid: r.topicDistribution for r in model.transform(counts).select("pid", "topicDistribution").collect()}
    expected = []
    for topic in (0, 1):
        given = dict.fromkeys(names, 0.0)
        for pid, text in enumerate(texts):
            for word in text.split():
                given[word] += loads[str(pid)][topic]
        expected += [(topic, w, names.index(w), 10, v / sum(given.values())) for w, v in given.items()]
    rows = models.topic_words(model, counts, top=100).collect()
    got = sorted((r.topic, r.word, r.word_id, r.n_posts, r.weight) for r in rows)
    assert [g[:4] for g in got] == [e[:4] for e in sorted(expected)]
    assert [g[4] for g in got] == pytest.approx([e[4] for e in sorted(expected)])
    order = [(r.topic, -r.weight, r.word) for r in sorted(rows, key=lambda r: (r.topic, r.rank))]
    assert order == sorted(order)
    first = models.topic_words(model, counts, top=2).collect()
    assert sorted((r.topic, r.rank) for r in first) == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_topics_say_more_than_equally_likely_words(spark):
    counts = learning.word_counts(spark, f"{harness.DATA}/sf0.001")
    assert models.fit_topics(counts).logPerplexity(counts) < math.log(models.WORD_CELLS)


def test_a_failing_scorer_leaves_marked_rows(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def load():
        (log / f"load-{uuid.uuid4().hex}").touch()
        tries = []

        def score(texts):
            tries.append(1)
            if texts.str.startswith("done").any():
                raise AssertionError("scored twice")
            if len(tries) == 1 or (texts == "bad").any():
                raise OSError("no answer")
            return texts.str.len().where(texts != "odd").astype(float)

        return score

    rows = [("done", 0.5), ("abc", None), (None, None), ("bad", None), ("odd", None), ("", float("nan"))]
    df = spark.createDataFrame(rows, "text string, tox double").coalesce(1)
    got = {r.text: (r.tox, r.tox_failed) for r in models.score_batches(df, load).collect()}
    assert got == {
        "done": (0.5, False), "abc": (3.0, False), None: (None, False),
        "bad": (None, True), "odd": (None, True), "": (0.0, False),
    }
    assert len(list(log.iterdir())) == 1
    fresh = models.score_batches(df.drop("tox").where("text = 'abc'"), load, retries=1).first()
    assert (fresh.tox, fresh.tox_failed) == (3.0, False)
    assert models.score_batches(df.limit(0), load).count() == 0


def test_topic_model_is_repeatable(spark):
    texts = ["apple banana fruit", "banana fruit apple", "engine wheel motor", "motor wheel engine"] * 5
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "pid string, text string")
    counts = models.word_counts(df, ())
    first, second = (
        sorted(models.topic_loadings(models.fit_topics(counts, k=3), counts).collect()) for _ in range(2)
    )
    assert first == second and len(first) == 20
    assert all(0.9 < sum(r[1:]) <= 1.0001 for r in first)


def test_new_rows_only_are_processed(spark, tmp_path):
    path = str(tmp_path / "out")
    seen = []

    def process(rows):
        seen.append(rows.count())
        return rows

    ids = lambda *values: spark.createDataFrame([(v,) for v in values], "id string")
    inc.process_new_only(ids("1", "2"), path, "id", process)
    out = inc.process_new_only(ids("2", "3", "4"), path, "id", process)
    assert seen == [2, 2] and sorted(r.id for r in out.collect()) == ["1", "2", "3", "4"]


def test_a_killed_run_leaves_no_half_batch(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    ids = lambda *values: spark.createDataFrame([(v,) for v in values], "id string")
    inc.process_new_only(ids("1"), path, "id", lambda rows: rows)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch, pytest.raises(KeyboardInterrupt):
        patch.setattr(inc, "publish", killed)
        inc.process_new_only(ids("1", "2", "3"), path, "id", lambda rows: rows)
    assert [r.id for r in inc.read_batches(spark, path).collect()] == ["1"]
    out = inc.process_new_only(ids("1", "2", "3"), path, "id", lambda rows: rows)
    assert sorted(r.id for r in out.collect()) == ["1", "2", "3"] and len(inc.batches(spark, path)) == 2


def test_two_runs_at_once_add_every_key_once(spark, tmp_path):
    path = str(tmp_path / "out")
    ids = lambda *values: spark.createDataFrame([(v,) for v in values], "id string")

    def named(run):
        return lambda rows: rows.withColumn("run", F.lit(run))

    def slow(rows):
        inc.process_new_only(ids("1", "2"), path, "id", named("second"))
        inc.process_new_only(ids("2", "3"), path, "id", named("third"))
        return named("first")(rows)

    out = inc.process_new_only(ids("2", "3", "4"), path, "id", slow)
    assert sorted(map(tuple, out.collect())) == [("1", "second"), ("2", "second"), ("3", "third"), ("4", "first")]
    assert len(inc.batches(spark, path)) == 3


def test_search_resumes_at_the_last_time_or_the_start(spark):
    keywords = spark.createDataFrame([("a",), ("b",)], "keyword string")
    posts = spark.createDataFrame([("a", 50000), ("a", 40000)], "keyword string, epoch long")
    slots = inc.resumed_slots(keywords, posts, F.lit(0).cast("long"), F.lit(86400).cast("long")).collect()
    assert sorted(r.after for r in slots if r.keyword == "a") == [50000, 71600]
    assert sorted(r.after for r in slots if r.keyword == "b") == [0, 21600, 43200, 64800, 86400]
