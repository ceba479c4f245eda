"""Topic model, text classifier, scoring, thresholds and the classification report."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.operators import sampling
from threadloom.operators.ranking import row_positions
from threadloom.session import materialise, rename_new, scratch_path

# --- Fixed values: model settings and label names ---
TOPIC_COUNT = 10
SEED = 42
MIN_LOADING = 0.01
SCORE_THRESHOLD = 0.8
MULTILABEL_THRESHOLD = 0.5
CLASS_LABELS = {
    "none": "Off_topic",
    "children": "Childcare/parenting",
    "russia": "Russia/Ukraine war",
    "midterm": "US midterm elections",
}
CODED_TOPICS = ("Childcare/parenting", "Russia/Ukraine war", "US midterm elections")
# --- end of fixed values ---

#: Passes that the first ones count as. Every pass sees all posts, so that none is held back; with
#: the learner's own value, meant for small samples, ten passes hardly leave the random start.
LEARNING_OFFSET = 1.0

#: Words that a topic is described by.
TOP_WORDS = 20

#: Regularisation of the classifiers, strong to weak, and the fits without a gain that end the search.
REGULARISATION = (0.1, 0.01, 0.001)
PATIENCE = 1
#: Topics whose classifiers are fitted side by side.
FITS_AT_ONCE = 4
#: What is trained on, what decides when to stop, what is reported; cumulative shares of the first two.
PARTS = ("train", "check", "test")
PART_SHARES = (0.8, 0.9)

#: Cells that words are hashed to; no word is left out, and the topic matrix has a known size.
WORD_CELLS = 1 << 16
#: The same for the classifiers.
CLASSIFIER_CELLS = 1 << 15


def doc_bow(posts: DataFrame, key: str, tokens: Column) -> DataFrame:
    """Bag of words in long form: ``(key, token, n)``."""
    return (
        posts.select(key, F.explode(tokens).alias("token"))
        .groupBy(key, "token")
        .agg(F.count("*").alias("n"))
    )


def word_counts(posts: DataFrame, stop: Iterable[str], text: str = "text") -> DataFrame:
    """``pid``, all its ``words`` and their hashed ``counts``, written once; a null text has no words.

    The topic model reads its input in every iteration, of which only the counts.
    """
    words = posts.select("pid", tx.simple_tokens(F.coalesce(F.col(text), F.lit("")), stop).alias("words"))
    hashed = HashingTF(inputCol="words", outputCol="counts", numFeatures=WORD_CELLS).transform(words)
    return materialise(hashed.select("pid", "words", "counts"), "counts")


def fit_topics(counts: DataFrame, k: int = TOPIC_COUNT) -> LDAModel:
    """A topic model of the word counts of all posts, every one of which is used in each pass."""
    learner = LDA(
        featuresCol="counts",
        k=k,
        seed=SEED,
        optimizer="online",
        maxIter=10,
        subsamplingRate=1.0,
        learningOffset=LEARNING_OFFSET,
    )
    return learner.fit(counts.select("counts"))


def topic_loadings(model: LDAModel, counts: DataFrame) -> DataFrame:
    """``pid`` and its loadings ``t0..``; those under the minimum become zero."""
    loaded = model.transform(counts).select("pid", vector_to_array("topicDistribution").alias("_t"))
    return loaded.select(
        "pid",
        *[
            F.when(F.col("_t")[i] >= MIN_LOADING, F.col("_t")[i]).otherwise(0.0).alias(f"t{i}")
            for i in range(model.getK())
        ],
    )


def dictionary(counts: DataFrame) -> DataFrame:
    """Every word once: ``word``, ``n_posts`` with it, and its ``word_id`` from 0, most frequent first."""
    words = counts.select(F.explode(F.array_distinct("words")).alias("word"))
    known = words.groupBy("word").agg(F.count("*").alias("n_posts"))
    placed = row_positions(known.withColumn("_rare", -F.col("n_posts")), ["_rare", "word"], "_position")
    return placed.select("word", "n_posts", (F.col("_position") - 1).alias("word_id"))


def topic_words(model: LDAModel, counts: DataFrame, top: int = TOP_WORDS) -> DataFrame:
    """The ``top`` words of every topic: ``topic, rank, word, word_id, n_posts, weight``.

    A word's weight is its share of all words that the loadings give to the topic. Words are counted
    themselves and not by the cells that the model hashes them to, so that no two share a count. A post's
    words and its loadings stand in one row: nothing is joined but the dictionary, to the chosen words.
    """
    loaded = model.transform(counts).select("words", vector_to_array("topicDistribution").alias("_t"))
    topics = range(model.getK())
    given = (
        loaded.select(F.explode("words").alias("word"), "_t")
        .groupBy("word")
        .agg(*[F.sum(F.col("_t")[i]).alias(f"_{i}") for i in topics])
    )
    given = materialise(given, "given")  # read by the totals and by the ranks
    totals = given.agg(*[F.sum(f"_{i}").alias(f"_all{i}") for i in topics]).first()
    long = given.select(
        "word",
        F.posexplode(F.array(*[F.col(f"_{i}") / F.lit(totals[f"_all{i}"] or 1.0) for i in topics])).alias(
            "topic", "weight"
        ),
    )
    best = W.partitionBy("topic").orderBy(F.desc("weight"), "word")
    chosen = long.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return chosen.join(dictionary(counts), "word").select("topic", "rank", "word", "word_id", "n_posts", "weight")


def score_missing(posts: DataFrame, scorer: Callable[[Column], Column], score: str = "tox", text: str = "text") -> DataFrame:
    """Fill missing scores and keep the present ones; texts that cannot be scored stay null.

    Rows that have a score never reach the scorer, be it native or a pandas
    UDF, and nothing is joined.
    """
    if score not in posts.columns:
        return posts.withColumn(score, scorer(F.col(text)).cast("double"))
    missing = F.col(score).isNull() | F.isnan(score)
    scored = posts.where(missing).withColumn(score, scorer(F.col(text)).cast("double"))
    return posts.where(~missing).unionByName(scored)


def score_batches(
    posts: DataFrame,
    load: Callable[[], Callable[[pd.Series], pd.Series]],
    score: str = "tox",
    text: str = "text",
    retries: int = 2,
) -> DataFrame:
    """:func:`score_missing` by a model that every task loads once; adds ``<score>_failed``.

    ``load`` gives a function from a batch of texts to their scores. A batch on which it raises is tried
    ``retries`` times more, then text by text; a text on which it still raises, or that gets no finite
    score, has a null score and is marked as failed, so that a run goes on and its failures can be
    counted and scored again. A null text is not scored and is no failure. Present scores are not read.
    """

    def attempt(model: Callable, texts: pd.Series, tries: int) -> pd.Series | None:
        for _ in range(tries):
            try:
                got = pd.Series(list(model(texts)), index=texts.index, dtype="float64")
            except Exception:  # a scorer may raise anything
                continue
            return got
        return None

    @F.pandas_udf("score double, failed boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            present = texts.dropna()
            got = attempt(model, present, 1 + retries) if len(present) else present.astype("float64")
            if got is None:
                alone = [attempt(model, present.iloc[i : i + 1], 1) for i in range(len(present))]
                got = pd.Series([float("nan") if a is None else a.iloc[0] for a in alone], present.index)
            got = got.where(np.isfinite(got)).reindex(texts.index)
            failed = got.isna() & texts.notna()
            yield pd.DataFrame({"score": got.astype(object).where(got.notna(), None), "failed": failed})

    failed = f"{score}_failed"
    if score not in posts.columns:
        posts = posts.withColumn(score, F.lit(None).cast("double"))
    missing = F.col(score).isNull() | F.isnan(score)
    scored = posts.where(missing).withColumn("_scored", run(F.col(text)))
    scored = scored.withColumns({score: F.col("_scored.score"), failed: F.col("_scored.failed")}).drop("_scored")
    return posts.where(~missing).withColumn(failed, F.lit(False)).unionByName(scored)


def lexicon_scorer(lexicon: Iterable[str]) -> Callable[[Column], Column]:
    """Share of a text's words that are in a word list; null for a text without words."""
    words = [w.lower() for w in lexicon]

    def score(text: Column) -> Column:
        tokens = F.filter(F.split(tx.clean_whitespace(F.lower(text)), " "), lambda t: t != "")
        hits = F.size(F.filter(tokens, lambda t: t.isin(words)))
        return F.when(F.size(tokens) > 0, hits / F.size(tokens))

    return score


def label_onehot(labeled: DataFrame, topic: str = "final_topic") -> DataFrame:
    """One 0/1 column for each of the four classes."""
    return labeled.withColumns(
        {
            name: F.coalesce((F.col(topic) == value).cast("int"), F.lit(0))
            for name, value in CLASS_LABELS.items()
        }
    )


def label_binary(labeled: DataFrame, value: str, topic: str = "final_topic") -> DataFrame:
    """0/1 columns ``on_topic`` and ``not_topic`` for one topic."""
    hit = F.coalesce(F.col(topic) == value, F.lit(False))
    return labeled.withColumns({"on_topic": hit.cast("int"), "not_topic": (~hit).cast("int")})


def _with_tokens(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    return rows.withColumn(tokens, F.coalesce(F.col(tokens), F.array().cast("array<string>")))


def _hasher(features: int) -> HashingTF:
    return HashingTF(inputCol="tokens", outputCol="counts", numFeatures=features)


def hashed_words(rows: DataFrame, key: str, features: int = CLASSIFIER_CELLS) -> DataFrame:
    """``key`` and the hashed ``counts`` of its ``tokens``; null tokens are no words.

    Once written, they stand for the tokens in :func:`fit_topic_classifiers` and :meth:`Trained.classify`,
    so that texts are cut into words once. Both need the same number of cells.
    """
    return _hasher(features).transform(_with_tokens(rows)).select(key, "counts")


@dataclass(frozen=True)
class Trained:
    """Word weights, binary classifiers by topic, and their held-out examples."""

    words: PipelineModel
    models: dict[str, LogisticRegressionModel]
    held_out: DataFrame

    def classify(self, rows: DataFrame, key: str, limit: float = SCORE_THRESHOLD) -> DataFrame:
        """``key``, the score of every topic, and 1 where a score exceeds the limit; one pass, no shuffle.

        Rows of null ``tokens`` are scored as rows without words. Rows may have ``counts`` by
        :func:`hashed_words` instead of tokens.
        """
        if "counts" in rows.columns:
            scored = self.words.stages[-1].transform(rows).select(key, "weights")
        else:
            scored = self.words.transform(_with_tokens(rows)).select(key, "weights")
        for topic, model in self.models.items():
            scored = _scored(model, scored, f"score_{topic}")
        return threshold_label(
            scored.drop("weights"), {topic: f"score_{topic}" for topic in self.models}, limit
        )

    def held_out_report(self, limit: float = MULTILABEL_THRESHOLD) -> DataFrame:
        """:func:`class_report` of every topic's classifier on its held-out examples."""
        reports = []
        for topic, model in self.models.items():
            rows = _scored(model, self.held_out.where(F.col("topic") == topic), "score")
            guessed = rows.withColumn("predicted", (F.col("score") > limit).cast("int"))
            report = class_report(guessed, "label", "predicted")
            reports.append(report.select(F.lit(topic).alias("topic"), "*"))
        return reduce(DataFrame.unionByName, reports)

    def save(self, path: str) -> None:
        """Write everything below a folder, which becomes visible at once; one that is there stays."""
        spark = self.held_out.sparkSession
        staged = scratch_path(spark, "trained")
        self.words.save(f"{staged}/words")
        for number, model in enumerate(self.models.values()):
            model.save(f"{staged}/model-{number}")
        named = spark.createDataFrame(list(enumerate(self.models)), "number int, topic string")
        named.coalesce(1).write.parquet(f"{staged}/topics")
        self.held_out.write.parquet(f"{staged}/held-out")
        rename_new(spark, staged, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Trained:
        """What :meth:`save` has written, in this or another session."""
        topics = spark.read.parquet(f"{path}/topics").orderBy("number").collect()  # one row per classifier
        models = {t.topic: LogisticRegressionModel.load(f"{path}/model-{t.number}") for t in topics}
        return cls(PipelineModel.load(f"{path}/words"), models, spark.read.parquet(f"{path}/held-out"))


def _scored(model: LogisticRegressionModel, rows: DataFrame, score: str) -> DataFrame:
    scored = model.transform(rows).withColumn(score, vector_to_array("probability")[1])
    return scored.drop("rawPrediction", "probability", "prediction")


def log_loss(rows: DataFrame, score: str = "score", label: str = "label") -> float:
    """Mean negative log likelihood of the labels; infinite without rows."""
    right = F.when(F.col(label) == 1, F.col(score)).otherwise(1 - F.col(score))
    mean = rows.agg(F.avg(-F.log(F.greatest(right, F.lit(1e-15))))).first()[0]
    return float("inf") if mean is None else mean


def fit_until_worse(train: DataFrame, check: DataFrame, patience: int = PATIENCE) -> LogisticRegressionModel:
    """The classifier that does best on ``check``, from strong to weak regularisation.

    Stops after ``patience`` fits in a row without a gain. Without rows to check, the first one stays.
    """
    best, least, worse = None, float("inf"), 0
    for strength in REGULARISATION:
        model = LogisticRegression(featuresCol="weights", maxIter=20, regParam=strength).fit(train)
        loss = log_loss(_scored(model, check, "score"))
        if best is None or loss < least:
            best, least, worse = model, loss, 0
        else:
            worse += 1
            if worse == patience:
                break
    return best


def fit_topic_classifiers(
    labeled: DataFrame, rows: DataFrame, key: str, topics: dict[str, Column], features: int = CLASSIFIER_CELLS
) -> Trained:
    """One binary classifier per topic, trained on the larger part of a balanced sample.

    ``topics`` gives the condition under which a labelled row is on the topic, ``rows`` the ``key`` and
    ``tokens`` of every row, or their ``counts`` as written from :func:`hashed_words`. Half of what is not
    trained on decides when to stop, the other half is held out. The hashed words of all rows, which give
    the words' weights, are written once unless they are given; so are the weighted ones of labelled rows,
    and a topic's examples with their part. Topics are fitted side by side, since the many short jobs of
    one leave most cores idle.
    """
    given = "counts" in rows.columns
    counts = rows.select(key, "counts") if given else materialise(hashed_words(rows, key, features), "counts")
    weigher = IDF(inputCol="counts", outputCol="weights").fit(counts)
    words = PipelineModel([_hasher(features), weigher])
    known = counts.join(labeled.select(key).distinct(), key)
    told = materialise(weigher.transform(known).select(key, "weights"), "told")

    def fit(topic: str) -> tuple[LogisticRegressionModel, DataFrame]:
        balanced = sampling.balance_classes(labeled.select(key, topics[topic].alias("yes")), key, "yes")
        parts = sampling.split_sets(balanced, key, PART_SHARES, PARTS)
        label = F.col("yes").cast("int").alias("label")
        examples = materialise(parts.join(told, key).select("weights", label, "part"), "examples")
        model = fit_until_worse(*[examples.where(F.col("part") == part) for part in PARTS[:2]])
        kept = examples.where(F.col("part") == PARTS[2])
        return model, kept.select(F.lit(topic).alias("topic"), "weights", "label")

    with ThreadPool(min(len(topics), FITS_AT_ONCE)) as pool:
        fitted = pool.map(inheritable_thread_target(labeled.sparkSession)(fit), topics)
    models = {topic: model for topic, (model, _) in zip(topics, fitted)}
    return Trained(words, models, reduce(DataFrame.unionByName, [kept for _, kept in fitted]))


def threshold_label(rows: DataFrame, scores: dict[str, str], limit: float = SCORE_THRESHOLD) -> DataFrame:
    """A 0/1 column per topic: 1 where its score exceeds the limit. Present columns are kept."""
    new = {t: c for t, c in scores.items() if t not in rows.columns}
    return rows.withColumns({t: F.coalesce((F.col(c) > limit).cast("int"), F.lit(0)) for t, c in new.items()})


def class_report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and both averages.

    Undefined ratios count as zero. All rows are reduced to one count per pair
    of classes before anything else is computed.
    """
    confusion = rows.groupBy(
        F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p")
    ).agg(F.count("*").alias("n"))
    sides = confusion.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("t").alias("label"),
                    F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("said"),
                ),
                F.struct(
                    F.col("p").alias("label"),
                    F.lit(0).cast("long").alias("hit"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("said"),
                ),
            )
        ).alias("s")
    )
    per_class = sides.groupBy("s.label").agg(
        *[F.sum(f"s.{c}").alias(c) for c in ("hit", "support", "said")]
    )

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    per_class = (
        per_class.withColumn("precision", ratio(F.col("hit"), F.col("said")))
        .withColumn("recall", ratio(F.col("hit"), F.col("support")))
        .withColumn(
            "f1",
            ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
    )
    metrics = ("precision", "recall", "f1")
    summary = per_class.agg(
        F.sum("hit").alias("hits"),
        F.sum("support").alias("support"),
        *[F.avg(m).alias(f"macro_{m}") for m in metrics],
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}") for m in metrics],
    )
    accuracy = ratio(F.col("hits"), F.col("support"))
    lines = F.array(
        F.struct(F.lit("accuracy").alias("label"), *[accuracy.alias(m) for m in metrics]),
        *[
            F.struct(F.lit(f"{kind} avg").alias("label"), *[F.col(f"{kind}_{m}").alias(m) for m in metrics])
            for kind in ("macro", "weighted")
        ],
    )
    overall = summary.select("support", F.explode(lines).alias("l")).select("l.*", "support")
    columns = ["label", *metrics, "support"]
    return per_class.select(*columns).unionByName(overall.select(*columns))
