"""Topic model, classifier, incremental scoring and the classification report."""

from __future__ import annotations

from pyspark.ml.clustering import LDAModel, LocalLDAModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.operators import models as ops
from threadloom.operators import posts as post_ops
from threadloom.operators import relational as rel
from threadloom.plans import fixtures as fx
from threadloom.plans.registry import query, table
from threadloom.plans.scans import clean_sql
from threadloom.plans.tables import CODED, coded_conversations
from threadloom.plans.texts import STOP
from threadloom.session import artefact_path, exists, rename_new, scratch_path

LEXICON, LEXICON_SQL = fx.LEXICON, fx.LEXICON_SQL


def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ops.word_counts(fx.raw_posts(spark, sf).select("pid", "text"), STOP)


def topic_model(spark: SparkSession, sf: str, counts: DataFrame) -> LDAModel:
    """The topic model of the posts, fitted once per application and saved; later queries load it."""
    settings = (ops.TOPIC_COUNT, ops.WORD_CELLS, ops.SEED, ops.LEARNING_OFFSET, sorted(STOP))
    path = artefact_path(spark, "topics", [fx.raw_posts(spark, sf)], *settings)
    if not exists(spark, path):
        staged = scratch_path(spark, "topics")
        ops.fit_topics(counts).save(staged)
        rename_new(spark, staged, path)
    return LocalLDAModel.load(path)


@query("lda_topics")
def lda_topics(spark: SparkSession, sf: str) -> DataFrame:
    counts = word_counts(spark, sf)
    return ops.topic_loadings(topic_model(spark, sf, counts), counts)


@query("topic_words")
def topic_words(spark: SparkSession, sf: str) -> DataFrame:
    """The words that describe each topic, named exactly."""
    counts = word_counts(spark, sf)
    return ops.topic_words(topic_model(spark, sf, counts), counts)


@query(
    "score_missing",
    fx.with_views(
        f"""select pid, coalesce(tox, 1e0 * len(list_filter(words, lambda w: list_contains([{LEXICON_SQL}], w))) / nullif(len(words), 0)) as tox
            from (select pid, tox, list_filter(string_split({clean_sql('lower(text)')}, ' '), lambda w: w <> '') as words from posts_fx) t"""
    ),
)
def score_missing(spark: SparkSession, sf: str) -> DataFrame:
    posts = fx.raw_posts(spark, sf).select("pid", "text", "tox")
    return ops.score_missing(posts, ops.lexicon_scorer(LEXICON)).select("pid", "tox")


def flaky_lexicon():
    """A scorer that does not take texts of a length divisible by seven."""
    words = set(LEXICON)

    def score(texts):
        if (texts.str.len() % 7 == 0).any():
            raise ValueError("refused")
        found = texts.str.lower().str.split()
        return found.map(lambda ws: sum(w in words for w in ws) / len(ws) if ws else 0.0)

    return score


@query(
    "score_batches",
    fx.with_views(
        f"""select pid, coalesce(tox, case when length(text) % 7 <> 0 then
                       coalesce(1e0 * len(list_filter(words, lambda w: list_contains([{LEXICON_SQL}], w))) / nullif(len(words), 0), 0e0) end) as tox,
                   tox is null and text is not null and length(text) % 7 = 0 as tox_failed
            from (select pid, tox, text, list_filter(string_split({clean_sql('lower(text)')}, ' '), lambda w: w <> '') as words from posts_fx) t"""
    ),
)
def score_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Missing scores by a model that is loaded once per task and fails on some texts."""
    posts = fx.raw_posts(spark, sf).select("pid", "text", "tox")
    return ops.score_batches(posts, flaky_lexicon, retries=1).drop("text")


FINAL_TOPIC = """
labeled as (select pid, case when final_topic is null or final_topic in ('Not sure', 'discuss') or russia + midterms + childcare = 0
                             then 'Off_topic' else final_topic end as final_topic
            from posts_fx join coded using (conversation_id))
"""


@query(
    "label_onehot",
    fx.with_views(
        """select pid, final_topic, cast(final_topic = 'Off_topic' as integer) as "none",
                  cast(final_topic = 'Childcare/parenting' as integer) as children,
                  cast(final_topic = 'Russia/Ukraine war' as integer) as russia,
                  cast(final_topic = 'US midterm elections' as integer) as midterm,
                  cast(final_topic = 'Russia/Ukraine war' as integer) as on_topic,
                  cast(final_topic <> 'Russia/Ukraine war' as integer) as not_topic
           from labeled""",
        CODED.strip(),
        FINAL_TOPIC.strip(),
    ),
)
def label_onehot(spark: SparkSession, sf: str) -> DataFrame:
    coded = rel.join_codes(fx.posts(spark, sf), coded_conversations(spark, sf))
    labeled = post_ops.recode_off_topic(coded).select("pid", "final_topic")
    return ops.label_binary(ops.label_onehot(labeled), "Russia/Ukraine war")


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return documents.select("doc_id", tx.classifier_tokens(F.col("text"), STOP).alias("tokens"))


def hashed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The hashed words of every document, written once per application; fits and scores read them."""
    path = artefact_path(spark, "words", [table(spark, sf, "documents")], ops.CLASSIFIER_CELLS, sorted(STOP))
    if not exists(spark, path):
        staged = scratch_path(spark, "words")
        ops.hashed_words(tokens(spark, sf), "doc_id").write.parquet(staged)
        rename_new(spark, staged, path)
    return spark.read.parquet(path)


def trained(spark: SparkSession, sf: str) -> ops.Trained:
    """One classifier per label, trained on a balanced 80%, fitted once per application and saved."""
    labels = table(spark, sf, "labels")
    inputs = [table(spark, sf, "documents"), labels]
    path = artefact_path(spark, "classifiers", inputs, ops.REGULARISATION, ops.PATIENCE, ops.PART_SHARES, sorted(STOP))
    if not exists(spark, path):
        topics = {"poor": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
        ops.fit_topic_classifiers(labels, hashed_documents(spark, sf), "doc_id", topics).save(path)
    return ops.Trained.load(spark, path)


@query("classify_topic")
def classify_topic(spark: SparkSession, sf: str) -> DataFrame:
    """Every document scored and thresholded as by exclusive classifiers."""
    return trained(spark, sf).classify(hashed_documents(spark, sf), "doc_id")


@query("classify_multilabel")
def classify_multilabel(spark: SparkSession, sf: str) -> DataFrame:
    """The same as independent labels, any number of which a document may have."""
    return trained(spark, sf).classify(hashed_documents(spark, sf), "doc_id", ops.MULTILABEL_THRESHOLD)


@query("classify_report")
def classify_report(spark: SparkSession, sf: str) -> DataFrame:
    """How the classifiers do on the held-out part of their balanced samples."""
    return trained(spark, sf).held_out_report()


@query(
    "threshold_label",
    fx.with_views(
        "select pid, cast(t0 * 5 > 0.8e0 as integer) as childcare, cast(t1 * 5 > 0.8e0 as integer) as russia, 1 as kept from loading_fx"
    ),
)
def threshold_label(spark: SparkSession, sf: str) -> DataFrame:
    scores = fx.loadings(spark, sf).select(
        "pid", (F.col("t0") * 5).alias("s0"), (F.col("t1") * 5).alias("s1"), F.lit(1).alias("kept")
    )
    return ops.threshold_label(scores, {"childcare": "s0", "russia": "s1", "kept": "s0"}).drop("s0", "s1")


REPORT = """
predicted as (select quality as truth, case when doc_id % 5 = 0 then 1 - quality when doc_id % 7 = 0 then 2 else quality end as pred from labels),
names as (select truth as label from predicted union select pred from predicted),
per_class as (select cast(label as varchar) as label, support,
                     case when said = 0 then 0 else 1e0 * hit / said end as precision,
                     case when support = 0 then 0 else 1e0 * hit / support end as recall
              from (select label, (select count(*) from predicted p where p.truth = n.label) as support,
                           (select count(*) from predicted p where p.pred = n.label) as said,
                           (select count(*) from predicted p where p.pred = n.label and p.truth = n.label) as hit
                    from names n) c),
scored as (select label, precision, recall,
                  case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1, support
           from per_class),
accuracy as (select 1e0 * count(*) filter (truth = pred) / count(*) as a, count(*) as n from predicted)
"""


@query(
    "class_report",
    f"""with {REPORT.strip()}
        select * from scored
        union all select 'accuracy', a, a, a, n from accuracy
        union all select 'macro avg', avg(precision), avg(recall), avg(f1), max(n) from scored, accuracy
        union all select 'weighted avg', sum(precision * support) / max(n), sum(recall * support) / max(n), sum(f1 * support) / max(n), max(n)
                  from scored, accuracy""",
)
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    doc, quality = F.col("doc_id"), F.col("quality")
    guess = F.when(doc % 5 == 0, 1 - quality).when(doc % 7 == 0, 2).otherwise(quality)
    rows = table(spark, sf, "labels").select(quality.alias("truth"), guess.alias("pred"))
    return ops.class_report(rows, "truth", "pred")
