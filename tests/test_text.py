import random
import string

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as tx


def one(spark, value, expression, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value", ["  a\t\nb  c ", "a b c\x1cd\x85e　f", "\n\n", "plain text", "a\x0bb"])
def test_whitespace_equals_python_split(spark, value):
    assert one(spark, value, tx.clean_whitespace) == " ".join(value.split())


def test_punctuation_is_the_ascii_set():
    assert tx.PUNCTUATION == string.punctuation


@pytest.mark.parametrize(
    "value, expected",
    [
        ("Hello @user_1 THERE http://a.b/c?d=1 friends", "hello there friends"),
        ("the That abcd ab !\"#$ !!!!", "abcd !!!!"),
        ("   ", ""),
    ],
)
def test_classifier_text(spark, value, expected):
    assert one(spark, value, lambda c: tx.normalize_text(c, ["that"])) == expected


def test_texts_of_any_length_have_one_rule_and_no_limit(spark):
    for n in (3, 311, 312, 3000):
        text = " ".join(f'"word{i}",' for i in range(n))
        assert one(spark, text, lambda c: tx.normalize_text(c, [])) == " ".join(f"word{i}" for i in range(n))
    late = " ".join(["a"] * 5000 + ["ending"])
    assert one(spark, late, lambda c: tx.normalize_text(c, [])) == "ending"


def test_edges_are_cut_but_not_cores(spark):
    words = ["--well-known--"] * 3
    assert one(spark, " ".join(words), lambda c: tx.classifier_tokens(c, [])) == ["well-known"] * 3


def test_tokens_found_in_one_pass_are_those_cut_step_by_step(spark):
    def by_steps(text, stop):
        bare = F.trim(F.regexp_replace(F.lower(text), tx.MENTION, ""))
        unlinked = tx.clean_whitespace(F.regexp_replace(bare, tx.LINK, " "))
        apart = F.regexp_replace(unlinked, r"(?<![^ ])\p{Punct}+|\p{Punct}+(?![^ ])", " $0 ")
        long_enough = F.filter(F.split(apart, " +"), lambda t: F.length(t) >= tx.MIN_TOKEN_LENGTH)
        return F.filter(long_enough, lambda t: ~t.isin(stop) & (F.instr(F.lit(tx.PUNCTUATION), t) == 0))

    pieces = list("aabB1é_'-.,!\"@/:\\]^[&~ \t\n\x0b\x1c\x1f\x00\x85\xa0\u1680\u2003\u2028\u3000\u200b\u180e。»İΣ😀")
    pieces += ["that", "word", "http://a.b/c", "https://", "@you", "()*+", "!\"#$%", "-----", string.punctuation]
    chance = random.Random(7)
    texts = ["".join(chance.choices(pieces, k=chance.randrange(60))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in [*texts, "", None]], "x string").repartition(8)
    both = rows.select(tx.classifier_tokens(F.col("x"), ["that"]).alias("got"), by_steps(F.col("x"), ["that"]).alias("due"))
    assert both.where("got <=> due").count() == len(texts) + 2 and both.where("size(got) > 1").count() > 1000
    plan = rows.select(tx.classifier_tokens(F.col("x"), []).alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") == 3 and "split(" not in plan


def test_simple_tokens(spark):
    value = "Élan naïve_x _skip a 12 ab3cd über-groß " + "z" * 16 + " " + "y" * 15
    got = one(spark, value, lambda c: tx.simple_tokens(c, ["groß"]))
    assert got == ["elan", "naive_x", "ab", "cd", "uber", "y" * 15]


@pytest.mark.parametrize("seconds, expected", [(0, "1970-01-01T00:00:00.000Z"), (1664496061, "2022-09-30T00:01:01.000Z"), (-1, "1969-12-31T23:59:59.000Z")])
def test_epoch_to_iso_in_any_zone(spark, seconds, expected):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert one(spark, seconds, tx.epoch_iso, "long") == expected
        assert one(spark, float(seconds), tx.epoch_iso, "double") == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_identifier_and_path_pieces(spark):
    assert one(spark, "t1_abc", tx.strip_id_prefix) == "abc"
    assert one(spark, "/r/x/comments/id/title/c1/", tx.thread_path) == "/r/x/comments/id/title"
    assert one(spark, "x", tx.thread_path) == ""
    assert one(spark, "/a/12_3.json.gz", lambda c: tx.key_before(c, "_")) == "12"
    assert one(spark, "/a_b/vote_xyz.json", tx.key_after_last) == "xyz"


def test_last_reference_wins(spark):
    kind = "array<struct<type:string,id:string>>"
    refs = [("replied_to", "1"), ("quoted", "2"), ("replied_to", "3")]
    assert one(spark, refs, lambda c: tx.last_reference(c, "replied_to"), kind) == "3"
    assert one(spark, [], lambda c: tx.last_reference(c, "quoted"), kind) is None
    assert one(spark, None, lambda c: tx.last_reference(c, "quoted"), kind) is None
