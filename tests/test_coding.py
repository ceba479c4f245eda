import pytest
from pyspark.sql import functions as F

from threadloom.operators import coding


def test_alpha_of_the_published_example(spark):
    # four observers, twelve units, nominal alpha 0.743 in Krippendorff's worked example
    observers = [
        [1, 2, 3, 3, 2, 1, 4, 1, 2, None, None, None],
        [1, 2, 3, 3, 2, 2, 4, 1, 2, 5, None, 3],
        [None, 3, 3, 3, 2, 3, 4, 2, 2, 5, 1, None],
        [1, 2, 3, 3, 2, 4, 4, 1, 2, 5, 1, None],
    ]
    rows = [("all", str(u), str(c) if c else None) for o in observers for u, c in enumerate(o)]
    df = spark.createDataFrame(rows, "scope string, unit string, code string")
    row = coding.krippendorff_alpha(df, ["scope"]).first()
    assert row.alpha == pytest.approx(0.743, abs=5e-4) and row.n_codes == 40


def test_alpha_without_variation_is_null(spark):
    df = spark.createDataFrame([("all", "1", "x"), ("all", "1", "x")], "scope string, unit string, code string")
    assert coding.krippendorff_alpha(df, ["scope"]).first().alpha is None


def test_percent_agreement(spark):
    rows = [(1, "Yes", "Yes"), (1, "No", "Not sure"), (1, "Not sure", "Not sure"), (2, None, None), (2, "Yes", "No")]
    df = spark.createDataFrame(rows, "round int, a string, b string")
    got = {r.scope: r for r in coding.percent_agreement(df, F.col("a"), F.col("b"), F.col("round")).collect()}
    assert (got[None].n_agree, got[None].n_items, got[None].n_sure) == (2, 5, 4)
    assert (got[1].n_agree, got[1].n_sure, got[2].n_sure) == (2, 2, 2)
    assert got[1].agreement == pytest.approx(2 / 3) and got[1].agreement_sure == 1


def test_agreement_types_use_their_argument(spark):
    df = spark.createDataFrame([("Yes", "No"), ("No", "Yes"), ("No", "No"), ("Yes", None)], "a string, b string")
    got = {r.pair: (r.n, r.share) for r in coding.agreement_types(df, F.col("a"), F.col("b")).collect()}
    assert got == {"No_Yes": (2, pytest.approx(2 / 3)), "No": (1, pytest.approx(1 / 3))}


def test_settled_rows_replace_even_by_null_and_corrections_do_not(spark):
    codes = spark.createDataFrame([("1", "Yes", "x"), ("2", "No", "y")], "cid string, final_on_topic string, final_topic string")
    settled = spark.createDataFrame([("1", None, "z"), ("9", "Yes", "q")], "cid string, a string, b string")
    columns = {"final_on_topic": "a", "final_topic": "b"}
    replaced = {tuple(r) for r in coding.apply_overrides(codes, settled, columns).collect()}
    assert replaced == {("1", None, "z"), ("2", "No", "y")}
    corrected = {tuple(r) for r in coding.apply_overrides(codes, settled, columns, keep_null=False).collect()}
    assert corrected == {("1", "Yes", "z"), ("2", "No", "y")}
