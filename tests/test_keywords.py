from pyspark.sql import functions as F

from threadloom.functions import keywords as kw


def test_shipped_dictionary_expands_to_its_known_sizes(spark):
    terms = kw.expand_keywords(kw.keyword_rows(spark))
    sizes = {r["topic"]: r["count"] for r in terms.groupBy("topic").count().collect()}
    assert sizes == {"russia": 37, "midterms": 27, "childcare": 13}
    extended = kw.expand_keywords(kw.keyword_rows(spark), extra=kw.keyword_rows(spark, kw.EXTRA_TERMS))
    assert extended.count() == 111


def test_pieces_are_capitalised_runs_and_the_last_topic_wins(spark):
    rows = kw.keyword_rows(spark, {"one": ["#WarNow", "shared"], "two": ["Shared"]})
    terms = {r.term: r.topic for r in kw.expand_keywords(rows).collect()}
    assert terms == {"#warnow": "one", "war": "one", "shared": "two"}


def test_substring_and_boundary_matching(spark):
    words = kw.Dictionary.of(spark, {"x": ["war"], "y": ["c++"]})
    df = spark.createDataFrame([("Warm WAR c++",), ("award",), (None,)], "text string")
    loose = [r.matched_words for r in words.tag(df).collect()]
    strict = [r.matched_words for r in words.tag(df, boundary=True).collect()]
    assert loose == [["c++", "war"], ["war"], []]
    assert strict == [["c++", "war"], [], []]


def test_long_lists_give_the_columns_of_short_ones(spark):
    terms = kw.expand_keywords(kw.keyword_rows(spark))
    texts = ["Ukraine war and #Kids vote", "nothing", "STANDWITHUKRAINE", "a", "", None, "Ünïted #kids\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    inline = kw.Dictionary.from_rows(terms).tag(df.na.fill("", ["text"]))
    joined = kw.tag_terms(df, terms, "id")
    columns = ["id", "matched_words", "topics", *sorted({t for t in kw.KEYWORDS})]
    assert sorted(joined.select(columns).collect()) == sorted(inline.select(columns).collect())


def test_long_lists_of_any_length(spark):
    rows = [(str(n), "number") for n in range(3000)] + [("é", "letter"), ("c++", "code")]
    df = spark.createDataFrame([(1, "12 C++ 2999 é"), (2, "x")], "id long, text string")
    got = {r.id: r for r in kw.tag_terms(df, spark.createDataFrame(rows, "term string, topic string"), "id").collect()}
    held = {str(n) for n in range(3000) if str(n) in "12 C++ 2999 é"}
    assert set(got[1].matched_words) == held | {"é", "c++"}
    assert (got[1].topics, got[2].topics, got[2].number) == (["code", "letter", "number"], [], 0)


def test_long_lists_in_slices(spark):
    words = [f"{a}{b}" for a in ("war", "ukr", "é", "日", "c+") for b in range(40)] + ["ar", "r1", "日本"]
    rows = [(w, f"t{i % 3}") for i, w in enumerate(words)] + [("ar", "t2"), ("", "t0"), (None, "t1")]
    terms = spark.createDataFrame(rows, "term string, topic string")
    texts = ["WAR12 ukr3", "é39é4 日本日7", "", None, "C+1c+11 " * 3000, "none"]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "id long, text string, term string")
    one, many = kw.tag_terms(df, terms, "id"), kw.tag_terms(df, terms, "id", slice_bytes=200)
    columns = ["id", "term", "matched_words", "topics", "t0", "t1", "t2"]
    got = sorted(one.select(columns).collect())
    assert sorted(many.select(columns).collect()) == got
    for row, text in zip(got, texts, strict=True):
        held = sorted(w for w in words if w in (text or "").lower())
        owned = sorted({t for w, t in rows if w in held})
        assert (row.matched_words, row.topics) == (held, owned)
        assert [row.t0, row.t1, row.t2] == [int(t in owned) for t in ("t0", "t1", "t2")]
    assert {tuple(r.topics) for r in kw.tag_terms(df, terms.limit(0), "id").collect()} == {()}


def test_serialised_sets_round_trip(spark):
    df = spark.createDataFrame([(["b", "a"],), ([],)], "topics array<string>")
    out = df.select(kw.join_topics(F.col("topics"), "None").alias("s")).collect()
    assert [r.s for r in out] == ["a | b", "None"]
    back = spark.createDataFrame([("a | b",), ("a|b ",)], "s string").select(kw.split_topics(F.col("s")).alias("t"))
    assert [r.t for r in back.collect()] == [["a", "b"], ["a", "b"]]


def test_lookup_reports_what_it_cannot_place(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",)], "keyword string")
    dictionary = spark.createDataFrame([("a", "x")], "term string, topic string")
    found, missing = kw.lookup_topic(rows, dictionary)
    assert [tuple(r) for r in found.collect()] == [("a", "x")]
    assert [tuple(r) for r in missing.collect()] == [("b", 2)]
