"""The keyword dictionary and matching of texts against it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import materialise, materialise_counting

# --- Fixed values: the published keyword lists and word lists, as given ---
KEYWORDS = {
    "russia": [
        "#Ukraine", "#Russia", "Zelensky", "Zelenskyy", "#Putin", "Keiv", "#UkraineRussia",
        "#UkraineWar", "#WarUkraine", "#WarinUkraine", "#UkraineRussianConflict",
        "#UkraineRussiaConflict", "#UkraineRussianWar", "#UkraineRussiaWar",
        "#RussianUkraineConflict", "#RussiaUkraineConflict", "#RussianUkraineWar",
        "#RussiaUkrainenWar", "#StopRussia", "#StopRussiaNow", "#StopRussianNow",
        "#StopRussianaggression", "#Russiaisterrorist", "#RussiaIsTerroristState",
        "#StandWithUkraine", "#SupportUkraine", "#ArmUkraineNow",
    ],
    "midterms": [
        "midterms", "#MidtermElections2022", "#2022elections", "#elections2022", "#Midterms22",
        "#midterms2022", "#elections", "#Democracy", "#Equality", "#Politics", "#SaveDemocracy",
        "#vote", "#votewisely", "#democracynotautocracy", "#BlueTsunami2022",
        "#democratReductionAct", "#NoDemBer", "#RoeVember",
    ],
    "childcare": [
        "#children", "#kids", "#childcare", "#preschool", "#daycare", "#education",
        "#earlychildhoodeducation", "#nursery", "#Parenting", "#kidshealth", "#childhealth",
        "#healthychildren",
    ],
}
EXCLUDED_PIECES = (
    "is", "no", "with", "ber", "stop", "now", "state", "stand", "support", "arm", "warin",
    "save", "blue", "reduction", "act", "vember",
)
EXTRA_TERMS = {
    "midterms": [
        "2022elections", "elections", "midtermelections2022", "midterms2022", "nodember",
        "roevember", "savedemocracy", "vote",
    ],
    "russia": [
        "armukrainenow", "russianukrainewar", "russiaukraineconflict", "standwithukraine",
        "stoprussia", "stoprussianaggression", "stoprussianow", "supportukraine",
        "ukrainerussia", "ukrainerussiaconflict", "ukrainerussianwar", "ukrainerussiawar",
        "ukrainewar", "warinukraine", "warukraine",
    ],
    "childcare": [
        "childcare", "childhealth", "children", "daycare", "earlychildhoodeducation",
        "education", "healthychildren", "kids", "kidshealth", "nursery", "preschool",
    ],
}
TOPIC_SEPARATOR = " | "
# --- end of fixed values ---

#: Bytes of terms in one automaton, each term counting for so many more. A worker needs about a
#: hundred times as much memory for it.
AUTOMATON_BYTES, TERM_BYTES = 2 << 20, 8


def keyword_rows(spark: SparkSession, keywords: Mapping[str, Iterable[str]] = KEYWORDS) -> DataFrame:
    """A curated dictionary as rows ``(topic, keyword, position)``."""
    rows = [(topic, word) for topic, words in keywords.items() for word in words]
    return spark.createDataFrame(
        [(topic, word, i) for i, (topic, word) in enumerate(rows)],
        "topic string, keyword string, position long",
    )


def expand_keywords(
    keywords: DataFrame, excluded: Iterable[str] = EXCLUDED_PIECES, extra: DataFrame | None = None
) -> DataFrame:
    """``(topic, keyword, position)`` to ``(term, topic)``; the last topic of a term wins.

    A keyword yields itself and each of its capitalised pieces, all lower-cased.
    ``extra`` adds whole terms, taken after all keywords.
    """
    pieces = F.regexp_extract_all("keyword", F.lit("[A-Z][^A-Z]*"), F.lit(0))
    kept = F.filter(F.transform(pieces, F.lower), lambda p: ~p.isin(*excluded))
    listed = keywords.select(
        "topic",
        F.lit(0).alias("origin"),
        "position",
        F.posexplode(F.concat(F.array(F.lower("keyword")), kept)).alias("piece", "term"),
    )
    if extra is not None:
        listed = listed.unionByName(
            extra.select(
                "topic",
                F.lit(1).alias("origin"),
                "position",
                F.lit(0).alias("piece"),
                F.col("keyword").alias("term"),
            )
        )
    latest = F.struct("origin", "position", "piece")
    return listed.groupBy("term").agg(F.max_by("topic", latest).alias("topic"))


def lookup_topic(rows: DataFrame, dictionary: DataFrame, keyword: str = "keyword") -> tuple[DataFrame, DataFrame]:
    """Strict keyword lookup: the rows with their topic, and the keywords that have none.

    Callers that must not lose a row check that the second frame is empty.
    """
    named = dictionary.select(F.col("term").alias(keyword), "topic")
    found = rows.join(named, keyword, "left")
    missing = (
        found.where(F.col("topic").isNull()).groupBy(keyword).agg(F.count("*").alias("n_rows"))
    )
    return found.where(F.col("topic").isNotNull()), missing


@dataclass(frozen=True)
class Dictionary:
    """A curated term list that lives inside the plan as literals.

    :func:`tag_terms` gives the same columns for lists of any length.
    """

    entries: tuple[tuple[str, str], ...]

    @classmethod
    def from_rows(cls, terms: DataFrame) -> Dictionary:
        """Read the ``(term, topic)`` rows of a curated list."""
        return cls(tuple(sorted((r.term, r.topic) for r in terms.select("term", "topic").collect())))

    @classmethod
    def of(cls, spark: SparkSession, keywords: Mapping[str, Iterable[str]] = KEYWORDS) -> Dictionary:
        return cls.from_rows(expand_keywords(keyword_rows(spark, keywords)))

    @property
    def topics(self) -> list[str]:
        return sorted({topic for _, topic in self.entries})

    def tag(self, df: DataFrame, text: str = "text", boundary: bool = False) -> DataFrame:
        """Add ``matched_words``, ``topics`` and one 0/1 column per topic.

        A term is found anywhere in the text, or only as a whole word with
        ``boundary``. The text is lower-cased once, in a column of its own.
        """
        tagged = (
            df.withColumn("_low", F.lower(text))
            .withColumn("matched_words", self._terms(F.col("_low"), boundary))
            .withColumns({topic: self._flag(topic) for topic in self.topics})
        )
        return tagged.drop("_low").withColumn("topics", flags_to_topics(self.topics))

    def _flag(self, topic: str) -> Column:
        """1 when any matched word belongs to ``topic``, else 0."""
        own = F.array(*[F.lit(t) for t, owner in self.entries if owner == topic])
        return F.arrays_overlap("matched_words", own).cast("int")

    def _terms(self, low: Column, boundary: bool) -> Column:
        """Sorted array of the terms found; longer terms are tried only below their root."""

        def one(term: str, root: str) -> Column:
            if boundary:
                return F.when(_whole_word(low, term), F.lit(term))
            return F.lit(term) if term == root else F.when(low.contains(term), F.lit(term))

        found = [
            F.when(low.contains(root), F.array(*[one(t, root) for t in terms]))
            for root, terms in _families(t for t, _ in self.entries).items()
        ]
        return F.array_sort(F.array_compact(F.flatten(F.array_compact(F.array(*found)))))


def _families(terms: Iterable[str]) -> dict[str, list[str]]:
    """Terms by the shortest term they contain: where the root is absent, so is its family."""
    families: dict[str, list[str]] = {}
    for term in sorted(terms, key=lambda t: (len(t), t)):
        root = next((r for r in families if r in term), term)
        families.setdefault(root, []).append(term)
    return families


def _whole_word(low: Column, term: str) -> Column:
    return low.rlike(r"(?U)(?<!\w)\Q" + term + r"\E(?!\w)")


def flags_to_topics(topics: Iterable[str]) -> Column:
    """Sorted array of the topics whose 0/1 column is set."""
    return F.array_compact(F.array(*[F.when(F.col(t) == 1, F.lit(t)) for t in sorted(topics)]))


def topic_flags(df: DataFrame, topics: Iterable[str], source: str = "topics") -> DataFrame:
    """One 0/1 column per topic, from an array of topics."""
    return df.withColumns({t: F.array_contains(source, t).cast("int") for t in topics})


def join_topics(topics: Column, when_empty: str | None = None) -> Column:
    """Serialise a set with the fixed separator; ``when_empty`` replaces the empty set."""
    joined = F.array_join(F.array_sort(topics), TOPIC_SEPARATOR)
    return joined if when_empty is None else F.when(F.size(topics) == 0, when_empty).otherwise(joined)


def split_topics(serialised: Column) -> Column:
    """The set behind a serialised string, pieces trimmed."""
    return F.transform(F.split(serialised, r"\|"), lambda piece: F.trim(piece))


def tag_terms(
    df: DataFrame, terms: DataFrame, key: str, text: str = "text", slice_bytes: int = AUTOMATON_BYTES
) -> DataFrame:
    """The columns of :meth:`Dictionary.tag` for ``(term, topic)`` rows of any number.

    An automaton finds all terms in one pass over a text, whatever their number; a worker builds it
    once. It holds ``slice_bytes`` of terms at most: a longer list is dealt by hash into slices, each
    with an automaton and a pass of its own, whose finds are put together by ``key``, which tells the
    rows of ``df`` apart. Topics become columns, so they must be few. Terms are searched as they are,
    in the lower-cased text; empty and null terms are left out, and a null text holds none.
    """
    named = terms.where(F.length("term") > 0).groupBy("term").agg(F.collect_set("topic").alias("topics"))
    size = F.sum(F.octet_length("term") + F.lit(TERM_BYTES))
    named, seen = materialise_counting(named, "terms", size=size)
    slices = max(1, -(-(seen["size"] or 0) // slice_bytes))
    topics = sorted(r.topic for r in named.select(F.explode("topics").alias("topic")).distinct().collect())
    if slices == 1:
        tagged = df.withColumn("_found", _finder(named)(F.lower(text)))
        tagged = tagged.withColumns({c: F.col("_found")[c] for c in _FOUND})
        return topic_flags(tagged.drop("_found"), topics)
    texts = materialise(df.select(key, F.lower(text).alias("_low")), "texts")
    parts = []
    for i in range(slices):
        own = named.where(F.pmod(F.xxhash64("term"), F.lit(slices)) == i)
        part = texts.select(key, _finder(own)("_low").alias("_found"))
        parts.append(materialise(part.select(key, "_found.*"), "found"))
    found = reduce(DataFrame.unionByName, parts).groupBy(key).agg(
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in _FOUND]
    )
    found = found.withColumnRenamed(key, "_key")
    return topic_flags(df.join(found, df[key].eqNullSafe(F.col("_key"))).drop("_key"), topics)


_FOUND = ("matched_words", "topics")
#: The automaton that a worker used last, with the terms it is made of.
_LAST: list = [None, None]


def _automaton(terms: tuple[str, ...]):
    if _LAST[0] != terms:
        import ahocorasick

        built = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            built.add_word(term, i)
        built.make_automaton()
        _LAST[:] = terms, built
    return _LAST[1]


def _finder(named: DataFrame) -> Callable[..., Column]:
    """A function of a lower-cased text to the sorted terms in it and their topics.

    ``named`` has ``term, topics`` and is one slice, so that it may be held by the driver and by
    every worker.
    """
    rows = sorted((r.term, tuple(sorted(t for t in r.topics))) for r in named.collect())
    terms = tuple(term for term, _ in rows)
    topics = sorted({t for _, own in rows for t in own})
    owners = [frozenset(topics.index(t) for t in own) for _, own in rows]

    def lists(places: list[list[int]], values: list[str] | tuple[str, ...]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, places)]).astype(np.int32)
        flat = pa.array([i for own in places for i in own], pa.int32())
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.string()).take(flat))

    @F.arrow_udf("matched_words array<string>, topics array<string>")
    def find(low: pa.Array) -> pa.Array:
        search = _automaton(terms).iter if terms else lambda text: ()
        held = [sorted({i for _, i in search(text)}) if text else [] for text in low.to_pylist()]
        named = [sorted(frozenset().union(*[owners[i] for i in own])) for own in held]
        return pa.StructArray.from_arrays([lists(held, terms), lists(named, topics)], _FOUND)

    return find
