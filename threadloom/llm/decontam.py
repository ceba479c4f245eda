"""Benchmark decontamination by winnowing, in column expressions only.

Texts are fingerprinted with the minimal hash of every ``window - gram + 1`` consecutive ``gram``
word pieces, so that any run of ``window`` words which a document shares with an item puts one
fingerprint into both. Fingerprints are joined, and each hit is extended to the windows around it,
which are compared word by word with the windows of the items.

A window is ``window`` consecutive words of an item; an item of fewer words is one window, and its
pieces are as long as itself, so that every place of a document is posted for it. That second pass
over the documents is made only where such items exist. The first one also counts the words.

Defined results: a null text has no words and an item without words no window. An item without an
id still marks words but is not listed. Rows of one id are judged by their own texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import materialise

WINDOW = 10
GRAM = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered_words(text: Column) -> Column:
    found = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _upto(last: Column) -> Column:
    """0 to ``last``; empty if that is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _pieces(length: int) -> Column:
    """Hash of every run of ``length`` words, from the word hashes ``h``."""
    h = F.col("h")
    return F.transform(
        _upto(F.size(h) - length), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(length)])
    )


def _hashed(texts: DataFrame, *keys: str) -> DataFrame:
    words = texts.select(*keys, lowered_words(F.col("text")).alias("w"))
    return words.select(*keys, F.transform("w", lambda x: F.xxhash64(x)).alias("h"))


def fingerprints(texts: DataFrame, keys: list[str], window: int, gram: int) -> DataFrame:
    """``p, f``: places and hashes of the pieces that are minimal in some window.

    Every text has one row more, with its number of words as ``n_words``, which is null otherwise; the
    ``f`` of that row is only there to spread such rows.
    """
    hashed = _hashed(texts, *keys)
    pieces = hashed.select(*keys, F.size("h").cast("long").alias("n"), _pieces(gram).alias("g"))
    listed = F.concat("g", F.array(F.xxhash64("n", *keys)))
    # The outer form: for the other one Spark adds a filter that evaluates the pieces again.
    posted = pieces.select(*keys, "n", "g", F.posexplode_outer(listed).alias("p", "f"))
    around = window - gram

    def reach(sign: int) -> Column:
        """Neighbours on one side, up to ``around``, none of which is smaller."""
        run = F.lit(around)
        for j in range(around, 0, -1):
            larger = F.coalesce(F.get("g", F.col("p") + sign * j) >= F.col("f"), F.lit(False))
            run = F.when(~larger, j - 1).otherwise(run)
        return run

    extra = F.col("p") == F.size("g")
    kept = posted.filter(extra | (reach(-1) + reach(1) >= around))
    return kept.select(*keys, "p", "f", F.when(extra, F.col("n")).alias("n_words"))


def _short_hits(texts: DataFrame, shorter: DataFrame, lengths: list[int], keys: list[str]) -> DataFrame:
    """``p, len`` of the pieces that are items of fewer words, of all their lengths in one pass."""

    def run(length: int) -> Column:
        return F.transform(
            _pieces(length), lambda f, i: F.struct(F.lit(length).alias("len"), i.alias("p"), f.alias("f"))
        )

    posts = _hashed(texts, *keys).select(*keys, F.explode_outer(F.concat(*map(run, lengths))).alias("x"))
    words = F.split("win", " ")
    own = F.coalesce(
        *[F.when(F.col("len") == n, F.xxhash64(*[F.xxhash64(F.get(words, j)) for j in range(n)])) for n in lengths]
    )
    wanted = shorter.select("len", own.alias("f")).distinct()
    return posts.select(*keys, "x.*").join(wanted, ["len", "f"], "left_semi").select(*keys, "p", "len")


def _windows(items: DataFrame, window: int) -> DataFrame:
    """``item, len, win``: the windows of every item as strings."""
    words = items.select("item", lowered_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    placed = words.select("item", "w", length.alias("len"), F.explode_outer(_upto(F.size("w") - length)).alias("s"))
    return placed.select("item", "len", _joined().alias("win")).distinct()


def _joined() -> Column:
    return F.array_join(F.slice("w", F.col("s") + 1, F.col("len")), " ")


def _starts(window: int, gram: int) -> Column:
    """Windows around the hits ``ps`` of the words ``w``, each once."""
    n = F.size("w")

    def around(hit: Column) -> Column:
        first, last = F.greatest(hit["p"] - (window - gram), F.lit(0)), F.least(hit["p"], n - window)
        places = F.when(first <= last, F.sequence(first, last)).otherwise(
            F.array().cast("array<int>")
        )
        whole = F.transform(places, lambda s: F.struct(s.alias("s"), F.lit(window).alias("len")))
        own = F.array(F.struct(hit["p"].alias("s"), hit["len"].alias("len")))
        return F.when(hit["len"] == window, whole).otherwise(own)

    return F.array_distinct(F.flatten(F.transform("ps", around)))


def occurrences(
    texts: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows found (``doc, key, s, len, win``), those of the items (``item, len, win``), and the texts.

    ``texts`` has ``doc, key, text``, ``items`` has ``item, text``. The last table has ``doc, key,
    n_words, copies``, a row per text, from the same pass over the texts as the hits.
    """
    windows = materialise(_windows(items, window), "item-windows")
    long = items.filter(F.size(lowered_words(F.col("text"))) >= window)
    wanted = fingerprints(long, ["item"], window, gram).filter("n_words is null").select("f").distinct()
    wanted = materialise(wanted.withColumn("hit", F.lit(True)), "item-fingerprints")
    keys = ["doc", "key"]
    posts = fingerprints(texts, keys, window, gram).join(wanted, "f", "left")
    posts = posts.filter("hit or n_words is not null")
    place = F.struct("p", F.lit(window).alias("len"))
    posts = posts.select(*keys, F.when(F.col("n_words").isNull(), place).alias("x"), "n_words")
    shorter = windows.filter(F.col("len") < window)
    # At most window - 1 lengths.
    lengths = sorted(r.len for r in shorter.select("len").distinct().collect())
    if lengths:
        more = _short_hits(texts, shorter, lengths, keys).select(*keys, F.struct("p", "len").alias("x"))
        posts = posts.unionByName(more, allowMissingColumns=True)
    judged = posts.groupBy(*keys).agg(
        F.collect_set("x").alias("ps"), F.max("n_words").alias("n_words"), F.count("n_words").alias("copies")
    )
    judged = materialise(judged, "hits")
    hits = judged.filter(F.size("ps") > 0).select(*keys, "ps")

    same = texts["doc"].eqNullSafe(hits["doc"]) & (texts["key"] == hits["key"])
    touched = texts.join(hits, same).select(
        hits["doc"], hits["key"], "ps", lowered_words(F.col("text")).alias("w")
    )
    touched = touched.select(*keys, "w", F.explode_outer(_starts(window, gram)).alias("x"))
    touched = touched.filter("x is not null")
    around = touched.select(*keys, "w", "x.s", "x.len").select(*keys, "s", "len", _joined().alias("win"))
    found = around.join(windows.select("len", "win").distinct(), ["len", "win"], "left_semi")
    return materialise(found.distinct(), "occurrences"), windows, judged.select(*keys, "n_words", "copies")


def _covered(found: DataFrame) -> DataFrame:
    """Words inside any occurrence, per document."""
    from pyspark.sql import Window

    before = (
        Window.partitionBy("doc", "key").orderBy("s", "len").rowsBetween(Window.unboundedPreceding, -1)
    )
    end = F.col("s") + F.col("len")
    spans = found.select("doc", "key", "s", end.alias("e"), F.max(end).over(before).alias("done"))
    new = F.col("e") - F.greatest("s", F.coalesce("done", F.lit(0)))
    return spans.groupBy("doc", "key").agg(
        F.sum(F.greatest(new, F.lit(0))).cast("long").alias("n_hit")
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per row: ``doc_id, n_words, n_hit, items, contaminated`` and ``text_key``, the text's hash.

    ``items`` lists, as sorted strings, the items of which a window occurs.
    """
    text = F.col(text_col)
    texts = docs.select(
        F.col(id_col).alias("doc"), F.xxhash64(text).alias("key"), text.alias("text")
    )
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    found, windows, rows = occurrences(texts, asked, window, gram)
    named = found.select("doc", "key", "len", "win").distinct().join(windows, ["len", "win"])
    named = named.filter("item is not null").select("doc", "key", F.col("item").cast("string")).distinct()
    listed = named.groupBy("doc", "key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    marked = _covered(found)
    both = marked["doc"].eqNullSafe(listed["doc"]) & (marked["key"] == listed["key"])
    judged = marked.join(listed, both, "left").select(
        marked["doc"].alias("d"), marked["key"].alias("k"), "n_hit", "items"
    )
    copies = F.array_repeat(F.lit(True), F.col("copies").cast("int"))
    rows = rows.select("doc", "key", "n_words", F.explode(copies))
    joined = rows.join(judged, rows["doc"].eqNullSafe(judged["d"]) & (rows["key"] == judged["k"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (n_hit > 0).alias("contaminated"),
        F.col("key").alias("text_key"),
    )
