"""Near-duplicates by a signature-coordinate inverted join.

Each document has a signature of minima, one per coordinate, over its set of word shingles. Every
coordinate-value pair is a posting list. Two documents above the similarity agree on at least
``matches`` of the coordinates (all but one pair in a million at the bound itself, fewer above it),
so it is enough to post a document under its rarest pairs, one more than it may miss: the others,
and the long lists among them, are skipped when collisions are counted. Pairs that agree on enough
of all coordinates are confirmed on the full sets.

Documents of one set are one class and take part once. Within a posting list a leader, the document
of the least id, is compared with the rest, and those it is linked with take its label, so a group
of near copies costs one pair per document, not all pairs. Lists whose members then have different
labels are settled by a prefix join on the full sets, between members of different labels only: no
link that could join two components goes unchecked, and members that no set can be similar to, such
as copies with too many changes of their own, drop out before any pair is made.

Defined results: a document without words has no set and links with nothing. Rows of a null id take
part; a component takes its least id, and is kept whole only if no row of it has an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import words
from threadloom.operators.graph import CONVERSATION, component_stars
from threadloom.session import materialise

COORDINATES = 64
#: Share of pairs at the similarity bound that the signatures may miss.
MISSED = 1e-6

_SEEDS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 4096, dtype=np.uint64)
_SEEDS = _SEEDS * np.uint64(2) + np.uint64(1)


def match_bound(percent: int, coordinates: int = COORDINATES) -> int:
    """Coordinates on which documents at the similarity bound agree but for :data:`MISSED`."""
    p = percent / 100
    below = 0.0
    for matches in range(coordinates + 1):
        below += comb(coordinates, matches) * p**matches * (1 - p) ** (coordinates - matches)
        if below > MISSED:
            return max(1, matches)
    return coordinates


def shingle_sets(text: words.Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted within it, and the size of each set."""
    starts, of = text.windows(k)
    hashes = words.Windows(text.hashes)
    few = np.flatnonzero((text.n_words > 0) & (text.n_words < k))
    whole = hashes.at(text.first[few], text.first[few + 1])
    values = np.concatenate([hashes.at(starts, starts + k), whole])
    of = np.concatenate([of, few])
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    return values[new], np.bincount(of[new], minlength=len(text.n_words))


def _signatures(k: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, text in words.chunks(batch.column("text"), lowered=True):
                values, size = shingle_sets(text, k)
                n = len(size)
                filled = np.flatnonzero(size)
                cuts = (np.cumsum(size) - size)[filled]
                keys = np.zeros((2, n), dtype=np.uint64)
                lowest = np.zeros((coordinates, len(filled)), dtype=np.uint32)
                if len(filled):
                    keys[0, filled] = np.add.reduceat(words.mix(values + _SEEDS[-1]), cuts)
                    keys[1, filled] = np.add.reduceat(words.mix(values ^ _SEEDS[-2]), cuts)
                    for c in range(coordinates):
                        least = np.minimum.reduceat(values * _SEEDS[c], cuts)
                        lowest[c] = least >> np.uint64(32)
                ends = np.concatenate([[0], np.cumsum(size > 0) * coordinates]).astype(np.int32)
                signature = pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(lowest.T.reshape(-1).view(np.int32))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(base, n) for c in ("doc", "key")),
                        pa.array(size.astype(np.int64)),
                        *map(words.signed, keys),
                        signature,
                    ],
                    ["doc", "key", "n", "k1", "k2", "signature"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, text in words.chunks(batch.column("text"), lowered=True):
                values, size = shingle_sets(text, k)
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(ends), words.signed(values))
                node = batch.column("node").slice(base, len(size))
                yield pa.RecordBatch.from_arrays([node, sets], ["node", "members"])

    return run


def _agreeing(matches: int):
    """Pairs whose signatures agree on ``matches`` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = [
                batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("sa", "sb")
            ]
            enough = (sides[0] == sides[1]).sum(axis=1) >= matches
            kept = batch.select(["a", "b"]).filter(pa.array(enough))
            yield kept

    return run


def _similar(percent: int):
    """Pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("ma"), batch.column("mb")
            good = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
                shared = len(np.intersect1d(a, b, assume_unique=True))
                good[i] = 100 * shared >= percent * (len(a) + len(b) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


class _Join:
    """The tables that every round looks up."""

    def __init__(self, classes: DataFrame, sets: DataFrame, matches: int, percent: int):
        self.classes, self.sets = classes, sets
        self.matches, self.percent = matches, percent

    def links(self, pairs: DataFrame) -> DataFrame:
        """The confirmed ones of distinct pairs ``a, b`` of classes."""
        of = {
            end: self.classes.select(
                F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("signature").alias(f"s{end}")
            )
            for end in "ab"
        }
        sized = pairs.join(of["a"], "a").join(of["b"], "b").filter(
            F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent
        )
        agreed = sized.select("a", "b", "sa", "sb").mapInArrow(
            _agreeing(self.matches), "a long, b long"
        )
        members = {
            end: self.sets.select(F.col("node").alias(end), F.col("members").alias(f"m{end}"))
            for end in "ab"
        }
        both = agreed.join(members["a"], "a").join(members["b"], "b")
        return both.select("a", "b", "ma", "mb").mapInArrow(
            _similar(self.percent), "a long, b long"
        )


def _components(links: DataFrame) -> DataFrame:
    """The component (its least node) of every linked node but that least one."""
    edges = links.select(F.lit("").alias(CONVERSATION), F.col("a").alias("src"), F.col("b").alias("dst"))
    return component_stars(edges).select(F.col("u").alias("node"), F.col("v").alias("label"))


def _led(posts: DataFrame) -> DataFrame:
    """Each list's leader ``a`` with every other member ``b``, distinct over all lists."""
    rank = F.struct(F.col("least").isNull(), "least", "node")
    leaders = posts.groupBy("token").agg(F.min(rank).alias("l"), F.count("*").alias("size"))
    leaders = materialise(leaders.filter("size > 1").select("token", F.col("l.node").alias("a")), "leaders")
    return posts.join(leaders, "token").filter("node <> a").select("a", F.col("node").alias("b")).distinct()


def _unlike(posts: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label`` of the members of lists that do not have one label.

    A label is a leader that the node is linked with, or that leader's own leader: always a member
    of the node's component, if not the same one throughout.
    """
    up = links.groupBy("b").agg(F.min("a").alias("above"))
    further = up.select(F.col("b").alias("above"), F.col("above").alias("top"))
    label = up.join(further, "above", "left").select(
        F.col("b").alias("node"), F.coalesce("top", "above").alias("label")
    )
    label = materialise(label, "labels")
    named = posts.select("token", "node").join(label, "node", "left").select(
        "token", "node", F.coalesce("label", "node").alias("label")
    )
    meeting = named.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    meeting = materialise(meeting.filter("x < y").select("token"), "meeting")
    unlike = named.join(meeting, "token", "left_semi")
    return materialise(unlike.select("node", "label").distinct(), "unlike")


def _pairs(rows: DataFrame, one: str, other: str) -> DataFrame:
    return rows.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The keys of two rows or more, with their number.

    Written, so that a join with it is dealt anew and its hot keys can be split.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("size"))
    return materialise(sizes.filter("size > 1"), "shared")


def _postings(classes: DataFrame, coordinates: int) -> DataFrame:
    """``token, node``: a class under each of its first coordinate-value pairs."""
    signature = F.slice("signature", 1, coordinates)
    each = classes.select("node", F.posexplode(signature).alias("c", "value"))
    return each.select("node", (F.col("c") * F.lit(1 << 32) + F.col("value")).alias("token"))


def _rest(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of unlike labels that may be similar, by a prefix join on full sets.

    Similar sets share ``percent`` of either one, hence one of the rarest members that a set may not
    do without. Members found in one set only are the rarest of all, and rule out most sets.
    """
    each = sets.join(nodes, "node").select("node", "label", F.size("members").alias("n"), F.explode("members").alias("h"))
    ranked = each.join(_shared(each, "h"), "h").groupBy("node", "label", "n").agg(
        F.array_sort(F.collect_list(F.struct("size", "h"))).alias("t")
    )
    needed = F.ceil(F.col("n") * percent / F.lit(100)).cast("int")
    ranked = ranked.withColumn("m", F.size("t")).filter(F.col("m") >= needed)
    prefix = ranked.select(
        "node", "label", "n", "m", F.posexplode(F.slice("t", F.lit(1), F.col("m") - needed + 1)).alias("i", "p")
    )
    # No more than `left` members can be shared if this is the first one that is.
    left = (F.col("m") - F.col("i")).alias("left")
    held = materialise(prefix.select("node", "label", "n", left, F.col("p.h").alias("h")), "prefix")
    # Within a list only those outside its largest label look for partners.
    sizes = held.groupBy("h", "label").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("h").agg(
        F.max(F.struct("size", "label")).alias("m"), F.count("*").alias("labels")
    )
    largest = materialise(largest.filter("labels > 1").select("h", F.col("m.label").alias("main")), "main")
    outside = held.join(largest, "h").filter("label <> main").drop("main")
    other = held.select(
        "h", *(F.col(c).alias(f"{c}_b") for c in ("node", "label", "n", "left"))
    )
    close = (F.col("label") != F.col("label_b")) & (
        F.least("left", "left_b") * (100 + percent) >= (F.col("n") + F.col("n_b")) * percent
    )
    return _pairs(outside.join(other, "h").filter(close), "node", "node_b")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    coordinates: int = COORDINATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept``, ``text_key``, the hash of the text, and ``group``.

    ``group`` tells components apart, also those without an id; it is null for a row without words.
    """
    matches = match_bound(percent, coordinates)
    text = F.col(text_col)
    texts = docs.select(
        F.col(id_col).alias("doc"), F.xxhash64(text).alias("key"), text.alias("text")
    )
    base = materialise(
        texts.mapInArrow(
            _signatures(shingle, coordinates),
            "doc long, key long, n long, k1 long, k2 long, signature array<int>",
        ),
        "signatures",
    )
    filled = base.filter("n > 0")
    same_set = ["k1", "k2"]
    least = filled.groupBy(*same_set).agg(F.min("doc").alias("least"))
    first = filled.dropDuplicates(same_set).join(least, same_set)
    classes = materialise(first.withColumn("node", F.monotonically_increasing_id()), "classes")

    # Documents that agree on `matches` coordinates agree on one of any `coordinates - matches + 1`.
    some = _postings(classes, coordinates - matches + 1)
    met = some.join(_shared(some, "token"), "token")
    met = classes.join(met.select("node").distinct(), "node", "left_semi")
    postings = _postings(materialise(met, "met"), coordinates)
    shared = postings.join(_shared(postings, "token"), "token").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("size", "token"))).alias("t")
    )
    prefix = shared.filter(F.size("t") >= matches).select(
        "node", F.explode(F.slice("t", F.lit(1), F.size("t") - (matches - 1))).alias("p")
    )
    posts = prefix.select(F.col("p.token").alias("token"), "node")
    posts = materialise(posts.join(classes.select("node", "least"), "node"), "posts")

    posted = materialise(classes.join(posts.select("node").distinct(), "node", "left_semi"), "posted")
    named = F.coalesce("doc", F.lit(0)).alias("id")
    chosen = posted.select("node", named, "key")
    wanted = texts.select(named, "key", "text").join(chosen, ["id", "key"]).dropDuplicates(["node"])
    members = wanted.select("node", "text").mapInArrow(_sets(shingle), "node long, members array<long>")
    sets = materialise(members, "sets")

    lookup = _Join(posted, sets, matches, percent)
    links = materialise(lookup.links(_led(posts)), "links")
    rest = _unlike(posts, links)
    if not rest.isEmpty():
        links = links.unionByName(lookup.links(_rest(rest, sets, percent)))
    stars = _components(links)

    named = classes.select("node", "least", *same_set).join(stars, "node", "left")
    named = named.withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    known = named.join(lowest, "label").select(*same_set, "component_id", F.col("label").alias("group"))
    rows = base.drop("signature").join(known, same_set, "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc"))
    rows = rows.select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("key").alias("text_key"),
        F.when(F.col("n") > 0, F.col("group")).alias("group"),
    )
    alone = F.col("component_id").isNull()
    return rows.withColumn(
        "kept", alone | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def one_of_each(found: DataFrame) -> DataFrame:
    """``doc_id, text_key`` of one row per component of :func:`near_duplicates`, and of each row without words.

    It is the row of the least id, then of the least hash of the text; rows with an id come first.
    """
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    first = found.filter("group is not null").groupBy("group").agg(F.min(rank).alias("m"))
    rest = found.filter("group is null").select("doc_id", "text_key")
    return first.select("m.doc_id", "m.text_key").unionByName(rest)
