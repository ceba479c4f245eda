"""Spelling variants of words by blocked Gram matrices of letter counts.

Words that differ by one inserted, deleted or replaced letter have letter counts whose squared
distance is one or two, and lengths that are equal or next to each other. Blocks hold the words of two
adjacent lengths; the products of a block's count vectors give all its squared distances at once, and
the pairs at the right distance are compared letter by letter.

A block of two lengths is halved before: of two near words either the first halves are equal or what
comes behind them, up to the one letter more. So every word goes into the block of its first half and
into that of its second half, and a block that still has more than :data:`BLOCK` words is halved again
inside the part that may differ, until two letters are left of that part, when the alphabet bounds the
block. A pair is counted in the one block whose open part holds its first difference. Blocks are dealt
out by key, and what they find is reduced to one row per word before it leaves the task.

Defined results: a null text has no words; a null id counts as the text "null" when letters are
deleted. Rows that repeat count each. Runs of any length are words. Only ``id_col`` and ``text_col``
are read, so that other columns don't matter; an empty table has no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import materialise

#: A run whose number this divides loses one letter.
SLIP = 97
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: Words of a block that is not halved again.
BLOCK = 1024
#: Rows and columns of a matrix of distances.
TILE = 256, 2048
#: Distinct words that a task counts before it passes the counts on.
HELD_WORDS = 200_000
#: Characters of a text looked at once.
TEXT_CHARS = 1 << 20

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")
#: Column of each letter in a count vector, by its code point.
_COLUMN = np.zeros(256, dtype=np.int64)
_COLUMN[97:123] = np.arange(26)
_COLUMN[192:256] = np.arange(26, 90)
_LETTERS = 90


# Words


def _stretches(text: str) -> Iterator[str]:
    """``text`` cut outside of runs into parts of :data:`TEXT_CHARS` or little more."""
    at = 0
    while len(text) - at > TEXT_CHARS:
        found = _NO_LETTER.search(text, at + TEXT_CHARS)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _count(least: int, slip: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        crc32, seen = zlib.crc32, total.get

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            lowered = pc.ascii_lower(batch.column("text"))
            for doc, text in zip(batch.column("doc"), lowered, strict=True):
                head = crc32(f"{doc.as_py()}:".encode())
                for part in _stretches(text.as_py() or ""):
                    for word, n in Counter(_RUN.findall(part)).items():
                        h = crc32(word.encode(), head)
                        if h % slip == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= least:
                            total[word] = seen(word, 0) + n
                    if len(total) > HELD_WORDS:
                        yield counted()
                        total.clear()
        yield counted()

    return run


def count_words(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    slip: int = SLIP,
) -> DataFrame:
    """``word, n``: words of the texts, some of which lose a letter, and how often they occur."""
    doc = F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("doc")
    parts = docs.select(doc, F.col(text_col).alias("text")).mapInArrow(
        _count(least_letters, slip), "word string, n long"
    )
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# Blocks


def _halved(rows: DataFrame) -> DataFrame:
    """Both halves of the open part ``[lo, hi)`` of each row; one of them is the same in near words."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(
        F.struct(middle.alias("lo"), F.col("hi").alias("hi")),
        F.struct(F.col("lo").alias("lo"), middle.alias("hi")),
    )
    each = rows.select("word", "n", "size", F.explode(halves).alias("open"))
    return each.select("word", "n", "size", "open.*")


def _keyed(rows: DataFrame) -> DataFrame:
    """``block``: the hash of what a row has outside of its open part."""
    left = F.substring("word", F.lit(1), F.col("lo"))
    behind = F.col("hi") + F.length("word") - F.col("size")
    right = F.substring("word", behind + 1, F.length("word"))
    return rows.withColumn("block", F.xxhash64("size", "lo", "hi", left, right))


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """``word, n, size, lo, hi, block``: every word in the blocks that may hold a near word.

    ``size`` is the smaller of a block's two lengths, ``[lo, hi)`` the part that may differ.
    """
    length = F.length("word")
    sizes = F.explode(F.array(length, length - 1)).alias("size")
    both = words.select("word", "n", sizes).select(
        "word", "n", "size", F.lit(0).alias("lo"), F.col("size").alias("hi")
    )
    # An open part of fewer letters in another half is smaller; this one takes every block.
    todo, done = _keyed(_halved(both)), None
    while True:
        todo = materialise(todo, "blocked")
        size = F.count("*").alias("rows")
        shorter = F.count_if(F.length("word") == F.col("size")).alias("shorter")
        counted = todo.groupBy("block", "hi", "lo").agg(size, shorter)
        counted = materialise(counted.filter("rows > 1 and shorter > 0"), "block-sizes")
        large = (F.col("rows") > most) & (F.col("hi") - F.col("lo") > 2)
        known = counted.select("block", large.alias("large"))
        rows = todo.join(known, "block")
        small = rows.filter("not large").drop("large")
        done = small if done is None else done.unionByName(small)
        if counted.filter(large).isEmpty():
            return done
        todo = _keyed(_halved(rows.filter("large").drop("large", "block")))


# Distances inside blocks


class _Block:
    """Words of one pair of lengths, of one or more blocks."""

    def __init__(self, words: list[str], size: int):
        self.size = size
        raw = np.array([w.encode("latin-1") for w in words], dtype=f"S{size + 1}")
        self.order = np.argsort(np.argsort(raw, kind="stable"), kind="stable")
        self.codes = raw.view(np.uint8).reshape(len(words), size + 1)
        self.longer = self.codes[:, size] > 0
        filled = self.codes > 0
        row = np.repeat(np.arange(len(words)), filled.sum(axis=1))
        cells = row * _LETTERS + _COLUMN[self.codes[filled]]
        counts = np.bincount(cells, minlength=len(words) * _LETTERS).reshape(-1, _LETTERS)
        # Products are exact: sums of squares below 2**24, or else below 2**53.
        self.counts = counts.astype(np.float32 if size < 4000 else np.float64)
        self.norms = (self.counts**2).sum(axis=1)

    def candidates(self, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a shorter word and another of its block at the right distance."""
        shorter = np.flatnonzero(~self.longer)
        wanted = np.where(self.longer, 1, 2)
        for at in range(0, len(shorter), TILE[0]):
            i = shorter[at : at + TILE[0]]
            # Rows are sorted by block: only what shares one with these rows is multiplied.
            first = np.searchsorted(block, block[i[0]])
            last = np.searchsorted(block, block[i[-1]], "right")
            for begin in range(first, last, TILE[1]):
                j = np.arange(begin, min(begin + TILE[1], last))
                product = self.counts[i] @ self.counts[j].T
                distance = self.norms[i][:, None] + self.norms[j][None] - 2 * product
                good = (distance == wanted[j]) & (block[i][:, None] == block[j][None])
                good &= self.longer[j][None] | (i[:, None] < j[None])
                a, b = np.nonzero(good)
                yield i[a], j[b]

    def near(self, a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether one edit makes ``a`` out of ``b``, its first place lying in the open part."""
        size = self.size
        left, right = self.codes[a, :size], self.codes[b]
        same = left == right[:, :size]
        first = np.where(same.all(axis=1), size, np.argmin(same, axis=1))
        replaced = same.sum(axis=1) == size - 1
        behind = left == right[:, 1:]
        after = np.arange(size)[None] >= first[:, None]
        inserted = (behind | ~after).all(axis=1)
        one = np.where(self.longer[b], inserted, replaced)
        return one & (lo[a] <= first) & ((first < hi[a]) | ((first == size) & (hi[a] == size)))


def _best(words: list[str], n: np.ndarray, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    """Per word that has near ones: their number and the one of largest ``n``."""
    of, other = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((rank[other], -n[other], of))
    of, other = of[order], other[order]
    word, first, size = np.unique(of, return_index=True, return_counts=True)
    best = other[first]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words[i] for i in word.tolist()], pa.string()),
            pa.array(size.astype(np.int64)),
            pa.array(n[best]),
            pa.array([words[i] for i in best.tolist()], pa.string()),
        ],
        ["word", "n_near", "best_n", "best"],
    )


def _judged(rows: pa.Table) -> pa.RecordBatch:
    """What the whole blocks in ``rows``, all of one ``size``, hold."""
    words = rows.column("word").to_numpy().tolist()
    n, lo, hi, block = (rows.column(c).to_numpy() for c in ("n", "lo", "hi", "block"))
    group = _Block(words, rows.column("size")[0].as_py())
    pairs = [np.zeros((2, 0), dtype=np.int64)]
    for a, b in group.candidates(block):
        good = group.near(a, b, lo, hi)
        pairs.append(np.stack([a[good], b[good]]))
    a, b = np.concatenate(pairs, axis=1)
    return _best(words, n, a, b, group.order)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``size`` and ``block``; whole blocks of one size are judged together."""
    kept: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        kept = new if kept is None else pa.concat_tables([kept, new])
        size, block = kept.column("size").to_numpy(), kept.column("block").to_numpy()
        ends = np.flatnonzero((size[1:] != size[:-1]) | (block[1:] != block[:-1])) + 1
        if len(ends):
            yield from _by_size(kept.slice(0, ends[-1]))
            kept = kept.slice(ends[-1])
    if kept is not None and kept.num_rows:
        yield from _by_size(kept)


def _by_size(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    size = rows.column("size").to_numpy()
    cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(size)]
    for begin, end in zip(cuts, cuts[1:], strict=False):
        yield _judged(rows.slice(begin, end - begin))


def near_words(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """``word, n_near, best_n, best`` of the words that have near ones, from distinct ``word, n``."""
    dealt = blocks(words, most).repartition("block").sortWithinPartitions("size", "block")
    found = dealt.mapInArrow(_compare, "word string, n_near long, best_n long, best string")
    # A word is in a bounded number of blocks; of equal numbers the least word is the best.
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("m")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("m.less")).alias("best_n"), F.col("m.best").alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the last of the forms that a word leads to.

    A form occurs at least twice as often as its word, so the number of rounds is the logarithm of
    that of the largest count.
    """
    known = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(
            known.join(further, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "roots",
        )
        known = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return known


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BLOCK) -> DataFrame:
    """Per word: ``word, form, root, n, n_near, form_n``."""
    words = materialise(count_words(docs, id_col, text_col), "words")
    near = near_words(words, most)
    common = F.col("best_n") >= 2 * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common, F.col("best")).alias("form"),
        F.when(common, F.col("best_n")).alias("form_n"),
    )
    judged = materialise(judged, "forms")
    last = roots(judged.filter("form is not null").select("word", "form"))
    return judged.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
