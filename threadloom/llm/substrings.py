"""Substring de-duplication by level-wise doubling.

A window of ``window`` words that also starts in a document of a smaller id is a repeat; every word
that a repeat covers goes. Windows are judged on the input, not on what is left.

Level 1 looks at a quarter of the window length. Only anchors are posted there: the leftmost minimal
hash of every window's quarter-length pieces, the same piece wherever the window occurs, so that no
repeat is missed while about one word in twenty is posted. Anchors found in one document only are
given up, and the others are extended to twice their length, to the right and to the left, one of
which lies within every window around them. Those found in two documents reach the last level, the
windows themselves. Windows around one anchor form a run. Runs of the same words are one class, and
only its first document is looked at word by word, so that thousands of copies cost one row each.

Defined results: a null text has no words. A document without an id is kept whole and removes
nothing. Rows with one id remove nothing from each other; each is judged by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import words
from threadloom.session import materialise

WINDOW = 50

_RUNS = "doc long, key long, run long, size int, h1 long, h2r long, h2l long, whole long"
_INDEX_BITS = 24


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from each place on, short of the last ``width - 1``."""
    best, reach = values, 1
    while reach * 2 <= width:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(best[: len(best) - rest], best[rest:]) if rest else best


def _levels(window: int) -> tuple[int, int]:
    short = max(1, window // 4 + (window % 4 > 0))
    return short, min(window, 2 * short)


def _chunk_runs(text: words.Texts, window: int) -> dict[str, np.ndarray]:
    """Runs of windows that share an anchor, with the hashes of every level."""
    short, double = _levels(window)
    hashes = words.Windows(text.hashes)
    starts, of = text.windows(window)
    width = window - short + 1
    n = len(text.hashes) - short + 1
    if not len(starts):
        return {}
    every = np.arange(n)
    pieces = hashes.at(every, every + short)
    # The place in the low bits makes the leftmost of equal pieces the smallest.
    places = every.astype(np.uint64)
    bits = np.uint64(max(_INDEX_BITS, n.bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    anchor = (_sliding_min((pieces & ~low) | places, width)[starts] & low).astype(np.int64)
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(starts)))
    first, at, row = starts[begin], anchor[begin], of[begin]
    floor, roof = text.first[row], text.first[row + 1]
    right = np.where(at + double <= roof, at + double, -1)
    left = np.where(at + short - double >= floor, at + short - double, -1)
    return {
        "row": row,
        "run": first - floor,
        "size": size,
        "h1": pieces[at],
        "h2r": np.where(right >= 0, hashes.at(at, np.maximum(right, at)), np.uint64(0)),
        "h2l": np.where(left >= 0, hashes.at(np.maximum(left, 0), at + short), np.uint64(0)),
        "whole": hashes.at(first, first + size + window - 1),
    }


def _runs(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["run", "size", "h1", "h2r", "h2l", "whole"]
        for batch in batches:
            doc, key = batch.column("doc"), batch.column("key")
            for base, text in words.chunks(batch.column("text"), lowered=False):
                found = _chunk_runs(text, window)
                if not found:
                    continue
                rows = pa.array(base + found["row"])
                columns = [words.signed(found[n]) for n in names]
                columns[1] = columns[1].cast(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [doc.take(rows), key.take(rows), *columns], ["doc", "key", *names]
                )

    return run


def _window_hashes(window: int):
    """The windows of chosen runs: ``runs`` lists first windows, ``sizes`` their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key = batch.column("doc"), batch.column("key")
            runs, sizes = batch.column("runs"), batch.column("sizes")
            for base, text in words.chunks(batch.column("text"), lowered=False):
                n = len(text.n_words)
                begin = runs.slice(base, n).flatten().to_numpy(zero_copy_only=False)
                size = sizes.slice(base, n).flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(n), runs.slice(base, n).value_lengths().to_numpy())
                each = np.repeat(np.arange(len(begin)), size)
                start = begin[each] + np.arange(len(each)) - (np.cumsum(size) - size)[each]
                at = start + text.first[row[each]]
                rows = pa.array(base + row[each])
                yield pa.RecordBatch.from_arrays(
                    [
                        doc.take(rows),
                        key.take(rows),
                        pa.array(start.astype(np.int64)),
                        words.signed(words.Windows(text.hashes).at(at, at + window)),
                    ],
                    ["doc", "key", "run", "hash"],
                )

    return run


def _in_two(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys found in documents of two ids or more, with the smallest id."""
    found = rows.groupBy(*keys).agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    return found.filter("least < most").drop("most")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))


def repeated_spans(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Word spans covered by repeats: ``doc, key, begin, end`` (end exclusive).

    ``key`` is the hash of the text, which tells rows of one id apart. Spans may overlap.
    """
    texts = _texts(docs, id_col, text_col).filter("doc is not null and text is not null")
    runs = materialise(texts.mapInArrow(_runs(window), _RUNS), "runs")
    twice = _in_two(runs.select("h1", "doc"), "h1").select("h1")
    runs = materialise(runs.join(twice, "h1", "left_semi"), "anchors")

    # The window around an anchor holds its extension to the right or the one to the left.
    sides = [(F.lit(n), F.col(c)) for n, c in enumerate(("h2r", "h2l"))]
    side = F.explode(F.array(*[F.struct(n.alias("side"), h.alias("h2")) for n, h in sides]))
    longer = runs.select("doc", "key", "run", side.alias("e")).select("doc", "key", "run", "e.*")
    longer = longer.filter("h2 <> 0")
    twice = _in_two(longer, "side", "h2").select("side", "h2")
    kept = longer.join(twice, ["side", "h2"], "left_semi").select("doc", "key", "run").distinct()
    runs = materialise(runs.drop("h2r", "h2l").join(kept, ["doc", "key", "run"]), "extended")

    same = ["h1", "whole", "size"]
    classes = runs.groupBy(*same).agg(F.min("doc").alias("least"))
    copies = runs.join(classes, same).filter("doc > least")
    by_copy = copies.select("doc", "key", "run", (F.col("run") + F.col("size") - 1).alias("last"))

    # Where all runs of an anchor are alike, nothing is left to compare.
    several = classes.groupBy("h1").count().filter("count > 1").select("h1")
    firsts = runs.join(classes.join(several, "h1", "left_semi"), same).filter("doc = least")
    chosen = firsts.groupBy("doc", "key").agg(F.collect_list(F.struct("run", "size")).alias("r"))
    chosen = chosen.select(
        "doc", "key", F.col("r.run").alias("runs"), F.col("r.size").alias("sizes")
    )
    wanted = texts.dropDuplicates(["doc", "key"]).join(chosen, ["doc", "key"])
    columns = "doc long, key long, run long, hash long"
    windows = materialise(wanted.mapInArrow(_window_hashes(window), columns), "windows")
    repeats = windows.join(_in_two(windows, "hash"), "hash").filter("doc > least")
    by_window = repeats.select("doc", "key", "run", F.col("run").alias("last"))
    spans = by_copy.unionByName(by_window)
    return spans.select(
        "doc", "key", F.col("run").alias("begin"), (F.col("last") + window).alias("end")
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        begins, ends = batch.column("begins"), batch.column("ends")
        kept: list[str] = []
        total: list[np.ndarray] = []
        gone: list[int] = []
        for base, text in words.chunks(batch.column("text"), lowered=False):
            data = text.data.tobytes()
            total.append(text.n_words)
            for i in range(len(text.n_words)):
                first, last = text.first[i], text.first[i + 1]
                hit = np.zeros(last - first + 1, dtype=np.int64)
                spans = begins[base + i].values
                if spans is not None and len(spans):
                    np.add.at(hit, spans.to_numpy(), 1)
                    np.add.at(hit, ends[base + i].values.to_numpy(), -1)
                left = np.flatnonzero(np.cumsum(hit[:-1]) == 0) + first
                gone.append(int(last - first - len(left)))
                spans = zip(text.starts[left].tolist(), text.ends[left].tolist(), strict=True)
                kept.append(b" ".join([data[a:b] for a, b in spans]).decode())
        counts = np.concatenate(total) if total else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(counts), pa.array(gone, pa.int64()), pa.array(kept)],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_removed, kept``, the words left in one string."""
    spans = repeated_spans(docs, window, id_col, text_col)
    grouped = spans.groupBy("doc", "key").agg(
        F.collect_list(F.struct("begin", "end")).alias("s")
    )
    grouped = grouped.select(
        "doc", "key", F.col("s.begin").alias("begins"), F.col("s.end").alias("ends")
    )
    rows = _texts(docs, id_col, text_col).join(grouped, ["doc", "key"], "left")
    schema = "doc_id long, n_words long, n_removed long, kept string"
    return rows.select("doc", "text", "begins", "ends").mapInArrow(_cut, schema)
