"""Harmonic packing of token sequences.

A document's tokens are cut into pieces, each of which has a class: class ``k`` holds lengths in
``(capacity / (k + 1), capacity / k]``, and ``k`` of its pieces fill a sequence. A rest is left whole
if it nearly reaches the largest length of its class, or is short; else the largest length of the
next class is cut off, which fills its share of a sequence exactly, and the remainder goes on. Three
pieces or so come from one document, and a sequence is full but for a few hundredths.

Pieces are numbered per class inside slices of bounded size, by worker; only slice sizes are added
up, so that a class leaves at most one sequence unfilled however many workers number it. These few
pieces, fewer than ``capacity * (1 + 1/2 + 1/3 + ...)``, are packed first-fit by decreasing length.

Defined results: a null text is an empty one, whose only token is the end token. Repeated rows are
packed as often as they occur.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import materialise_counting

CAPACITY = 4096
END_ID = 2
#: Lengths up to this part of a sequence are never cut.
SHORT_PART = 32
#: A rest is left whole if at most this part of its share would be padding.
SLACK_PART = 32
#: Pieces numbered by one task.
SLICE_PIECES = 200_000
#: Words that a worker remembers at most before it forgets those not met since it last did.
REMEMBERED = 200_000
#: Words given to the tokenizer at once; its results are large.
ENCODED_AT_ONCE = 4096
#: Bytes tokenised at once; a longer text is tokenised alone.
BATCH_BYTES = 4 << 20

_MARKS = tuple(".,;:!?")
_ENCODERS: dict[str, Encoder] = {}


def _stays_alone(character: str) -> bool:
    """Whether a mark behind this character is a token of its own.

    True of Latin letters and digits that normalising does not take apart.
    """
    return "" < character <= "\u024f" and character.isalnum() and len(character.lower()) == 1


class Encoder:
    """Ids of whole texts by a tokenizer that splits at blanks, with a memory of words.

    The tokenizer's own rules make words independent of each other and of ASCII case, so a word is
    encoded once. Texts that hold one of its added tokens are encoded as they are.
    """

    def __init__(self, path: str):
        # A task has one core, and threads that wait for work cost as much as those that work.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.marks = [token.content for token in added]
        #: Ids of the words met lately, and of those met before.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _encode(self, texts: list[str]) -> list[bytes]:
        encode, ids = self.tokenizer.encode_batch_fast, []
        for at in range(0, len(texts), ENCODED_AT_ONCE):
            found = encode(texts[at : at + ENCODED_AT_ONCE], add_special_tokens=False)
            ids += [array("I", e.ids).tobytes() for e in found]
        return ids

    def _words(self, asked: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        found = list(map(known.get, asked))
        fresh: dict[str, None] = {}
        marked, missing = [], []
        for i, ids in enumerate(found):
            if ids is not None:
                continue
            word = asked[i]
            if word in older:
                known[word] = found[i] = older[word]
                continue
            missing.append(i)
            if word.endswith(_MARKS) and _stays_alone(word[-2:-1]):
                marked.append(word)
                for part in (word[:-1], word[-1]):
                    if part in older:
                        known[part] = older[part]
                    elif part not in known:
                        fresh[part] = None
            else:
                fresh[word] = None
        known.update(zip(fresh, self._encode(list(fresh)), strict=True))
        for word in marked:
            known[word] = known[word[:-1]] + known[word[-1]]
        for i in missing:
            found[i] = known[asked[i]]
        return found

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        column = column.fill_null("")
        lowered = pc.ascii_lower(column)
        marked = np.zeros(len(column), dtype=bool)
        for mark in self.marks:
            holds = pc.match_substring(lowered, mark.lower())
            marked |= holds.to_numpy(zero_copy_only=False)
        usual = pc.if_else(pa.array(marked), "", lowered) if marked.any() else lowered
        lists = pc.ascii_split_whitespace(usual)
        coded = lists.flatten().dictionary_encode()
        distinct = self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, distinct), np.int64, len(distinct)) // 4
        pool = np.frombuffer(b"".join(distinct), "<u4")
        begin = np.cumsum(size) - size
        word = coded.indices.to_numpy()
        lengths = size[word]
        ends = np.cumsum(lengths)
        place = np.arange(lengths.sum()) + np.repeat(begin[word] - (ends - lengths), lengths)
        ids = pool[place]
        counts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(
            lists.value_lengths().to_numpy()
        )])]
        counts = np.diff(counts)
        if marked.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(marked):
                parts[i] = np.frombuffer(self._encode([column[i].as_py()])[0], "<u4")
            counts = np.array([len(p) for p in parts])
            ids = np.concatenate(parts)
        return ids, counts


def cuts(total: int, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """Start, length and class of the pieces of ``total`` tokens."""
    whole, rest = divmod(total, capacity)
    pieces = [(i * capacity, capacity, 1) for i in range(whole)]
    start = whole * capacity
    while rest:
        k = capacity // rest
        share = capacity // k
        if rest * SHORT_PART <= capacity or (share - rest) * SLACK_PART <= share:
            pieces.append((start, rest, k))
            break
        length = capacity // (k + 1)
        pieces.append((start, length, k + 1))
        start, rest = start + length, rest - length
    return pieces


def _pieces(path: str, capacity: int, end_id: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            text = batch.column("text")
            size = np.cumsum(pc.binary_length(text.fill_null("")).to_numpy())
            row = 0
            while row < batch.num_rows:
                before = size[row - 1] if row else 0
                end = max(row + 1, int(np.searchsorted(size, before + BATCH_BYTES, "right")))
                ids, counts = encoder.ids(text.slice(row, end - row))
                place, rows = 0, []
                for i, n in enumerate(counts.tolist()):
                    own = np.append(ids[place : place + n], [end_id]).astype("<u4").tobytes()
                    place += n
                    for start, length, k in cuts(n + 1, capacity):
                        crc = zlib.crc32(own[4 * start : 4 * (start + length)])
                        rows.append((row + i, start, length, crc, n + 1, k))
                columns = np.array(rows, dtype=np.int64).reshape(-1, 6).T
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(columns[0])), *map(pa.array, columns[1:])],
                    names,
                )
                row = end
        pa.default_memory_pool().release_unused()

    return run


def _first_fit(capacity: int):
    """Sequence and offset of the pieces left over, longest first."""

    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        order = ["length", "doc_id", "start", "ids_crc32"]
        pieces = pieces.sort_values(order, ascending=[False, True, True, True], kind="stable")
        room = np.zeros(0, dtype=np.int64)
        bins, offsets = [], []
        for length in pieces["length"].tolist():
            fits = np.flatnonzero(room >= length)
            if not len(fits):
                room = np.append(room, capacity)
            at = fits[0] if len(fits) else len(room) - 1
            bins.append(at)
            offsets.append(capacity - room[at])
            room[at] -= length
        return pieces.assign(bin=np.array(bins, np.int64), offset=np.array(offsets, np.int64))

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``; sequence ids are dense.
    ``tokenizer`` is the path of a tokenizer file that every executor can read.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k long"
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces, seen = materialise_counting(
        texts.mapInArrow(_pieces(tokenizer, capacity, end_id), schema), "pieces", n=F.count("*")
    )
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    slices = max(1, seen["n"] // SLICE_PIECES)
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(slices)))
    before = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy("k", "slice").agg(F.count("*").alias("size"))
    sizes = sizes.select("k", "slice", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("skipped"))
    # One row per class, at most one for each length up to the capacity.
    totals = {r["k"]: r["n"] for r in pieces.groupBy("k").agg(F.count("*").alias("n")).collect()}
    full, base = [], 0
    for k, n in sorted(totals.items()):
        full.append((k, n // k, base))
        base += n // k
    classes = F.broadcast(
        pieces.sparkSession.createDataFrame(full, "k long, bins long, base long")
    )
    within = Window.partitionBy("k", "slice").orderBy("doc_id", "start", "ids_crc32", "length")
    numbered = sliced.withColumn("i", F.row_number().over(within) - 1).join(sizes, ["k", "slice"])
    numbered = numbered.withColumn("bin", F.floor((F.col("i") + F.col("skipped")) / F.col("k")))
    numbered = numbered.join(classes, "k")
    inside = Window.partitionBy("sequence_id").orderBy("doc_id", "start", "ids_crc32", "length")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    filled = numbered.filter("bin < bins").withColumn("sequence_id", F.col("base") + F.col("bin"))
    filled = filled.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    last = numbered.filter("bin >= bins").select(*own)
    columns = ", ".join(f"{c} long" for c in [*own, "bin", "offset"])
    rest = last.groupBy(F.lit(0).alias("all")).applyInPandas(_first_fit(capacity), columns)
    rest = rest.withColumn("sequence_id", F.col("bin") + F.lit(base))
    result = [*own, "sequence_id", "offset"]
    return filled.select(*result).unionByName(rest.select(*result))
