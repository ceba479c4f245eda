"""Token counts of whole texts by a byte-level BPE tokenizer, in Arrow batches that give lengths only.

The tokenizer first splits a text into runs, in which a blank may come first but never later, so that
it may be cut before a blank without any change of its tokens, unless that blank lies inside a longer
run of blanks. A batch is cut at all such places; equal pieces are encoded once, in one call, and each
text gets the sum of its pieces' lengths. No ids leave a task. A text with a run of blanks, or with
blanks outside ASCII, is cut by a stricter rule: before a blank that follows anything else.

Batches hold about :data:`BATCH_BYTES` of text. A longer text is cut into parts of that size at the
strict places, and a piece of more than :data:`PIECE_CHARS` without a blank at a change between
letters and digits, or behind a full stop or comma of Chinese or Japanese; one without any such place
is encoded whole.

Defined results: a null text is an empty one and has no tokens. Rows that repeat are counted each;
other columns of the input are not read, so that their names don't matter. Special strings inside a
text become what the tokenizer's file says, as by its default.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1024
#: Bytes of text counted at once; parts of longer texts are as long.
BATCH_BYTES = 4 << 20
#: Pieces up to this length are remembered; longer ones are cut once more.
REMEMBERED_CHARS, PIECE_CHARS = 64, 4096
#: Pieces remembered by a worker before it forgets those not met since it last did.
REMEMBERED = 600_000
#: Pieces given to the tokenizer at once; its results are large.
ENCODED_AT_ONCE = 4096

#: Blanks outside ASCII.
_WIDE_BLANKS = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A text in which a blank follows a blank and no word follows it, or with blanks outside ASCII,
#: or with the character that sets marks apart.
_ODD = f"[\t-\r ] ([\t-\r ]|$)|[{_WIDE_BLANKS}\\x00]"
#: A mark behind a letter, if a blank or nothing follows, is a run of its own.
_MARKED, _SET_APART = r"([A-Za-z])([.,;:!?])( |$)", "\\1 \0\\2\\3"
_STRICT = re.compile(f"(?<=[^\t-\r {_WIDE_BLANKS}])(?=[\t\n\r ])")
_INSIDE = re.compile(
    "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[\u3001\u3002\uff0c])(?=[\u4e00-\u9fff])"
)


def _parts(text: str, size: int) -> list[str]:
    """``text`` cut at strict places into parts of ``size`` characters or little more."""
    cuts, at = [0], size
    while at < len(text):
        found = _STRICT.search(text, at)
        if not found:
            break
        cuts.append(found.start())
        at = found.start() + size
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


class Lengths:
    """Numbers of tokens of pieces, with a memory of those met before."""

    _of: dict[str, Lengths] = {}

    def __init__(self, path: str):
        # A task has one core, and threads that wait for work cost as much as those that work.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> Lengths:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _encode(self, texts: list[str]) -> list[int]:
        encode, sizes = self.tokenizer.encode_batch_fast, []
        for at in range(0, len(texts), ENCODED_AT_ONCE):
            found = encode(texts[at : at + ENCODED_AT_ONCE], add_special_tokens=False)
            sizes += map(len, found)
        return sizes

    def _long(self, piece: str) -> int:
        if len(piece) <= PIECE_CHARS:
            return self._encode([piece])[0]
        inner = [x for part in _STRICT.split(piece) for x in _INSIDE.split(part)]
        return sum(self._encode(inner))

    def pieces(self, asked: list[str]) -> np.ndarray:
        """The number of tokens of each piece."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        found = list(map(known.get, asked))
        fresh: list[str] = []
        places: list[int] = []
        for i, size in enumerate(found):
            if size is not None:
                continue
            piece = asked[i]
            if len(piece) > REMEMBERED_CHARS:
                found[i] = self._long(piece)
            elif piece in older:
                known[piece] = found[i] = older[piece]
            else:
                fresh.append(piece)
                places.append(i)
        for i, piece, size in zip(places, fresh, self._encode(fresh), strict=True):
            known[piece] = found[i] = size
        return np.array(found, dtype=np.int64)

    def _plain(self, column: pa.Array) -> np.ndarray:
        """Tokens of texts that may be cut before every space."""
        apart = pc.replace_substring_regex(column, _MARKED, _SET_APART)
        lists = pc.split_pattern(apart, " ")
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        sizes = self.pieces([x[1:] if x[:1] == "\0" else " " + x for x in distinct])[index]
        ends = np.cumsum(lists.value_lengths().to_numpy())
        first = np.concatenate([[0], ends[:-1]])
        used, own = np.unique(index[first], return_inverse=True)
        sizes[first] = self.pieces([distinct[i] for i in used.tolist()])[own]
        return np.add.reduceat(sizes, first)

    def _odd(self, text: str) -> int:
        times = Counter(_STRICT.split(text))
        return int(self.pieces(list(times)) @ np.array(list(times.values())))

    def texts(self, column: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        if not len(column):
            return np.zeros(0, dtype=np.int64)
        odd = pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False)
        counts = self._plain(pc.if_else(pa.array(odd), "", column) if odd.any() else column)
        for i in np.flatnonzero(odd):
            counts[i] = self._odd(column[i].as_py())
        return counts

    def long_text(self, text: str, size: int = BATCH_BYTES) -> int:
        """The number of tokens of one text, part by part."""
        return sum(int(self.texts(pa.array([part]))[0]) for part in _parts(text, size))


def _counts(path: str, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths.of(path)
        for batch in batches:
            text = batch.column("text").fill_null("")
            size = pc.binary_length(text).to_numpy().astype(np.int64)
            ends = np.cumsum(size)
            tokens = np.zeros(batch.num_rows, dtype=np.int64)
            row = 0
            while row < batch.num_rows:
                before = ends[row] - size[row]
                end = max(row + 1, int(np.searchsorted(ends, before + batch_bytes, "right")))
                if size[row] > batch_bytes:
                    tokens[row] = lengths.long_text(text[row].as_py(), batch_bytes)
                else:
                    tokens[row:end] = lengths.texts(text.slice(row, end - row))
                row = end
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(tokens)],
                ["doc_id", "n_bytes", "n_tokens"],
            )
            pa.default_memory_pool().release_unused()

    return run


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can read, without a
    normaliser or a prefix space; others may not be cut before blanks.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(
        _counts(tokenizer, batch_bytes), f"doc_id {kind}, n_bytes long, n_tokens long"
    )
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
