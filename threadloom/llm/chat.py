"""Chat formatting by token-level assembly.

A turn is ``<s>role[INST]text[/INST]`` and its four marks are reserved ids beyond the vocabulary. Role
and text are encoded separately and spliced between them, so that no token spans a mark. Prefix sums
of the segments' lengths give the loss mask, the tokens of an assistant's text, and the place of each
turn in its conversation.

Strings in a role or text that read like a mark are escaped with a backslash behind their first
character; one that already has backslashes there gets one more, so that reading back takes away
exactly what was added. Other text is not changed.

Turns are encoded one by one wherever they lie. A conversation is then put in order by the shuffle's
sort, its turns are given their places, and it is read back as a stream, one turn at a time, whatever
its length or that of its texts, of which one is held.

Defined results: a null role or text is empty; a null turn comes first; turns of one number are in
the order of their ids. Rows that repeat are turns each. Rows without a conversation id form one conversation without an id.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Begin of a turn, end of the role, end of the text; the last is reserved for the end of all.
MARKS = ("<s>", "[INST]", "[/INST]", "</s>")
LEARNED_ROLE = "assistant"

_ESCAPE = re.compile(r"(?<=<)\\*(?=/?s>)|(?<=\[)\\*(?=/?INST\])")
_UNESCAPE = re.compile(r"(?<=<)\\(\\*)(?=/?s>)|(?<=\[)\\(\\*)(?=/?INST\])")
_LOADED: dict[str, Codec] = {}


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1] or m[2] or "", text)


class Codec:
    """A byte-level vocabulary with reserved ids for the marks."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            pairs = map(bytes.split, lines)
            ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.coding = tiktoken.Encoding(
            "chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.marks = [max(ranks.values()) + 1 + n for n in range(len(MARKS))]

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Ids of a turn, and where the tokens of its text begin and end."""
        begin, head, tail, _ = self.marks
        segments = [
            [begin],
            self.coding.encode_ordinary(escape(role)),
            [head],
            self.coding.encode_ordinary(escape(text)),
            [tail],
        ]
        ends = np.cumsum([len(s) for s in segments])
        return [i for s in segments for i in s], int(ends[2]), int(ends[3])

    def text(self, ids: list[int]) -> str:
        """The formatted text of ids, marks included."""
        first, parts, run = self.marks[0], [], []
        for i in ids:
            if i >= first:
                parts += [self.coding.decode(run), MARKS[i - first]]
                run = []
            else:
                run.append(i)
        return "".join([*parts, self.coding.decode(run)])


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            roles, texts = (batch.column(c).to_pylist() for c in ("role", "text"))
            turns = [codec.turn(r, t) for r, t in zip(roles, texts, strict=True)]
            learned = np.array([r == LEARNED_ROLE for r in roles], dtype=bool)
            begin = np.array([t[1] for t in turns], dtype=np.int64)
            end = np.where(learned, np.array([t[2] for t in turns], dtype=np.int64), begin)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    batch.column("turn"),
                    pa.array([t[0] for t in turns], pa.list_(pa.int32())),
                    pa.array(begin),
                    pa.array(end),
                ],
                ["conv_id", "turn", "ids", "loss_begin", "loss_end"],
            )

    return run


def format_turns(
    turns: DataFrame,
    vocabulary: str,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_id, turn, ids, loss_begin, loss_end``: the tokens of each turn, and those learned."""
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    schema = "conv_id long, turn long, ids array<int>, loss_begin long, loss_end long"
    return rows.mapInArrow(_encode(vocabulary), schema)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, place, started = None, 0, False
    for batch in batches:
        sizes = pa.compute.list_value_length(batch.column("ids")).to_pylist()
        offsets = []
        for own, size in zip(batch.column("conv_id").to_pylist(), sizes, strict=True):
            if not started or own != conv:
                conv, place, started = own, 0, True
            offsets.append(place)
            place += size
        offsets = pa.array(offsets, pa.int64())
        add = pa.compute.add
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("conv_id", "turn", "ids")),
                offsets,
                add(batch.column("loss_begin"), offsets),
                add(batch.column("loss_end"), offsets),
            ],
            ["conv_id", "turn", "ids", "offset", "loss_begin", "loss_end"],
        )


def assemble(formatted: DataFrame) -> DataFrame:
    """Turns in order with the place of their tokens, and of those learned, in the conversation."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "ids")
    schema = "conv_id long, turn long, ids array<int>, offset long, loss_begin long, loss_end long"
    return ordered.mapInArrow(_placed, schema)


class _Conversation:
    """What the placed tokens of one conversation say, turn by turn."""

    def __init__(self, conv: int | None):
        self.conv, self.n_turns, self.place = conv, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.loss_chars = self.formatted_chars = self.loss_spans = 0

    def add(self, codec: Codec, ids: list[int], offset: int, begin: int, end: int) -> None:
        """One turn, whose tokens begin at ``offset``; ``[begin, end)`` are the places learned."""
        head, tail = codec.marks[1], codec.marks[2]
        if offset != self.place or ids[0] != codec.marks[0] or ids[-1] != tail:
            raise ValueError("a turn out of place or without its marks")
        at, last = ids.index(head), len(ids) - 1
        role, text = codec.coding.decode(ids[1:at]), codec.coding.decode(ids[at + 1 : last])
        formatted = "".join([MARKS[0], role, MARKS[1], text, MARKS[2]])
        begin, end = begin - offset, end - offset
        learned = text if (begin, end) == (at + 1, last) else codec.text(ids[begin:end])
        learned = unescape(learned)
        self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        self.loss.update(learned.encode())
        self.n_turns += 1
        self.place += len(ids)
        self.loss_chars += len(learned)
        self.loss_spans += end > begin
        self.formatted_chars += len(formatted)

    def row(self) -> tuple:
        return (
            self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
            self.formatted_chars, self.place, self.loss_spans,
        )


_SUMMARY = {
    "conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
    "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "n_tokens": pa.int64(), "loss_spans": pa.int64(),
}


def _conversations(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, open_one, closed = Codec.of(path), None, []

        def given() -> pa.RecordBatch:
            columns = list(zip(*closed, strict=True))
            arrays = [pa.array(c, k) for c, k in zip(columns, _SUMMARY.values(), strict=True)]
            closed.clear()
            return pa.RecordBatch.from_arrays(arrays, list(_SUMMARY))

        for batch in batches:
            fields = ("conv_id", "ids", "offset", "loss_begin", "loss_end")
            for conv, *turn in zip(*(batch.column(c).to_pylist() for c in fields), strict=True):
                if open_one is None or open_one.conv != conv:
                    if open_one is not None:
                        closed.append(open_one.row())
                    open_one = _Conversation(conv)
                open_one.add(codec, *turn)
            if closed:
                yield given()
        if open_one is not None:
            closed.append(open_one.row())
            yield given()

    return run


def read_conversations(placed: DataFrame, vocabulary: str) -> DataFrame:
    """One row per conversation, read back from the tokens of :func:`assemble` in their order.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_spans``:
    digests of roles and texts, and of what the mask marks, unescaped.
    """
    kinds = {pa.int64(): "long", pa.string(): "string"}
    schema = ", ".join(f"{name} {kinds[kind]}" for name, kind in _SUMMARY.items())
    return placed.mapInArrow(_conversations(vocabulary), schema)
