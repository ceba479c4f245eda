"""Language of words and texts by a linear-chain conditional random field.

Each word is scored per language by its affixes, its byte trigrams and its entry in a learned
lexicon; neighbouring words are tied by learned transitions. Forward-backward gives every word the
probability of each language, given the whole text, so that switches of language inside a text are
found. A text gets the language with the largest mean probability over its words with letters; that
mean is the score.

The model is fitted on the driver on a sample of :data:`TRAIN_TEXTS` stretches per language, each of
at most :data:`STRETCH` characters of one labelled text. They are strung together in short runs, so
that transitions between languages are learned from text that does switch.

Texts are cut into blocks of words. The product of a block's transition matrices carries the chain
across it, so a long text needs no long loop; results are those of one pass over the whole text.

Defined results: the language of a null text, and of one without letters, is ``und``, its score 0.
Of languages that are as probable the first by name is taken, for words and texts alike. Without
labelled texts every text is ``und``. Rows of one id are judged by their own texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from threadloom.llm import words

UNKNOWN = "und"
#: Bounds of the sample that the model is fitted on: texts per language, characters of each.
TRAIN_TEXTS = 500
STRETCH = 600

_TRIGRAM_BITS, _AFFIX_BITS, _LEXICON_BITS = 17, 16, 17
_AFFIXES = ((3, True), (2, False), (3, False), (4, False))
_BLOCK = 64
_SEQUENCE = 60
_RUN = 20
_EPOCHS = 6
_BATCH = 128
_RATE = 0.3
_DECAY = 1e-6

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


@dataclass
class Features:
    """Places in the weight table: one per byte of a word, and some per word."""

    trigrams: np.ndarray
    first: np.ndarray
    of_word: np.ndarray


def features(text: words.Texts) -> Features:
    data = np.where(words.BLANK[text.data], np.uint8(32), text.data).astype(np.uint32)
    before, after = np.full_like(data, 32), np.full_like(data, 32)
    before[1:], after[:-1] = data[:-1], data[1:]
    filled = text.offsets[:-1] < text.offsets[1:]
    before[text.offsets[:-1][filled]] = 32
    after[text.offsets[1:][filled] - 1] = 32
    solid = data != 32
    mixed = (
        before[solid] * np.uint32(0x9E3779B1)
        + data[solid] * np.uint32(0x85EBCA77)
        + after[solid] * np.uint32(0xC2B2AE3D)
    )
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    sizes = text.ends - text.starts
    columns = []
    base = 1 << _TRIGRAM_BITS
    for salt, (n, at_start) in enumerate(_AFFIXES):
        begin = text.starts if at_start else np.maximum(text.ends - n, text.starts)
        end = np.minimum(text.starts + n, text.ends) if at_start else text.ends
        affix = words.mix(text.spans.at(begin, end) + np.uint64(salt + 1))
        columns.append(base + (affix >> np.uint64(64 - _AFFIX_BITS)).astype(np.int64))
    base += 1 << _AFFIX_BITS
    columns.append(base + (text.hashes >> np.uint64(64 - _LEXICON_BITS)).astype(np.int64))
    return Features(
        (mixed >> np.uint32(32 - _TRIGRAM_BITS)).astype(np.int64),
        np.cumsum(sizes) - sizes,
        np.stack(columns, axis=1),
    )


_TABLE = (1 << _TRIGRAM_BITS) + (1 << _AFFIX_BITS) + (1 << _LEXICON_BITS)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    @classmethod
    def new(cls, labels: list[str]) -> Model:
        n = len(labels)
        return cls(labels, np.zeros((_TABLE, n), np.float32), np.zeros((n, n)))

    def emissions(self, found: Features) -> np.ndarray:
        if not len(found.first):
            return np.zeros((0, len(self.labels)))
        scores = np.add.reduceat(self.weights[found.trigrams], found.first, axis=0)
        for column in found.of_word.T:
            scores += self.weights[column]
        return scores.astype(np.float64)


def _normal(x: np.ndarray) -> np.ndarray:
    axes = tuple(range(1, x.ndim))
    return x / np.maximum(x.sum(axis=axes, keepdims=True), 1e-300)


def marginals(
    scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, pairs: bool = False
) -> tuple[np.ndarray, np.ndarray | None]:
    """Probability of each label per word; with ``pairs``, expected transitions as well.

    ``scores`` are those of the words of all texts, ``first`` the first word of each text.
    """
    n, k = scores.shape
    step = np.exp(transitions - transitions.max())
    local = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60)) if n else scores
    size = np.diff(first)
    blocks = -(-size // _BLOCK)
    text = np.repeat(np.arange(len(size)), blocks)
    number = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[:-1][text] + number * _BLOCK
    length = np.minimum(size[text] - number * _BLOCK, _BLOCK)
    places = begin[:, None] + np.arange(_BLOCK)
    real = np.arange(_BLOCK) < length[:, None]
    psi = np.ones((len(text), _BLOCK, k))
    psi[real] = local[places[real]]

    across = np.broadcast_to(np.eye(k), (len(text), k, k)).copy()
    for t in range(_BLOCK):
        moved = (across.reshape(-1, k) @ step).reshape(-1, k, k) * psi[:, t, None, :]
        across = np.where(real[:, t, None, None], _normal(moved), across)
    # Into each block from the left, and from the right.
    ahead, behind = np.full((len(text), k), 1 / k), np.ones((len(text), k)) / k
    order = np.argsort(number, kind="stable")
    cuts = np.searchsorted(number[order], np.arange(1, blocks.max(initial=0)))
    for at in np.split(order, cuts)[1:]:
        ahead[at] = _normal(np.einsum("bi,bij->bj", ahead[at - 1], across[at - 1]))
    for at in reversed(np.split(order, cuts)[1:]):
        behind[at - 1] = _normal(np.einsum("bij,bj->bi", across[at], behind[at]))

    forward = np.empty_like(psi)
    carry = ahead
    for t in range(_BLOCK):
        moved = _normal((carry @ step) * psi[:, t])
        carry = np.where(real[:, t, None], moved, carry)
        forward[:, t] = carry
    backward = np.empty_like(psi)
    carry = behind
    for t in range(_BLOCK - 1, -1, -1):
        backward[:, t] = carry
        moved = _normal((psi[:, t] * carry) @ step.T)
        carry = np.where(real[:, t, None], moved, carry)
    result = np.empty_like(local)
    result[places[real]] = _normal((forward * backward)[real])
    if not pairs:
        return result, None
    left = np.concatenate([ahead[:, None], forward[:, :-1]], axis=1)[real]
    right = (psi * backward)[real]
    joint = left[:, :, None] * step * right[:, None, :]
    return result, _normal(joint).sum(axis=0)


def fit(labels: list[str], texts: list[tuple[str, str]], seed: int = 3) -> Model:
    """Fit by stochastic gradient ascent of the conditional likelihood; ``texts`` are (label, text)."""
    model = Model.new(labels)
    rng = np.random.Generator(np.random.PCG64(seed))
    by_label: list[list[list[str]]] = [[] for _ in labels]
    for label, text in texts:
        found = text.lower().split()
        for i in range(0, len(found), _RUN):
            by_label[labels.index(label)].append(found[i : i + _RUN])
    squares = np.full(model.weights.shape, 1e-2, np.float32)
    step_squares = np.full(model.transitions.shape, 1e-2)
    most = max((len(own) for own in by_label), default=0)
    for _ in range(_EPOCHS):
        # Every language the same number of runs.
        drawn = [
            own[i]
            for n, own in enumerate(by_label)
            if own
            for i in rng.permutation(np.resize(np.arange(len(own)), most))
        ]
        tags = [n for n, own in enumerate(by_label) if own for _ in range(most)]
        order = rng.permutation(len(drawn))
        sequences, current, own_tags = [], [], []
        for i in order:
            cut = drawn[i][: 1 + int(rng.integers(_RUN))] if rng.random() < 0.5 else drawn[i]
            current += cut
            own_tags += [tags[i]] * len(cut)
            if len(current) >= _SEQUENCE:
                sequences.append((" ".join(current), own_tags))
                current, own_tags = [], []
        for at in range(0, len(sequences), _BATCH):
            batch = sequences[at : at + _BATCH]
            _learn(model, batch, squares, step_squares)
    return model


def _learn(model: Model, batch, squares: np.ndarray, step_squares: np.ndarray) -> None:
    k = len(model.labels)
    truth = np.array([tag for _, tags in batch for tag in tags])
    data, offsets = words.string_buffers(pa.array([text for text, _ in batch]))
    text = words.Texts(data, offsets, lowered=True)
    found = features(text)
    scores = model.emissions(found)
    known, expected = marginals(scores, text.first, model.transitions, pairs=True)
    error = -known
    error[np.arange(len(truth)), truth] += 1
    sizes = np.diff(np.append(found.first, len(found.trigrams)))
    every = np.concatenate([found.trigrams, found.of_word.T.reshape(-1)])
    word = np.concatenate(
        [np.repeat(np.arange(len(truth)), sizes), np.tile(np.arange(len(truth)), found.of_word.shape[1])]
    )
    touched, inverse = np.unique(every, return_inverse=True)
    gradient = np.stack(
        [np.bincount(inverse, error[word, c], len(touched)) for c in range(k)], axis=1
    ).astype(np.float32)
    gradient -= _DECAY * len(batch) * model.weights[touched]
    squares[touched] += gradient**2
    model.weights[touched] += _RATE * gradient / np.sqrt(squares[touched])
    seen = np.zeros((k, k))
    inside = np.ones(len(truth), dtype=bool)
    inside[text.first[:-1]] = False
    np.add.at(seen, (truth[:-1][inside[1:]], truth[1:][inside[1:]]), 1)
    # The first word of a text follows a word of any language.
    np.add.at(seen, (slice(None), truth[text.first[:-1]]), 1 / k)
    change = seen - expected
    step_squares += change**2
    model.transitions += _RATE * change / np.sqrt(step_squares)


def training_sample(
    docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> list[tuple[str, str]]:
    """About :data:`TRAIN_TEXTS` stretches per language, chosen by the hash of id and text."""
    labelled = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    if not counts:
        return []
    rates = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, TRAIN_TEXTS / n)])
    draw = F.pmod(F.xxhash64(id_col, text_col), F.lit(1_000_000)) / 1e6
    room = F.greatest(F.length(text_col) - STRETCH, F.lit(0)) + 1
    start = F.pmod(F.xxhash64(text_col, id_col), room) + 1
    chosen = labelled.filter(draw < F.element_at(rates, F.col(lang_col))).select(
        F.col(lang_col), F.substring(F.col(text_col), start.cast("int"), F.lit(STRETCH))
    )
    return sorted((r[0], r[1]) for r in chosen.limit(2 * TRAIN_TEXTS * len(counts)).collect())


def _label(model: Model, rows: bool = False, text_col: str = "text"):
    """Predictions per text, with the runs of words, or with the whole row in ``row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
        names = pa.array([*model.labels, UNKNOWN])
        for batch in batches:
            column = pc.struct_field(batch.column("row"), text_col) if rows else batch.column("text")
            for base, stop in words.slices(column):
                n = stop - base
                text = words.texts(pc.utf8_lower(column.slice(base, n).fill_null("")), lowered=True)
                lettered = _LETTER[text.data]
                letters = np.add.reduceat(lettered, text.starts) > 0 if len(text.starts) else lettered[:0]
                odd = letters.copy()
                if len(odd):
                    plain = np.add.reduceat(lettered & (text.data < 128), text.starts) > 0
                    odd &= ~plain
                    for i in np.flatnonzero(odd):
                        span = text.data[text.starts[i] : text.ends[i]].tobytes().decode()
                        letters[i] = any(map(str.isalpha, span))
                scores = model.emissions(features(text))
                known, _ = marginals(scores, text.first, model.transitions)
                of = text.text_of_word()
                weight = letters.astype(np.float64)
                total = np.bincount(of, weight, n)
                share = np.stack(
                    [np.bincount(of, known[:, c] * weight, n) for c in range(len(model.labels))], axis=1
                ) / np.maximum(total, 1)[:, None]
                best = np.where(total > 0, share.argmax(axis=1), len(model.labels))
                score = np.where(total > 0, share.max(axis=1), 0.0)
                tag = known.argmax(axis=1)
                fresh = np.ones(len(tag), dtype=bool)
                fresh[1:] = (tag[1:] != tag[:-1]) | (of[1:] != of[:-1])
                begin = np.flatnonzero(fresh)
                floor = text.first[of[begin]]
                end = np.append(begin[1:], len(tag))
                spans = pa.StructArray.from_arrays(
                    [pa.array(begin - floor), pa.array(end - floor), names.take(pa.array(tag[begin]))],
                    fields=list(kind),
                )
                ends = np.concatenate([[0], np.cumsum(np.bincount(of[begin], minlength=n))])
                found = [names.take(pa.array(best)), pa.array(np.clip(score, 0.0, 1.0))]
                if rows:
                    own = batch.column("row").slice(base, n)
                    yield pa.RecordBatch.from_arrays([own, *found], ["row", "lang_pred", "score"])
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(base, n),
                        *found,
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), spans),
                    ],
                    ["doc_id", "lang_pred", "score", "spans"],
                )

    return run


def train(
    docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Model:
    """A model of the languages of the ``usable`` rows."""
    sample = training_sample(docs, usable, id_col, text_col, lang_col)
    return fit(sorted({label for label, _ in sample}), sample)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, lang_pred, score, spans``; ``spans`` are the runs of words of one language."""
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    if not model.labels:
        none = F.array().cast("array<struct<begin:long,end:long,lang:string>>")
        return texts.select(
            F.col("doc").alias("doc_id"),
            F.lit(UNKNOWN).alias("lang_pred"),
            F.lit(0.0).alias("score"),
            none.alias("spans"),
        )
    schema = "doc_id long, lang_pred string, score double, spans array<struct<begin:long,end:long,lang:string>>"
    return texts.mapInArrow(_label(model), schema)


def annotate(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row, lang_pred, score``: every row of ``docs`` as a struct, with its language."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    if not model.labels:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(_label(model, True, text_col), schema)
