"""Token counts against the tokenizer on whole texts."""

import random

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from threadloom.llm import queries, tokens

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = [
    " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​", "᠎", "\0",
    "a", "It's", "'s", "'", "12", "Z9", "\xe9", "日本", "。", "!", ",", "<|endoftext|>", "\U0001f600", "_", "\xb2",
]


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_whole_table(spark, whole):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op11_token_counts"](spark, SF).collect()
    expected = [(r.doc_id, len((r.text or "").encode()), whole(r.text), whole(r.text) > 1024) for r in rows]
    assert sorted(map(tuple, got)) == sorted(expected)
    assert any(r.over_limit for r in got) and not all(r.over_limit for r in got)


@pytest.mark.parametrize("piece_chars, remembered_chars", [(4096, 64), (3, 2)])
def test_any_cut_keeps_the_tokens(whole, monkeypatch, piece_chars, remembered_chars):
    monkeypatch.setattr(tokens, "PIECE_CHARS", piece_chars)
    monkeypatch.setattr(tokens, "REMEMBERED_CHARS", remembered_chars)
    rng, lengths = random.Random(3), tokens.Lengths(PATH)
    texts = ["".join(rng.choices(BITS, k=rng.randrange(1, 14))) for _ in range(4000)]
    expected = [whole(text) for text in texts]
    assert lengths.texts(pa.array(texts)).tolist() == expected
    assert [lengths.long_text(text, 3) for text in texts] == expected


def test_memory_is_bounded(whole, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    lengths = tokens.Lengths(PATH)
    for at in range(40):
        text = f"alpha beta{at} gamma, delta{at % 3}."
        assert lengths.texts(pa.array([text])).tolist() == [whole(text)]
        assert len(lengths.known) <= 5 + 6


def test_edge_rows(spark, whole):
    long = "one two, " * 20_000 + "x" * 30_000 + "7y" * 9_000
    texts = [None, "", " ", "\n\n", "same", "same", long, "<|endoftext|> and <|endoftext|>"]
    rows = [(None if i == 4 else i % 6, t, 5, "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, n_bytes string")
    got = tokens.count_tokens(docs, PATH, batch_bytes=10_000)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    expected = [(r[0], len((r[1] or "").encode()), whole(r[1]), whole(r[1]) > 1024) for r in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    assert tokens.count_tokens(docs.limit(0), PATH).collect() == []
