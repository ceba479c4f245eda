"""Languages, licenses, packing, chat, vectors, urls and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter
from dataclasses import replace

import brute
import numpy as np
import public_tokenizers
import pytest
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from threadloom.llm import chat, langid, licenses, neighbours, packing, queries, urls

SF = "/root/testdata/sf0.01"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_forward_backward_is_that_of_whole_texts():
    rng = np.random.default_rng(0)
    k, first = 3, np.array([0, 0, 5, 5, 200, 201, 460])
    scores, transitions = rng.normal(size=(460, k)) * 2, rng.normal(size=(k, k))
    got, pairs = langid.marginals(scores, first, transitions, pairs=True)
    expected, joint = np.zeros_like(got), np.zeros((k, k))
    move = np.exp(transitions)
    for a, b in zip(first, first[1:], strict=False):
        emit, ahead, behind = np.exp(scores[a:b]), np.zeros((b - a, k)), np.ones((b - a, k))
        before = np.ones(k) / k
        for t in range(b - a):
            before = (before @ move) * emit[t]
            ahead[t] = before = before / before.sum()
        for t in range(b - a - 2, -1, -1):
            behind[t] = move @ (emit[t + 1] * behind[t + 1])
            behind[t] /= behind[t].sum()
        product = ahead * behind
        expected[a:b] = product / product.sum(axis=1, keepdims=True)
        for t in range(b - a):
            left = ahead[t - 1] if t else np.ones(k) / k
            pair = left[:, None] * move * (emit[t] * behind[t])[None]
            joint += pair / pair.sum()
    assert np.allclose(got, expected) and np.allclose(pairs, joint)


def test_language_of_held_out_texts(spark):
    got = queries.QUERIES["op2_language_id"](spark, SF)
    true = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.filter("held_out").join(true, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert got.count() == true.count()
    held = got.agg(F.avg(F.col("held_out").cast("int"))).first()[0]
    assert 0.2 < held < 0.3


def test_words_of_a_mixed_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, F.lit(True))
    part = {r.lang: r.text.split()[:60] for r in docs.filter("n_chars > 900").collect()}
    mixed = " ".join(part["en"] + part["fr"])
    rows = [(1, mixed), (2, None), (None, ""), (2, "12 ."), (3, "—"), (4, "日本")]
    found = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x"))
    got = {(r.doc_id, r.lang_pred): r for r in langid.identify(found, model).collect()}
    spans = [s for r in got.values() if r.doc_id == 1 for s in r.spans]
    label = [s.lang for s in spans for _ in range(s.end - s.begin)]
    truth = ["en"] * 60 + ["fr"] * 60
    assert sum(a == b for a, b in zip(label, truth, strict=True)) > 110
    unknown = [key for key in got if key[1] == langid.UNKNOWN]
    assert sorted(unknown, key=str) == [(2, "und"), (3, "und"), (None, "und")]
    untaught = langid.train(found.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.identify(found, untaught).collect()} == {"und"}


def test_languages_as_probable_go_by_name(spark):
    model = langid.Model.new(["aa", "bb", "cc", "dd"])
    texts = spark.createDataFrame([(1, "one"), (2, "one two three " * 3000)], "doc_id long, text string")
    got = langid.identify(texts, model).collect()
    assert [(r.lang_pred, round(r.score, 9), len(r.spans)) for r in got] == [("aa", 0.25, 1)] * 2
    assert {s.lang for r in got for s in r.spans} == {"aa"}


def test_licenses(spark):
    prose = " of the and onhe re" * 80
    texts = {
        1: "Foo. Licensed under CC BY-NC 4.0." + prose,
        2: prose + "\nThis work is licensed under the GNU General Public License, version 3.",
        3: "Licensed under the Apache License,\nVersion 2.0. Released under the MIT License.",
        4: "Released under the XYZ License." + prose,
        5: "license " * 3000,
        6: None,
        7: "",
    }
    rows = [*texts.items(), (None, texts[1]), (1, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(1))
    got = licenses.scan(docs)
    assert brute.rows_of(got, "doc_id", "license", "exact") == sorted(
        [
            (1, "CC-BY-NC-4.0", True), (1, "CC-BY-NC-4.0", True), (None, "CC-BY-NC-4.0", True),
            (2, "GPL-3.0", True), (3, "Apache-2.0", True), (3, "MIT", True),
        ],
        key=str,
    )
    for row in got.filter("doc_id is not null").collect():
        assert re.match("Licensed|Released|This work", texts[row.doc_id][row.begin :])
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_wording_differences():
    prepared, plain = licenses.prepare(licenses.TEMPLATES), zstandard.ZstdCompressor(level=9)
    long = licenses.TEMPLATES["Apache-2.0"][1]
    changed = long.replace("except in compliance", "except in accordance")
    (finding,) = licenses.findings(changed, prepared, plain)
    assert (finding.license, finding.missing, finding.extra) == ("Apache-2.0", ["compliance"], ["accordance"])
    rewritten = " ".join(w for i, w in enumerate(long.split()) if i % 3)
    assert not [f for f in licenses.findings(rewritten, prepared, plain) if f.begin == 0 and f.exact]


def plain_best(block, templates):
    """The license of the template that makes the block smallest, of those that any stretch confirms."""
    words = licenses._words(block)
    body = " ".join(words).encode()
    sized = []
    for t in templates:
        data = zstandard.ZstdCompressionDict(" ".join(t.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sized.append((len(zstandard.ZstdCompressor(level=9, dict_data=data).compress(body)), t.license, t))
    alone = len(zstandard.ZstdCompressor(level=9).compress(body))
    for size, name, t in sorted(sized, key=lambda x: x[:2]):
        spare = {w: words.count(w) for w in set(t.words)}
        if size >= alone or sum(max(0, n - spare[w]) for w, n in Counter(t.words).items()) > t.allowed:
            continue
        reach = len(t.words) + t.allowed
        if any(licenses._differences(t, words[at : at + reach]) for at in range(len(words))):
            return name
    return None


def test_licenses_of_whole_table_against_all_templates(spark):
    prepared, plain = licenses.prepare(licenses.TEMPLATES), zstandard.ZstdCompressor(level=9)
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null").select("doc_id", "text").collect()
    expected = set()
    for r in rows:
        for begin, end in licenses.blocks(r.text, prepared):
            if name := plain_best(r.text[begin:end], prepared):
                expected.add((r.doc_id, name))
    got = queries.QUERIES["op1_license_scan"](spark, SF).collect()
    assert expected and expected <= {(r.doc_id, r.license) for r in got}
    assert {r.doc_id for r in got} == {doc for doc, _ in expected}


def test_the_ranking_by_compression_decides():
    """Of templates whose wording a block confirms alike, the one that saves most is found."""
    prepared, plain = licenses.prepare(licenses.TEMPLATES), zstandard.ZstdCompressor(level=9)
    text = licenses.TEMPLATES["Apache-2.0"][1]
    body = " ".join(licenses._words(text)).encode()
    ranked = licenses.ranking(body, prepared, plain)
    assert ranked[0][1].words == tuple(licenses._words(text)) and len(ranked) > 20
    assert [s for s, _ in ranked] == sorted((s for s, _ in ranked), reverse=True)
    whole = licenses.best_template(text, prepared, plain)
    assert whole.end == len(text) and whole.exact

    class Blind:
        def compress(self, body):
            return b""

    blind = [replace(t, compressor=Blind()) for t in prepared]
    assert licenses.best_template(text, blind, Blind()) is None
    # The short notice is confirmed as well, and found if its compressor saves more.
    favoured = [replace(t, compressor=Blind()) if len(t.words) == 7 else t for t in prepared]
    short = licenses.best_template(text, favoured, plain)
    assert short.license == "Apache-2.0" and short.end < whole.end


def names(text, templates=licenses.TEMPLATES):
    found = licenses.findings(text, licenses.prepare(templates), zstandard.ZstdCompressor(level=9))
    return [(f.license, f.exact) for f in found]


def test_license_texts_of_any_length():
    draw = random.Random(1)
    words = ["".join(draw.choices("abcdefgh", k=draw.randrange(2, 9))) for _ in range(1200)]
    words[600] = "license"
    templates = {"Long": [" ".join(words)], **licenses.TEMPLATES}
    prose = " ".join(draw.choices(words, k=800)).replace("license", "")
    notice = licenses.TEMPLATES["MIT"][1]
    text = f"{prose} {'   '.join(words)} {prose} {notice} {prose}"
    assert names(text, templates) == [("Long", True), ("MIT", True)]
    changed = " ".join(w if i % 24 else "other" for i, w in enumerate(words, 6))
    assert names(f"{prose}\n{changed} {prose} {changed} {notice}", templates) == [("Long", False)] * 2 + [("MIT", True)]


def test_licenses_of_like_wording_are_told_apart():
    conditions = licenses._BSD_CONDITIONS
    end = licenses._BSD_END + " AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."
    for mark in ("{}. ", "{}) ", "* "):
        listed = [mark.format(i) + c for i, c in enumerate(conditions, 1)]
        for n in (2, 3):
            text = "Copyright (c) 2001, A. Body\n" + "\n".join([licenses._BSD, *listed[:n], end])
            assert [name for name, _ in names(text)] == [f"BSD-{n}-Clause"]
    assert names(licenses._BSD) == [("BSD-2-Clause OR BSD-3-Clause", True)]
    free = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
    by = " as published by the Free Software Foundation; "
    later = "either version {} of the License, or (at your option) any later version."
    for kind, name in (("General", "GPL"), ("Lesser General", "LGPL"), ("Affero General", "AGPL"), ("Library General", "LGPL")):
        for version in {"GPL": "23", "AGPL": "3", "LGPL": "3"}[name] if kind[:3] != "Lib" else "2":
            text = f"{free}{kind} Public License{by}"
            assert [n for n, _ in names(text + later.format(version))] == [f"{name}-{version}.0-or-later"]
            assert [n for n, _ in names(f"{text}version {version}.")] == [f"{name}-{version}.0"]
    assert names(f"{free}General Public License{by}{later.format(7)}") == []
    work = "This work is licensed under the GNU General Public License, version 2"
    assert names(work + ".") == [("GPL-2.0", True)]
    assert names(work + ", or (at your option) any later version.") == [("GPL-2.0-or-later", True)]
    moved = licenses.TEMPLATES["Apache-2.0"][1] + ".txt"
    assert names(moved) == [("Apache-2.0", False)]
    assert names(moved.replace("2.0", "1.1")) == []


def test_all_templates_are_compared():
    text = licenses.TEMPLATES["MIT"][1]
    templates = {f"A{i}": [f"{text} a{i} license of b{i}, c{i}, d{i}, e{i} and f{i}"] for i in range(30)}
    assert names(text, {**templates, "MIT": [text]}) == [("MIT", True)]


def test_every_template_is_found_in_its_own_text():
    for name, texts in licenses.TEMPLATES.items():
        assert [names(f"Of the {t} And so on. " * 3) for t in texts] == [[(name, True)] * 3] * len(texts)


def test_ids_are_those_of_the_tokenizer():
    odd = [
        "", None, " a  b\n", "It's don't. 'll we've...", "A.B,c 1.5 x2. é. É! İstanbul ΣΑΣ. Σ",
        "<|endoftext|> <|ENDOFTEXT|>x", "é. É K K", "a b\u0085c", "日本語。 ok.", "\x1c\x1d x\x1f",
        "!!! ?! a?! <|a", "¨.", "İ.", "²., ½.", "x'S. y'll. don't.", "a̸. ≮", "a" * 3000,
    ]
    plain = Tokenizer.from_file(WORDS)
    ids, counts = packing.Encoder(WORDS).ids(pa.array(odd))
    parts = [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]
    assert parts == [plain.encode(t or "", add_special_tokens=False).ids for t in odd]


def test_cuts_fill_classes():
    for total in [1, 2, 127, 128, 129, 1000, 2048, 3000, 4095, 4096, 4097, 9999, 50_000]:
        pieces = packing.cuts(total)
        assert [p[0] for p in pieces] == np.cumsum([0, *(p[1] for p in pieces[:-1])]).tolist()
        assert sum(p[1] for p in pieces) == total
        assert all(4096 // (k + 1) < length <= 4096 // k for _, length, k in pieces)


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, None), (None, ""), (5000, "x " * 30_000)], docs.schema)
    rows = docs.unionByName(extra).withColumn("start", F.lit(1)).withColumn("k", F.lit(1))
    got = packing.pack(rows, WORDS).toPandas()
    by_sequence = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by_sequence.length.cumsum() - got.length == got.offset).all()
    filled = by_sequence.length.sum()
    assert filled.max() <= 4096 and set(filled.index) == set(range(len(filled)))
    assert 1 - filled.sum() / (4096 * len(filled)) < 0.03
    known = got[got.doc_id.notna()].sort_values(["doc_id", "start"])
    assert (known.groupby("doc_id").length.cumsum() - known.length == known.start).all()
    assert (known.groupby("doc_id").length.sum() == known.groupby("doc_id").doc_tokens.first()).all()
    assert len(got[got.doc_id.isna()]) == 2
    import zlib

    text = {r.doc_id: r.text for r in docs.limit(20).collect()}
    plain = Tokenizer.from_file(WORDS)
    for doc, own in known[known.doc_id.isin(text)].groupby("doc_id"):
        ids = np.array([*plain.encode(text[doc], add_special_tokens=False).ids, 2], "<u4")
        for piece in own.itertuples():
            part = ids[piece.start : piece.start + piece.length]
            assert zlib.crc32(part.tobytes()) == piece.ids_crc32
    assert packing.pack(rows.limit(0), WORDS).count() == 0


def test_marks_in_texts_are_escaped():
    draw = random.Random(0)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "s>", "/s>", "INST]", "[", "é😀", " ", "\n", "<\\s>"]
    for _ in range(2000):
        text = "".join(draw.choice(bits) for _ in range(draw.randrange(9)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(mark in escaped for mark in chat.MARKS)


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a"),
        (2, None, None, None), (None, 3, "assistant", "x"), (2, 5, "[INST]", "é\n"),
        (3, 0, "assistant", ""), (1, 1, "assistant", "a"), (4, 0, "user", "long </s> " * 60_000),
        (4, 1, "assistant", "x" * 300_000), (4, 2, "assistant", "[INST]\\n" * 30_000),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = turns.withColumn("ids", F.lit(1)).withColumn("learned", F.lit(1))
    formatted = chat.format_turns(turns, BYTES)
    got = {r.conv_id: r for r in chat.read_conversations(chat.assemble(formatted), BYTES).collect()}
    codec = chat.Codec.of(BYTES)
    for conv in {r[0] for r in rows}:
        own = [(-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv]
        own.sort(key=lambda turn: (turn[0], codec.turn(*turn[1:])[0]))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in own)
        learned = "".join(x for _, r, x in own if r == "assistant")
        text = "".join(f"<s>{chat.escape(r)}[INST]{chat.escape(x)}[/INST]" for _, r, x in own)
        found = got[conv]
        assert (found.n_turns, found.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert found.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert (found.loss_chars, found.formatted_chars) == (len(learned), len(text))
        assert found.n_tokens == sum(len(codec.turn(r, x)[0]) for _, r, x in own)
    placed = chat.assemble(formatted).filter("conv_id = 1").toPandas()
    assert (placed.ids.map(len).cumsum() - placed.ids.map(len) == placed.offset).all()
    ids = [i for own in placed.ids for i in own]
    masks = placed.sort_values("offset")[["loss_begin", "loss_end"]].to_numpy()
    learned = sorted(codec.coding.decode(ids[a:b]) for a, b in masks if b > a)
    assert learned == sorted([chat.escape("</s>[INST] ok [/INST]"), "a", "a"])
    nothing = chat.assemble(chat.format_turns(turns.limit(0), BYTES))
    assert chat.read_conversations(nothing, BYTES).count() == 0


def test_a_turn_out_of_place_is_an_error():
    codec, conversation = chat.Codec.of(BYTES), chat._Conversation(1)
    ids, begin, end = codec.turn("assistant", "a text")
    conversation.add(codec, ids, 0, begin, end)
    with pytest.raises(ValueError):
        conversation.add(codec, ids, len(ids) + 1, begin, end)
    # what the mask marks is read at its places, not taken from the text
    conversation.add(codec, ids, len(ids), len(ids) + begin, len(ids) + end - 1)
    assert conversation.loss_chars < 2 * len("a text")


def _nearest(rows, k=20, step=20):
    usable = [
        (i, np.array(v, float))
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    matrix, ids = np.array([v for _, v in usable]), np.array([i for i, _ in usable])
    result = []
    for query in sorted({int(i) for i in ids if i % step == 0}):
        own = min((list(v) for i, v in usable if i == query))
        score = np.zeros(len(ids))
        for d, x in enumerate(own):
            score += x * matrix[:, d]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != query][:k]
        result += [(query, n + 1, int(ids[j]), float(score[j])) for n, j in enumerate(order)]
    return result


def test_nearest_vectors(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = brute.rows_of(queries.QUERIES["op5_nearest_vectors"](spark, SF), "query_id", "rank", "vec_id", "score")
    expected = _nearest([(r.vec_id, r.embedding) for r in vectors.collect()])
    assert len(got) == len(expected)
    found, true = ({(q, v) for q, _, v, _ in rows} for rows in (got, expected))
    assert len(found & true) / len(true) > 0.99


def test_nearest_over_groups_and_shards(spark, monkeypatch):
    """Queries of one task that meet a block in two parts, then several groups, each with several shards."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 64))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=64) / 3]) for i in range(2400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(9)
    true = {(q, v) for q, _, v, _ in _nearest(rows, 20, 4)}
    for group_bytes, shard_blocks in ((1 << 24, 32), (100_000, 2)):
        monkeypatch.setattr(neighbours, "GROUP_BYTES", group_bytes)
        monkeypatch.setattr(neighbours, "SHARD_BLOCKS", shard_blocks)
        got = neighbours.nearest(vectors, F.col("vec_id") % 4 == 0).collect()
        assert len(got) == len(true) == 600 * 20
        assert len({(r.query_id, r.vec_id) for r in got} & true) / len(true) > 0.99


def test_nearest_of_a_repeated_query_row(spark):
    rows = [(0, [1.0, 2.0])] * 15 + [(i, [1.0, 2.0]) for i in range(1, 61)] + [(70, [2.0, -1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = neighbours.nearest(vectors, F.col("vec_id") == 0)
    assert sorted({(r["rank"], r.vec_id) for r in got.collect()}) == [(i, i) for i in range(1, 21)]


def test_nearest_of_odd_vectors(spark):
    rows = [
        (None, [1.0, 2.0, 3.0]), (0, None), (20, [0.0, 0.0, 0.0]), (40, [1.0, None, 2.0]),
        (60, [1.0, float("nan"), 2.0]), (80, [1.0, 2.0]), (100, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0]),
        (120, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]),
        (3, [float("inf"), 1.0, 1.0]), (4, [-1.0, 0.0, 0.0]),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = vectors.withColumn("id", F.lit(1)).withColumn("v", F.lit(1))
    got = neighbours.nearest(vectors, F.col("vec_id") % 20 == 0)
    copies = [(i, [1.0, 2.0]) for i in range(60)] + [(60, [2.0, 2.0]), (61, [0.0, 1.0])]
    many = spark.createDataFrame(copies, "vec_id long, embedding array<double>")
    assert brute.rows_of(
        neighbours.nearest(many, F.col("vec_id") % 20 == 0), "query_id", "rank", "vec_id", "score"
    ) == sorted(_nearest(copies), key=str)
    kept = [r for r in rows if r[0] != 80]
    assert brute.rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(_nearest(kept), key=str)
    assert neighbours.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_error_bounds_choose_the_best():
    """Few vectors are ranked exactly, and the true best are among them."""
    rng = np.random.default_rng(2)
    dim, k = 64, 20
    vectors, asked = rng.normal(size=(2000, dim)), rng.normal(size=(40, dim))
    batch = pa.RecordBatch.from_pydict({"id": np.arange(2000), "v": list(vectors)})
    centre = vectors.mean(axis=0)
    (block,) = neighbours._encode(dim, centre, k)(iter([batch]))
    assert len(block.column("codes")[0].as_py()) == 2000 * dim // 8

    def read(name, kind):
        return np.frombuffer(block.column(name)[0].as_py(), kind)

    search = neighbours.Search(asked, np.arange(40) - 100, centre, k)
    search.meet(
        vectors, np.arange(2000), read("codes", "u1").reshape(-1, dim // 8),
        read("lengths", "<f8"), read("agreements", "<f8"),
    )
    assert search.ranked < 0.9 * 40 * 2000  # independent coordinates are the worst case
    query, found, _ = search.best
    true = np.argsort(-(asked @ vectors.T), axis=1)[:, :k]
    hits = sum(len(set(found[query == i]) & set(true[i])) for i in range(40))
    assert hits / (40 * k) > 0.98


def test_urls(spark):
    given = [
        None, "", "http://", "x://A.NET", "x://A.NET/", "http://example.net/en/",
        "https://É.Example.net/en/1?x", "a://b.example.com/de/5#x", "a://org/fr/", "a://xorg/fr/",
        "a://b//c/d/e/f/g", "://x.org/fr/\n1", "a://b?c://d.net/", "http://net/en",
    ]
    rows = [*enumerate(given), (None, "a://b/c"), (3, "a://b/c"), (3, "a://b/c")]
    rows += [(100 + i, f"http://h.com/item/x{'abcdefghij'[i % 10]}y/z") for i in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))

    def expected(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(brute.ASCII_LOWER)
        fits = [
            r.text for r in urls.RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)
        ]
        return host, path, max(fits, key=len, default=None)

    got = urls.judge(pages)
    assert brute.rows_of(got, "page_id", "host", "path", "rule") == sorted(
        ((i, *expected(u)) for i, u in rows), key=str
    )
    of_rule = {r.text: r.verdict for r in urls.RULES}
    assert all(r.verdict == of_rule[r.rule] for r in got.filter("rule is not null").collect())
    assert {r.template for r in got.filter("host = 'h.com'").collect()} == {"/item/*/z"}
    assert urls.judge(pages.limit(0)).count() == 0


def test_labelled_templates_are_rejected(spark):
    rules = tuple(urls.UrlRule("block", f"shop.com/offer/{i}") for i in range(1, 10))
    rows = [(i, f"http://shop.com/offer/{i}0.html") for i in range(1, 40)]
    rows += [(100 + i, f"http://shop.com/about/{i}") for i in range(5)]
    pages = spark.createDataFrame([*rows, (99, "http://shop.com/offer/0.html")], "page_id long, url string")
    verdict = {r.page_id: (r.verdict, r.rule) for r in urls.judge(pages, rules).collect()}
    assert verdict[99] == ("block", None)
    assert verdict[100] == ("allow", None)


def plain_templates(paths):
    """Templates of ``{(host, path): ruled}`` level by level, every path at every level of all."""
    split = {k: [s for s in k[1].split("/") if s] for k in paths}
    prefix = dict.fromkeys(paths, "")

    def lexical(segment):
        hexed = re.sub(r"[0-9a-f]{8,}(-[0-9a-f]{4,})*", "{h}", segment)
        return re.sub("[0-9]+", "{n}", hexed) if re.search("[0-9]", segment) else segment

    def form(segments, at):
        if at >= len(segments):
            return 0
        return 1 if re.fullmatch(r"[0-9]+(\.[a-z]+)?", segments[at]) else 2 if re.search("[0-9]", segments[at]) else 3

    def differ(one, other):
        """Twice the log of the likelihood ratio, by expected counts."""
        total = 0.0
        for a, b in ((one[:4], other[:4]), (one[4:], other[4:])):
            both = sum(a) + sum(b)
            for side in (a, b):
                total += sum(x * math.log(x * both / (sum(side) * (y + z))) for x, y, z in zip(side, a, b) if x)
        return round(2e6 * total)

    for depth in range(max(map(len, split.values()))):
        nodes = {}
        for key, segments in split.items():
            if depth < len(segments):
                node = nodes.setdefault((key[0], prefix[key]), {})
                node.setdefault(lexical(segments[depth]), []).append(key)
        for (_, before), branches in nodes.items():
            under = sum(map(len, branches.values()))
            wild = len(branches) >= urls.WILD_CHILDREN and len(branches) * 2 >= under
            counts, pools, cells = {}, {}, {}
            for child, keys in branches.items():
                forms = [form(split[k], depth + 1) for k in keys]
                bad, good = (sum(paths[k] == v for k in keys) for v in ("block", "allow"))
                counts[child] = [*(forms.count(f) for f in range(4)), bad, good]
                shares = [int(forms.count(f) * 4 / len(keys) + 0.5) for f in range(4)]
                rejects = int((bad + 1) / (bad + good + 4) > 0.5)
                cell = ",".join(map(str, (*shares, int((bad + 1) / (bad + good + 2) * 3), rejects)))
                cells[child] = cell
                if len(keys) >= urls.MERGE_PATHS:
                    pool = pools.setdefault(cell, [0] * 6)
                    pools[cell] = [x + y for x, y in zip(pool, counts[child])]
            leaders = []
            for cell in sorted(pools, key=lambda c: (-sum(pools[c][:4]), c)):
                if all(known[-1] != cell[-1] or differ(pools[cell], pools[known]) > urls.DIFFERENT for known in leaders):
                    leaders.append(cell)
            lead, least = {}, {}
            for child, keys in sorted(branches.items()):
                near = [(differ(counts[child], pools[c]), i) for i, c in enumerate(leaders) if c[-1] == cells[child][-1]]
                if len(keys) >= urls.MERGE_PATHS and near and min(near)[0] <= urls.DIFFERENT:
                    lead[child] = min(near)[1]
                    least.setdefault(lead[child], child)
            for child, keys in branches.items():
                merged = least[lead[child]] if child in lead else child
                for key in keys:
                    prefix[key] = before + "/" + ("*" if wild else merged)
    return prefix


def test_templates_of_deep_paths(spark):
    draw = random.Random(6)
    tops = [["a", "b", "7"], ["en", "de"], ["x", "y", "z"], ["p1", "q2"]]
    rows = {f"http://h{draw.randrange(2)}.com/" + "/".join(
        [draw.choice(tops[i % 4]) if draw.random() < 0.8 else str(draw.randrange(30)) + "w" * draw.randrange(9) for i in range(n)]
        + [draw.choice(["spam", "ok"])] + [str(draw.randrange(99))] * draw.randrange(2)
    ) for n in (draw.randrange(11) for _ in range(1500))}
    rows |= {f"http://h0.com/{'s/' * 12}{w}{'/t' * 3}/{n}" for w in "abcdefghijkl" for n in range(3)}
    rows |= {"http://h0.com/" + "/".join(map(str, range(300))), "http://h0.com", "http://h0.com//"}
    rules = tuple(urls.UrlRule(v, f"h{h}.com{t}") for h in (0, 1) for v, t in (("block", "/a/en/x"), ("allow", "/b")))
    pages = spark.createDataFrame(list(enumerate(sorted(rows))), "page_id long, url string")
    got = urls.judge(pages, rules).collect()
    paths = {(r.host, r.path): r.rule and {x.text: x.verdict for x in rules}[r.rule] for r in got}
    expected, labels = plain_templates(paths), {}
    assert len(got) == len(rows) and {(r.host, r.path): r.template for r in got} == expected
    for (host, path), ruled in paths.items():
        labels.setdefault((host, expected[host, path]), []).append(ruled)
    for r in got:
        of = labels[r.host, r.template]
        share = (of.count("block") + 1) / (of.count("block") + of.count("allow") + 4)
        assert r.verdict == (paths[r.host, r.path] or ("block" if share > 0.5 else "allow"))


def test_branches_are_merged_by_counts(spark):
    """Shares of one in eight and a little more are alike for 16 paths, and unlike 3,000 of other forms."""
    rows = [f"http://h.com/a/{i if i < 2 else 'w' + 'x' * i}" for i in range(16)]
    rows += [f"http://h.com/b/{i if i < 3 else 'w' + 'x' * i}" for i in range(18)]
    rows += [f"http://h.com/c/{i}" for i in range(3000)]
    rows += [f"http://big.com/{c}/{i if i % share == 0 else 'w' + 'x' * i}" for c, share in (("a", 2), ("b", 3)) for i in range(900)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    below = {(r.host, r.path.split("/")[1]): r.template.split("/")[1] for r in urls.judge(pages).collect()}
    assert {k: v for k, v in below.items() if k[0] == "h.com"} == {("h.com", "a"): "a", ("h.com", "b"): "a", ("h.com", "c"): "c"}
    assert (below["big.com", "a"], below["big.com", "b"]) == ("a", "b")


def test_branches_are_judged_apart_below_four_segments(spark):
    rules = tuple(urls.UrlRule("block", f"shop.com/a/b/c/d/spam/{i}") for i in range(1, 10))
    rows = [(i, f"http://shop.com/a/b/c/d/spam/{i}") for i in range(1, 40)]
    rows += [(99, "http://shop.com/a/b/c/d/spam/0"), (100, "http://shop.com/a/b/c/d/ok/7"), (101, "http://shop.com/a/b/c/d/ok")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    verdict = {r.page_id: r.verdict for r in urls.judge(pages, rules).collect()}
    assert (verdict[99], verdict[100], verdict[101]) == ("block", "allow", "allow")


def test_pipeline(spark, tmp_path):
    """Stage by stage against plain versions, each on its own input."""
    sample = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (7001, "1 2 3", "en", "s", 5), (7002, "", None, "s", 0)]
    copies = sample.limit(2)
    docs = sample.unionByName(copies).unionByName(spark.createDataFrame(odd, sample.schema))
    docs = docs.repartition(2)
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        kept[name] = (docs, spark.read.parquet(out))
        docs = kept[name][1]
    assert list(stages) == ["language", "near_duplicates", "decontamination", "secret_scan", "packing"]

    def pairs(frame):
        return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]

    before, after = map(pairs, kept["language"])
    assert sorted(after) == sorted(p for p in before if any(map(str.isalpha, p[1] or "")))
    before, after = map(pairs, kept["near_duplicates"])
    judged = brute.near_duplicates(before, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    assert sorted(d for d, _ in after) == sorted({d for d, _, _, own in judged if own})
    before, after = map(pairs, kept["decontamination"])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d, _, _, _, hit in brute.contamination(before, items, 10) if not hit}
    assert {d for d, _ in after} == clean
    from threadloom.llm import secrets

    before, after = map(pairs, kept["secret_scan"])
    assert sorted(after) == sorted((d, brute.masked(t, secrets.MORE_RULES)) for d, t in before)
    packed = kept["packing"][1].toPandas()
    assert set(packed.doc_id) == {d for d, _ in after}
    for name in list(stages)[:-1]:
        assert kept[name][1].columns == sample.columns


def test_pipeline_stages_on_odd_rows(spark):
    """No ids, one id for all, no languages, clashing columns, nothing at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"word{i} and" for i in range(60))
    near = [text + f" end{i}" for i in range(4)]
    other = "quite another text of some words that nothing else here is like"
    rows = [(None, t) for t in near] + [(5, t.upper()[:0] + "x " + t) for t in near[:1]] + [(None, other), (7, None), (8, "12"), (8, "")]
    rows += [(9, f"apart {other[::-1]} {i % 2}") for i in range(4)]
    docs = spark.createDataFrame([(d, t, None, "s", 1) for d, t in rows], schema)
    stages = dict(corpus_pipeline.STAGES)
    assert sorted(r.text for r in stages["language"](spark, docs, SF).collect()) == sorted(
        t for _, t in rows if t and any(map(str.isalpha, t))
    )
    kept = [(r.doc_id, r.text) for r in stages["near_duplicates"](spark, docs, SF).collect()]
    assert [d for d, t in kept if t and "word1 and" in t] == [5]
    assert sum(d == 9 for d, _ in kept) == 1 and {(None, other), (7, None), (8, "12"), (8, "")} <= set(kept)
    alone = docs.filter("doc_id is null")
    assert stages["near_duplicates"](spark, alone, SF).count() == 2
    names = ["id", "key", "none", "row", "doc", "gaps", "spans", "group", "_id", "_spans"]
    wide = docs.withColumns({c: F.lit("own") for c in names})
    for name in ("language", "near_duplicates", "decontamination", "secret_scan"):
        out = stages[name](spark, wide, SF)
        assert out.columns == wide.columns and out.filter(" or ".join(f"{c} <> 'own'" for c in names)).isEmpty()
        assert stages[name](spark, docs.limit(0), SF).isEmpty()
    assert stages["packing"](spark, docs.limit(0), SF).isEmpty()
