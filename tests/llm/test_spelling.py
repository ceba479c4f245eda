"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

import brute
from threadloom.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.ASCII_LOWER)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return judged({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})


def judged(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(
        (str((w, form.get(w), root(w), words[w], len(near[w]), words[form[w]] if w in form else None)) for w in words)
    )


def shown(frame):
    return sorted(str(tuple(r)) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("most", [1, 8, 4096])
def test_texts(spark, most):
    rng = random.Random(most)
    bases = ["".join(rng.choices("abeéß", k=rng.randrange(4, 9))) for _ in range(60)]
    rows = []
    for doc in range(60):
        words = []
        for _ in range(120):
            w = rng.choice(bases[: 1 + int(60 * rng.random() ** 2)])
            at = rng.randrange(len(w) + 1)
            edits = [w, w.upper(), w[:at] + rng.choice("abe") + w[at:], w[:at] + w[at + 1 :], w[:at] + "b" + w[at + 1 :]]
            words.append(rng.choice(edits))
        rows.append((doc if doc % 9 else None, " ".join(words)))
    rows += [(7, None), (8, ""), (8, "12 日本"), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    got, expected = shown(spelling.variants(docs, most=most)), plain(rows)
    assert got == expected and sum("None, '" not in x for x in expected) > 20


def test_a_chain_of_forms_and_ties(spark):
    chain = {"aaaaa" + "b" * i: 3 * 2**i for i in range(9)}
    ties = {"zzzzza": 9, "zzzzzb": 9, "zzzzzc": 4, "xyxyxy": 3}
    words = chain | ties
    text = " ".join(w for w, n in words.items() for _ in range(n))
    docs = spark.createDataFrame([(i, part) for i, part in enumerate([text])], "doc_id long, text string")
    found = spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"))
    best = {r.word: (r.n_near, r.best_n, r.best) for r in found.collect()}
    assert best["zzzzzc"] == (2, 9, "zzzzza") and best["zzzzza"] == (2, 9, "zzzzzb") and "xyxyxy" not in best
    counted = spelling.count_words(docs, slip=1 << 40).collect()
    assert {r.word: r.n for r in counted} == words
    forms = [(w, v) for w, v in zip(chain, list(chain)[1:], strict=False)]
    ends = spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()
    assert {r.root for r in ends} == {"aaaaa" + "b" * 8} and len(ends) == 8


def test_one_block_of_many_words(spark):
    """Words that share nearly everything: halving goes on inside the open part."""
    rng = random.Random(5)
    words = {"prefix" + "".join(rng.choices("abcdefgh", k=4)) + "suffix": rng.randrange(3, 99) for _ in range(900)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    found = spelling.near_words(frame, most=50).collect()
    expected = {}
    for w in words:
        near = [v for v in words if one_edit(w, v)]
        if near:
            best = min(near, key=lambda v: (-words[v], v))
            expected[w] = (len(near), words[best], best)
    assert {r.word: (r.n_near, r.best_n, r.best) for r in found} == expected
    largest = spelling.blocks(frame, most=50).groupBy("block").count().agg({"count": "max"}).first()[0]
    assert largest <= 64 + 512


def test_long_runs_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TEXT_CHARS", 100)
    long = "x" * 9_000
    rows = [(1, f"{long} {long} {long}y {long}y {long}y {long}, Alpha alpha ALPHA" + " beta" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert shown(spelling.variants(docs)) == plain(rows)
    assert spelling.variants(docs.limit(0)).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == []
