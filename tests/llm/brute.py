"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
BENCHMARK_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows_of(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def repeats(rows, window):
    """doc_id, words, removed words, kept text."""
    first = {}
    split = [(doc, (text or "").encode().split()) for doc, text in rows]
    for doc, words in split:
        for i in range(len(words) - window + 1 if doc is not None else 0):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    result = []
    for doc, words in split:
        hit = [False] * len(words)
        for i in range(len(words) - window + 1 if doc is not None else 0):
            if first[tuple(words[i : i + window])] < doc:
                hit[i : i + window] = [True] * window
        kept = b" ".join(w for w, h in zip(words, hit, strict=True) if not h).decode()
        result.append((doc, len(words), sum(hit), kept))
    return sorted(result, key=str)


def near_duplicates(rows, k, percent):
    """doc_id, size of the set, component, kept."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        if len(words) >= k:
            sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)})
        else:
            sets.append({tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, own in enumerate(sets):
        shared = defaultdict(int)
        for shingle in own:
            for j in holders[shingle]:
                shared[j] += 1
            holders[shingle].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    result = []
    for i, (doc, _) in enumerate(rows):
        component = least.get(root(i)) if sets[i] else doc
        result.append((doc, len(sets[i]), component, component is None or doc == component))
    return sorted(result, key=str)


def benchmark_words(text):
    return BENCHMARK_WORD.findall((text or "").translate(ASCII_LOWER))


def contamination(rows, items, window):
    """doc_id, words, hit words, items, contaminated."""
    windows = defaultdict(set)
    for item, text in items:
        words = benchmark_words(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[i : i + size])].add(item)
    sizes = {len(key) for key in windows}
    result = []
    for doc, text in rows:
        words, hit, found = benchmark_words(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                key = tuple(words[i : i + size])
                if key in windows:
                    hit.update(range(i, i + size))
                    found |= windows[key]
        result.append((doc, len(words), len(hit), sorted(map(str, found - {None})), bool(hit)))
    return sorted(result, key=str)


SECRET_PATTERNS = [
    (
        "assign",
        re.compile(
            r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            re.ASCII,
        ),
        lambda m: len(m[2]) >= 6,
    ),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def secret_spans(text, more=()):
    patterns = [*SECRET_PATTERNS, *((r.kind, re.compile(r.pattern, re.ASCII), bool) for r in more)]
    return sorted(
        (m.start(), order, kind, m.end())
        for order, (kind, pattern, counts) in enumerate(patterns)
        for m in pattern.finditer(text or "")
        if counts(m)
    )


def masked(text, more=(), mask="[REDACTED]"):
    if text is None:
        return None
    out, done = "", 0
    for begin, _, _, end in secret_spans(text, more):
        if begin >= done:
            out += text[done:begin] + mask
        done = max(done, end)
    return out + text[done:]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()
