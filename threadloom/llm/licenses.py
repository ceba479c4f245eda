"""License scans by conditional compression.

Words of license texts are cues; those near each other become a block, with as many words on both
sides as the longest template may reach from one of them. A block is compressed alone and with every
template as a raw zstandard dictionary, and templates are ranked by the bytes that they save. Down this
ranking they are confirmed by the differences in wording, the words of the template that a stretch of
the block lacks and those it has between them, of which few are allowed and none in numbers or words
that tell licenses apart. The first one that is confirmed is found, and the block searched again
without it.

Defined results: a null or empty text has no blocks. A text of any length is read block by block. Of
templates that save as much the first license by name is tried first. Repeated rows have the same findings each.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from difflib import SequenceMatcher
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:"
)
_BSD_CONDITIONS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions "
    "and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
    "and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission.",
)
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"'


def _bsd(clauses: int) -> list[str]:
    """The text up to its disclaimer, with and without numbers."""
    conditions = _BSD_CONDITIONS[:clauses]
    numbered = [f"{i}. {c}" for i, c in enumerate(conditions, 1)]
    return [" ".join([_BSD, *numbered, _BSD_END]), " ".join([_BSD, *conditions, _BSD_END])]


def _gnu(names: str, version: str) -> tuple[list[str], list[str]]:
    """The notices of one version, and those of it or any later version."""
    only, later = [], []
    by = "as published by the Free Software Foundation"
    for name in (f"{n}General Public License" for n in names.split(",")):
        work = f"This work is licensed under the GNU {name}, version {version}"
        only += [f"{work}."]
        later += [f"{work} or later.", f"{work}, or any later version.", f"{work}, or (at your option) any later version."]
        for this in ("program",) if names in ("", "Affero ") else ("library", "program"):
            free = f"This {this} is free software: you can redistribute it and/or modify it under the terms of the GNU {name}"
            only += [f"{free} version {version} {by}.", f"{free} {by}, version {version}."]
            later += [f"{free} {by}, either version {version} of the License, or (at your option) any later version."]
    return only, later


_GPL_2, _GPL_2_LATER = _gnu("", "2")
_GPL_3, _GPL_3_LATER = _gnu("", "3")
# before 2.1 it was the Library license, but is also cited as the Lesser one
_LGPL_20, _LGPL_20_LATER = _gnu("Library ,Lesser ", "2")
_LGPL_21, _LGPL_21_LATER = _gnu("Lesser ", "2.1")
_LGPL_3, _LGPL_3_LATER = _gnu("Lesser ", "3")
_AGPL_3, _AGPL_3_LATER = _gnu("Affero ", "3")

#: Published license names and notices, by SPDX identifier or expression.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "AGPL-3.0": _AGPL_3,
    "AGPL-3.0-or-later": _AGPL_3_LATER,
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", *_bsd(2)],
    # the sentence that both begin with, where the conditions behind it are not those of one of them
    "BSD-2-Clause OR BSD-3-Clause": [_BSD],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", *_bsd(3)],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
        "License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License.",
    ],
    "GPL-2.0": _GPL_2,
    "GPL-2.0-or-later": _GPL_2_LATER,
    "GPL-3.0": _GPL_3,
    "GPL-3.0-or-later": _GPL_3_LATER,
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ],
    "LGPL-2.0": _LGPL_20,
    "LGPL-2.0-or-later": _LGPL_20_LATER,
    "LGPL-2.1": _LGPL_21,
    "LGPL-2.1-or-later": _LGPL_21_LATER,
    "LGPL-3.0": _LGPL_3,
    "LGPL-3.0-or-later": _LGPL_3_LATER,
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
}

#: A text with one of these is looked at, around them.
CUES = "licen[sc]e|permission|redistribut|copyright|spdx"
#: Words that tell licenses apart, as numbers do: they are in a notice if they are in its template.
VARIANTS = frozenset(
    "affero lesser noncommercial nc sharealike sa noderivatives noderivs nd later only".split()
)
#: So much of a template's wording is the same: notices of fewer than ten words agree word for word.
MIN_SHARE = 0.9
#: Cues within so many characters, or within the reach of the templates, share a block.
NEAR = 500
_LEVEL = 9
_CUE = re.compile(CUES, re.IGNORECASE)
_KINDS = {
    "doc_id": pa.int64(),
    "license": pa.string(),
    "begin": pa.int64(),
    "end": pa.int64(),
    "reduction": pa.float64(),
    "exact": pa.bool_(),
    "missing": pa.list_(pa.string()),
    "extra": pa.list_(pa.string()),
}
_WORD = re.compile(r"\w+(?:[.-]\w+)*")
_NUMBER = re.compile(r"\d+(?:\.\d+)*")


@dataclass(frozen=True)
class _Template:
    license: str
    words: tuple[str, ...]
    compressor: object
    #: Bytes that the template as a dictionary saves on its own text.
    saves: int
    counts: Counter
    #: Differences in wording with which it is still confirmed.
    allowed: int


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def prepare(templates: dict[str, list[str]]) -> list[_Template]:
    prepared, plain = [], zstandard.ZstdCompressor(level=_LEVEL)
    for name, texts in templates.items():
        for text in texts:
            body = " ".join(_words(text)).encode()
            data = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            tool = zstandard.ZstdCompressor(level=_LEVEL, dict_data=data)
            saves = len(plain.compress(body)) - len(tool.compress(body))
            words = tuple(_words(text))
            allowed = int((1 - MIN_SHARE) * len(words) + 1e-9)
            prepared.append(_Template(name, words, tool, saves, Counter(words), allowed))
    return prepared


@dataclass
class Finding:
    license: str
    reduction: float
    missing: list[str]
    extra: list[str]
    begin: int
    end: int
    #: Bytes that the template saved.
    saved: int

    @property
    def exact(self) -> bool:
        return not self.missing and not self.extra


def _tells(words: list[str]) -> set[str]:
    """The numbers and the words that tell licenses apart; 2.0 is 2."""
    numbers = {re.sub(r"(\.0+)+$", "", n) for w in words for n in _NUMBER.findall(w)}
    return numbers | {part for w in words for part in re.split("[.-]", w) if part in VARIANTS}


def _differences(template: _Template, words: list[str]) -> tuple[list[str], list[str], int, int] | None:
    """Words of the template that are missing, words in between, and the stretch they lie in.

    The stretch is the one with the fewest differences of those that begin and end with a stretch in
    agreement. Null if there are too many of them, or if they tell licenses apart.
    """
    agreed = SequenceMatcher(None, template.words, words, autojunk=False).get_matching_blocks()[:-1]
    best, gain, begin = (0, 0, 0), 0, 0
    for i, block in enumerate(agreed):
        gap = block.b - agreed[i - 1].b - agreed[i - 1].size if i else 0
        begin, gain = (begin, gain - gap) if gain > gap else (i, 0)
        gain += block.size
        best = max(best, (gain, -begin, i + 1))
    gain, begin, end = best[0], -best[1], best[2]
    if len(template.words) - gain > template.allowed:
        return None
    agreed = agreed[begin:end]
    first, last = agreed[0].b, agreed[-1].b + agreed[-1].size
    held_t = {i for b in agreed for i in range(b.a, b.a + b.size)}
    held_w = {i for b in agreed for i in range(b.b, b.b + b.size)}
    missing = [w for i, w in enumerate(template.words) if i not in held_t]
    extra = [words[i] for i in range(first, last) if i not in held_w]
    # words at the ends may stand for others that are missing there
    lead, trail = agreed[0].a, len(template.words) - agreed[-1].a - agreed[-1].size
    instead = [*extra, *words[max(0, first - lead) : first], *words[last : last + trail]]
    if _tells(missing) - _tells(instead) or (_tells(extra) & VARIANTS) - _tells(missing):
        return None
    return missing, extra, first, last


def _lacks(template: _Template, counts: Counter) -> bool:
    """Whether words with these counts lack more of the template than may be missing."""
    return sum(max(0, n - counts[w]) for w, n in template.counts.items()) > template.allowed


def _confirmed(template: _Template, words: list[str], alike: SequenceMatcher) -> tuple | None:
    """The best :func:`_differences` of all stretches of the block, ``alike`` having its words.

    With so few differences, some run of words is in agreement that is no shorter than ``least``;
    around each such run there is one stretch, as long as the template may be.
    """
    size, allowed = len(template.words), template.allowed
    least = -(-(size - allowed) // (allowed + 1))
    waiting, found, tried = [(0, len(words))], [], set()
    alike.set_seq1(template.words)
    while waiting and least > 0:
        low, high = waiting.pop()
        a, b, run = alike.find_longest_match(0, size, low, high)
        if run < least:
            continue
        begin = max(0, b - a - allowed)
        around, first, last = words[begin : b - a + size + allowed], b, b + run
        differences = None
        if b - a not in tried and not _lacks(template, Counter(around)):
            differences = _differences(template, around)
        tried.add(b - a)
        if differences:
            missing, extra, first, last = differences
            first, last = begin + first, begin + last
            found.append((len(missing) + len(extra), first, last, missing, extra))
        waiting += [(low, min(first, b)), (max(last, b + run), high)]
    return min(found, key=lambda f: f[:3]) if found else None


def ranking(body: bytes, templates: list[_Template], plain) -> list[tuple[int, _Template]]:
    """Bytes that each template saves as the dictionary of ``body``, most first; those that save none are left out.

    Ties are in the order of the licenses.
    """
    alone = len(plain.compress(body))
    saved = [(alone - len(t.compressor.compress(body)), t) for t in templates]
    return sorted((s for s in saved if s[0] > 0), key=lambda s: (-s[0], s[1].license))


def best_template(block: str, templates: list[_Template], plain) -> Finding | None:
    """The template that saves most of those whose wording confirms it."""
    found = list(_WORD.finditer(block))
    words = [m[0].lower() for m in found]
    counts, alike = Counter(words), None
    for saved, template in ranking(" ".join(words).encode(), templates, plain):
        if _lacks(template, counts):
            continue
        if alike is None:
            alike = SequenceMatcher(None, (), words, autojunk=False)
        if best := _confirmed(template, words, alike):
            _, first, last, missing, extra = best
            span = found[first].start(), found[last - 1].end()
            return Finding(template.license, saved / template.saves, missing, extra, *span, saved)
    return None


def _back(text: str, at: int, words: int) -> int:
    """Where the last ``words`` words before ``at`` begin."""
    step = 8 * words
    while True:
        begin = max(0, at - step)
        starts = [m.start() for m in _WORD.finditer(text, begin, at)]
        # the first one may be cut
        if begin == 0 or len(starts) > words:
            return starts[-words] if len(starts) >= words else 0
        step *= 2


def _ahead(text: str, at: int, words: int) -> int:
    """Where the first ``words`` words behind ``at`` end."""
    last = next(islice(_WORD.finditer(text, at), words - 1, None), None)
    return last.end() if last else len(text)


def blocks(text: str, templates: list[_Template]) -> Iterator[tuple[int, int]]:
    """Stretches around cues, so that a notice with one of the cues is in it whole. They may overlap."""
    # a word that a cue is part of counts on both sides
    reach = max((len(t.words) + t.allowed for t in templates), default=0) + 1
    cues = [m.span() for m in _CUE.finditer(text)]
    at = 0
    while at < len(cues):
        begin, end = cues[at]
        first = _back(text, begin, reach)
        limit = begin + max(NEAR, _ahead(text, end, reach) - first)
        while at < len(cues) and cues[at][1] <= max(limit, end):
            end = cues[at][1]
            at += 1
        yield first, _ahead(text, end, reach)


def findings(text: str, templates: list[_Template], plain) -> list[Finding]:
    """All notices of a text; one that is found is blanked before the next is looked for.

    Of findings that overlap, since a block may end within a notice, the one that saved most stays.
    """
    found: list[Finding] = []
    for begin, end in blocks(text, templates):
        block = text[begin:end]
        while _CUE.search(block) and (best := best_template(block, templates, plain)):
            block = block[: best.begin] + " " * (best.end - best.begin) + block[best.end :]
            found.append(replace(best, begin=best.begin + begin, end=best.end + begin))
    found.sort(key=lambda f: (-f.saved, f.begin, f.end))
    kept: list[Finding] = []
    for finding in found:
        at = bisect(kept, finding.begin, key=lambda f: f.begin)
        if (at == 0 or kept[at - 1].end <= finding.begin) and (at == len(kept) or finding.end <= kept[at].begin):
            kept.insert(at, finding)
    return kept


def _scan(templates: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared, plain = prepare(templates), zstandard.ZstdCompressor(level=_LEVEL)
        for batch in batches:
            rows = [
                (doc, f.license, f.begin, f.end, f.reduction, f.exact, f.missing, f.extra)
                for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for f in findings(text, prepared, plain)
            ]
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, _KINDS.values(), strict=True)], list(_KINDS)
                )

    return run


def scan(
    docs: DataFrame,
    templates: dict[str, list[str]] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per notice: ``doc_id, license, begin, end, reduction, exact, missing, extra``.

    Offsets are characters; ``missing`` and ``extra`` are the differences from the template's words.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cued = texts.filter(F.col("text").rlike(f"(?i){CUES}"))
    schema = (
        "doc_id long, license string, begin long, end long, reduction double, exact boolean, "
        "missing array<string>, extra array<string>"
    )
    return cued.mapInArrow(_scan(templates), schema)
