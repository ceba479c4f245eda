"""Text and identifier scalars, all native columns."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: patterns and formats that decide the results ---
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
MENTION = r"(?U)@\w+"
LINK = r"https?://[A-Za-z0-9./]+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MIN_TOKEN_LENGTH = 4
WORD = r"(?U)[\w&&[^\d]]+"
WORD_LENGTHS = (2, 15)
# --- end of fixed values ---

# a word goes to the next whitespace; its token, from its first to its last character that is no punctuation.
# Characters are listed one by one, which the matcher looks up in one table; ranges are tried one after the other.
_EDGE = "".join(f"\\{c}" for c in PUNCTUATION)
_SPACE = r"\p{IsWhite_Space}\x1c\x1d\x1e\x1f"
_INSIDE, _END = f"[^{_SPACE}]", f"[^{_SPACE}{_EDGE}]"
CLASSIFIER_TOKEN = (
    f"{_END}{_INSIDE * (MIN_TOKEN_LENGTH - 3)}{_INSIDE}+{_END}|[{_EDGE}]{{{MIN_TOKEN_LENGTH},}}"
)


def stop_words(language: str) -> list[str]:
    """The stop-word list that Spark ships for a language."""
    return StopWordsRemover.loadDefaultStopWords(language)


def clean_whitespace(text: Column) -> Column:
    """Collapse every run of Unicode whitespace to one space and trim."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def assemble_text(title: Column, selftext: Column, body: Column) -> Column:
    """Title, a space, then the self text, else the body, else nothing."""
    empty = F.lit("")
    return F.concat(F.coalesce(title, empty), F.lit(" "), F.coalesce(selftext, body, empty))


def strip_id_prefix(identifier: Column) -> Column:
    """``t1_abc`` to ``abc``."""
    return F.substring_index(identifier, "_", -1)


def thread_path(permalink: Column) -> Column:
    """A permalink without its last two path pieces."""
    pieces = F.split(permalink, "/")
    return F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 2, F.lit(0))), "/")


def key_before(name: Column, mark: str) -> Column:
    """The part of a file name before the first ``mark``."""
    return F.substring_index(base_name(name), mark, 1)


def key_after_last(name: Column, mark: str = "_") -> Column:
    """The part of a file's stem after the last ``mark``."""
    return F.substring_index(key_before(name, "."), mark, -1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def epoch_iso(seconds: Column) -> Column:
    """Epoch seconds to ``yyyy-MM-ddTHH:mm:ss.000Z``, whatever the session time zone."""
    whole = F.floor(seconds).cast("long")
    of_day = F.pmod(whole, F.lit(86400))
    day = F.date_add(F.lit("1970-01-01").cast("date"), ((whole - of_day) / 86400).cast("int"))
    clock = [
        F.lpad(F.floor(part).cast("string"), 2, "0")
        for part in (of_day / 3600, of_day % 3600 / 60, of_day % 60)
    ]
    return F.concat(day.cast("string"), F.lit("T"), F.concat_ws(":", *clock), F.lit(".000Z"))


def epoch_seconds(ts: Column) -> Column:
    """Epoch seconds of a zone-less timestamp, whatever the session time zone."""
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def last_reference(references: Column, kind: str) -> Column:
    """Id of the last reference of a kind, null when there is none."""
    matching = F.filter(references, lambda r: r["type"] == kind)
    return F.try_element_at(matching, F.lit(-1))["id"]


def classifier_tokens(text: Column, stop: Iterable[str]) -> Column:
    """Tokens kept for the classifier.

    Lower-case, without mentions and links, cut at the punctuation around
    words, without stop words, punctuation and tokens of three characters or
    fewer. Punctuation around a word is a token of its own, unless it is a
    piece of the list of punctuation. One rule for texts of any length, and no
    limit; a text is gone through once for its tokens.
    """
    bare = F.regexp_replace(F.lower(text), MENTION, "")
    unlinked = F.regexp_replace(bare, LINK, " ")
    found = F.regexp_extract_all(unlinked, F.lit(CLASSIFIER_TOKEN), F.lit(0))
    stop = list(stop)
    return F.filter(found, lambda token: ~token.isin(stop) & ~F.contains(F.lit(PUNCTUATION), token))


def normalize_text(text: Column, stop: Iterable[str]) -> Column:
    """The classifier's clean text."""
    return F.array_join(classifier_tokens(text, stop), " ")


def _accent_table() -> tuple[str, str]:
    """Every character whose decomposition is one ASCII letter plus marks, and that letter."""
    plain = {}
    for code in range(0xC0, sys.maxunicode + 1 if sys.maxunicode < 0x2000 else 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(c) for c in parts[1:]):
            plain[chr(code)] = parts[0]
    return "".join(plain), "".join(plain.values())


def strip_accents(text: Column) -> Column:
    """Replace accented Latin letters by their base letter and drop loose marks."""
    accented, base = _accent_table()
    return F.regexp_replace(F.translate(text, accented, base), r"\p{Mn}+", "")


def simple_tokens(text: Column, stop: Iterable[str] = ()) -> Column:
    """Lower-case unaccented words of 2 to 15 letters, without stop words."""
    words = F.regexp_extract_all(strip_accents(F.lower(text)), F.lit(WORD), F.lit(0))
    low, high = WORD_LENGTHS
    stop = list(stop)

    def keep(word: Column) -> Column:
        fits = F.length(word).between(low, high) & ~word.startswith("_")
        return fits & ~word.isin(stop) if stop else fits

    return F.filter(words, keep)
