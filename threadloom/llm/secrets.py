"""Secret scans by a trigram index, in column expressions only.

From each rule's pattern a Boolean query over trigrams is derived: strings that any match must hold,
as an AND of clauses, each an OR of strings, each an AND of its trigrams. The trigrams of all rules
form the vocabulary of an inverted index over the texts. Posting lists are intersected per rule, and
the pattern runs over the candidates only. A rule without mandatory trigrams reads every text.

Spans are leftmost and do not overlap within a kind; offsets are code points, the end exclusive.

Defined results: a null text is an empty one. Rows of one id are judged by their own texts, and
repeated rows get the same spans.
"""

from __future__ import annotations

import re._constants as parts
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import materialise


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The kinds asked for. Runs of at least so many characters are the runs of any length that have them.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)

#: Published token formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |)PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"://[^\s/:@]+:[^\s/:@]+@"),
)

RULES = BASE_RULES + MORE_RULES

#: Alternatives followed while a query is derived; beyond, a part counts as unknown.
_ALTERNATIVES = 64

Clause = frozenset[frozenset[str]]


def _strings(op, value) -> set[str] | None:
    """All strings a part of a pattern can match, lower-cased; None if unknown or too many."""
    if op is parts.LITERAL:
        return {chr(value).lower()}
    if op is parts.IN:
        if any(kind is not parts.LITERAL for kind, _ in value):
            return None
        return {chr(code).lower() for _, code in value}
    if op is parts.BRANCH:
        found = [_sequence(branch)[0] for branch in value[1]]
        return None if None in found else set().union(*found)
    if op is parts.SUBPATTERN:
        return _sequence(value[-1])[0]
    if op in (parts.MAX_REPEAT, parts.MIN_REPEAT):
        low, high, body = value
        inner = _sequence(body)[0]
        if inner is None or high > 4:
            return None
        found, power = set(), {""}
        for n in range(high + 1):
            if n >= low:
                found |= power
            power = {a + b for a in power for b in inner}
        return found
    return None


def _sequence(pattern) -> tuple[set[str] | None, list[set[str]]]:
    """The strings of a whole sequence, if known, and of its known stretches."""
    whole: set[str] | None = {""}
    run, runs = {""}, []
    for op, value in pattern:
        found = _strings(op, value)
        if found is None or len(found) * len(run) > _ALTERNATIVES:
            runs.append(run)
            whole, run = None, found if found and len(found) <= _ALTERNATIVES else {""}
        else:
            run = {a + b for a in run for b in found}
    if whole is not None:
        whole = run
    return whole, [*runs, run]


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses all of which hold in a lower-cased text with a match; none if it may match anywhere."""
    clauses = []
    for run in _sequence(parser.parse(pattern))[1]:
        if min(map(len, run)) < 3:
            continue
        grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        # A string that holds another one's trigrams is found with it.
        clauses.append(frozenset(g for g in grams if not any(h < g for h in grams)))
    return clauses


def build_index(texts: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Postings ``trigram, doc, key`` of the trigrams in ``vocabulary``."""
    lowered = F.lower(F.col("text"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in vocabulary]))
    rows = texts.select("doc", "key", lowered.alias("low")).select("doc", "key", held.alias("held"))
    posted = rows.select("doc", "key", F.explode_outer("held").alias("trigram"))
    return posted.filter("trigram is not null")


def candidates(index: DataFrame, queries: dict[str, list[Clause]]) -> DataFrame:
    """Per text the kinds whose query holds: ``doc, key, kinds``."""
    held = index.groupBy("doc", "key").agg(F.collect_set("trigram").alias("held"))

    def holds(clauses: list[Clause]) -> Column:
        every = F.lit(True)
        for clause in clauses:
            some = F.lit(False)
            for grams in sorted(map(sorted, clause)):
                wanted = F.array(*map(F.lit, grams))
                some = some | (F.size(F.array_intersect("held", wanted)) == len(grams))
            every = every & some
        return every

    kinds = F.array_compact(
        F.array(*[F.when(holds(clauses), F.lit(kind)) for kind, clauses in queries.items()])
    )
    return held.select("doc", "key", kinds.alias("kinds")).filter(F.size("kinds") > 0)


#: Characters of a text in which a place is sought at once.
BLOCK = 2048


def _matches(text: Column, rule: Rule) -> Column:
    """Characters before, in, and in the judged group of each match."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    before = F.split(text, rule.pattern, -1)
    rows = F.arrays_zip(before.alias("before"), found.alias("found"), judged.alias("judged"))
    return F.transform(
        rows,
        lambda m: F.struct(
            F.length(m["before"]).alias("gap"),
            F.length(m["found"]).alias("size"),
            F.length(m["judged"]).alias("judged"),
            F.lit(rule.kind).alias("kind"),
        ),
    )


def _spans(rows: DataFrame, rules: list[Rule], chosen) -> DataFrame:
    """``doc, key, kind, begin, end`` of the rules that ``chosen`` lets run on a row."""
    none = F.array().cast("array<struct<gap:int,size:int,judged:int,kind:string>>")
    lists = [
        F.when(chosen(r) & F.col("text").rlike(r.pattern), _matches(F.col("text"), r)).otherwise(none)
        for r in rules
    ]
    each = rows.select("doc", "key", F.array(*lists).alias("lists"))
    each = each.select("doc", "key", F.explode_outer("lists").alias("list"))
    each = each.select("doc", "key", F.posexplode_outer("list").alias("i", "m"))
    each = each.select("doc", "key", "i", "m.*").filter("size is not null")
    each = each.distinct()  # of repeated rows
    upto = Window.partitionBy("doc", "key", "kind").orderBy("i")
    upto = upto.rowsBetween(Window.unboundedPreceding, 0)
    least = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.least)]), F.col("kind"))
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
    return placed.filter(F.col("judged") >= least).select(
        "doc", "key", "kind", (F.col("end") - F.col("size")).alias("begin"), "end"
    )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))


def secret_spans(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every span once: ``doc, key, kind, begin, end``; ``key`` is the hash of the text."""
    texts = _texts(docs, id_col, text_col)
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    scanned = [r for r in rules if not queries[r.kind]]
    asked = [r for r in rules if queries[r.kind]]
    spans = _spans(texts, scanned, lambda r: F.lit(True))
    if asked:
        vocabulary = sorted({t for r in asked for c in queries[r.kind] for g in c for t in g})
        index = materialise(build_index(texts, vocabulary), "trigrams")
        found = candidates(index, {r.kind: queries[r.kind] for r in asked})
        same = texts["doc"].eqNullSafe(found["doc"]) & (texts["key"] == found["key"])
        rows = texts.join(found, same).select(texts["doc"], texts["key"], "text", "kinds")
        more = _spans(rows, asked, lambda r: F.array_contains("kinds", r.kind))
        spans = spans.unionByName(more) if scanned else more
    return spans


def per_text(spans: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc, key, spans``: the spans of a text by begin, then kind in the order of the rules."""
    order = F.element_at(
        F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (r.kind, n)]), F.col("kind")
    )
    span = F.struct("begin", order.alias("order"), "kind", "end")
    return spans.groupBy("doc", "key").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def scan(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: ``doc_id, spans, text_key``; ``spans`` has ``begin, order, kind, end``, maybe none."""
    found = per_text(secret_spans(docs, rules, id_col, text_col), rules)
    rows = _texts(docs, id_col, text_col).select(F.col("doc").alias("doc_id"), F.col("key").alias("text_key"))
    same = rows["doc_id"].eqNullSafe(found["doc"]) & (rows["text_key"] == found["key"])
    none = F.array().cast(found.schema["spans"].dataType)
    return rows.join(found, same, "left").select("doc_id", F.coalesce("spans", none).alias("spans"), "text_key")


def _merged(spans: DataFrame) -> DataFrame:
    """``doc, key, gaps, last``: the stretches between the unions of spans, and where the last one ends."""
    before = Window.partitionBy("doc", "key").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max("end").over(before), F.lit(0))
    placed = spans.select("doc", "key", "end", F.struct(done.alias("begin"), F.col("begin").alias("end")).alias("gap"))
    fresh = F.when(F.col("gap.end") >= F.col("gap.begin"), F.col("gap"))
    return placed.groupBy("doc", "key").agg(
        F.array_sort(F.collect_list(fresh)).alias("gaps"), F.max("end").alias("last")
    )


def _between(begin: Column, end: Column) -> Column:
    """Characters ``[begin, end)`` of the text whose blocks are ``blocks``.

    A place is sought in its block only, so that many places cost no more than the text is long.
    """
    first, last = F.floor(begin / BLOCK), F.floor((end - 1) / BLOCK)
    at = lambda i: F.get("blocks", i.cast("int"))
    inside = F.slice("blocks", (first + 2).cast("int"), F.greatest(last - first - 1, F.lit(0)).cast("int"))
    head = F.substring(at(first), (begin - first * BLOCK + 1).cast("int"), F.lit(BLOCK))
    tail = F.substring(at(last), F.lit(1), (end - last * BLOCK).cast("int"))
    return (
        F.when(end <= begin, F.lit(""))
        .when(first == last, F.substring(at(first), (begin - first * BLOCK + 1).cast("int"), (end - begin).cast("int")))
        .otherwise(F.concat(head, F.array_join(inside, ""), tail))
    )


def redact(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    mask: str = "[REDACTED]",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with every span replaced; overlapping spans are replaced together."""
    found = _merged(secret_spans(docs, rules, id_col, text_col))
    own = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), own.alias("own"))
    same = F.col("id").eqNullSafe(F.col("doc")) & (F.col("own") == F.col("key"))
    text = F.col("row")[text_col]
    blocks = F.when(F.col("gaps").isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    rows = rows.join(found, same, "left").select("row", "gaps", "last", F.length(text).alias("size"), blocks.alias("blocks"))
    kept = F.transform("gaps", lambda g: _between(g["begin"], g["end"]))
    masked = F.concat(F.array_join(kept, mask), F.lit(mask), _between(F.col("last"), F.col("size")))
    text = F.when(F.col("gaps").isNull(), text).otherwise(masked)
    return rows.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
