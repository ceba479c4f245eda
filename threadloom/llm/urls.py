"""URL filter by a tree of path templates, in column expressions only.

Listed rules judge the urls they fit, and these verdicts label the rest. Per host the paths form a
tree of segments, built level by level. A segment is generalised by its form first: digits and long
hexadecimal runs are placeholders. Below a node with many different segments, few of which come
again, the segments are a wildcard. Other branches of a node are merged if a G-test on their counts
finds no difference at 5%, neither between the forms of the segments below nor between their labels:
branches are pooled by rounded shares, the pools that differ from all larger ones lead, and a branch
joins the leader it differs from least, or none. So branches of few paths are merged by likeness, and
those of many only if they are equal for all that their counts tell. Branches whose own labels reject
them are never merged with others, so that one without labels is not rejected for a neighbour's. A node has a few hundred pools at
most, whatever its size; equal differences go to the larger leader. A template, a host with the generalised segments of a path, is rejected if the smoothed share of block
among its labelled urls is above a limit. Paths of any number of segments are judged whole.

Paths are counted before they are grouped, so that a host with a third of all urls costs one row
per path, and one per node further on. A level has only the paths that have a segment there and
share their node with enough others for a wildcard or a merge; the rest of a path that does not is
generalised by form in one step, so that the number of levels is that of the shared segments.

Defined results: the host and path of a null url, or of one without ``://``, are empty; it fits no
rule. Repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import materialise

#: Levels that the SQL of the query spells out; it agrees where no path has more segments.
DEPTH = 4
#: Below a node with so many different segments, half or more of all paths, they are a wildcard.
WILD_CHILDREN = 8
#: Paths that a branch must have to be merged with others.
MERGE_PATHS = 4
#: Forms and labels together have four degrees of freedom; the difference beyond which a G-test at 5%
#: calls two branches different, in millionths, since it is rounded to be the same everywhere.
DIFFERENT = 9_487_729
#: Share of block in an unlabelled template, and the number of urls that this prior counts as.
PRIOR, PRIOR_WEIGHT = 0.25, 4.0
LIMIT = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FORMS = ("end", "number", "mixed", "word")


@dataclass(frozen=True)
class UrlRule:
    """``text`` is a host and the beginning of a path, such as ``example.net/en/``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


RULES = (
    UrlRule("block", "net/"),
    UrlRule("allow", "example.net/en/"),
    UrlRule("block", "example.com/de/"),
    UrlRule("allow", "org/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits, as a struct of its text and verdict, or null."""
    kind = "struct<text:string,verdict:string>"
    chosen = F.lit(None).cast(kind)
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        inside = (host == rule.host) | host.endswith("." + rule.host)
        this = F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(inside & path.startswith(rule.path), this).otherwise(chosen)
    return chosen


def _lexical(segment: Column) -> Column:
    """A segment with its digits and long hexadecimal runs as placeholders."""
    hexed = F.regexp_replace(segment, r"[0-9a-f]{8,}(-[0-9a-f]{4,})*", "{h}")
    return F.when(segment.rlike("[0-9]"), F.regexp_replace(hexed, r"[0-9]+", "{n}")).otherwise(segment)


def _form(segment: Column) -> Column:
    return (
        F.when(segment.isNull(), "end")
        .when(segment.rlike(r"^[0-9]+(\.[a-z]+)?$"), "number")
        .when(segment.rlike(r"[0-9]"), "mixed")
        .otherwise("word")
    )


def _smoothed(bad: Column, good: Column) -> Column:
    """The share of block among labelled urls, with the prior."""
    return (bad + PRIOR * PRIOR_WEIGHT) / (bad + good + PRIOR_WEIGHT)


def _log_sum(counts: list[Column]) -> Column:
    """The sum of ``x ln x`` over counts, less that of their total."""

    def term(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(0.0)

    return reduce(Column.__add__, map(term, counts)) - term(reduce(Column.__add__, counts))


def _difference(one: Column, other: Column) -> Column:
    """The G statistic of two structs of counts, forms and labels added up, in millionths."""
    parts = []
    for table in ([f"n_{form}" for form in _FORMS], ["bad", "good"]):
        a, b = ([side.getField(name).cast("double") for name in table] for side in (one, other))
        both = [x + y for x, y in zip(a, b, strict=True)]
        # their totals, a table of two cells, make up the rest of the statistic
        parts.append(_log_sum(a) + _log_sum(b) - _log_sum(both))
    return F.round((parts[0] + parts[1]) * 2e6).cast("long")


def _merges(leader: Column, other: Column) -> Column:
    return (leader["rejects"] == other["rejects"]) & (_difference(leader, other) <= DIFFERENT)


def _leaders(branches: DataFrame, node: list[str]) -> DataFrame:
    """The pools of each node that differ from all larger ones."""
    counts = [*[f"n_{form}" for form in _FORMS], "bad", "good"]
    pools = branches.filter("alike is not null").groupBy(*node, "alike", "rejects")
    pools = pools.agg((-F.sum("paths")).alias("least"), *[F.sum(c).alias(c) for c in counts])
    listed = pools.groupBy(*node).agg(
        F.array_sort(F.collect_list(F.struct("least", "alike", "rejects", *counts))).alias("pools")
    )

    def add(leaders: Column, pool: Column) -> Column:
        known = F.exists(leaders, lambda leader: _merges(leader, pool))
        return F.when(known, leaders).otherwise(F.concat(leaders, F.array(pool)))

    none = F.filter("pools", lambda _: F.lit(False))
    return listed.select(*node, F.aggregate("pools", none, add).alias("leaders"))


def _led_by() -> Column:
    """The leader that a branch of ``leaders`` differs from least, or null."""
    own = F.struct("rejects", *[f"n_{form}" for form in _FORMS], "bad", "good")
    measured = F.transform(
        F.filter("leaders", lambda leader: _merges(leader, own)),
        lambda leader: F.struct(_difference(leader, own).alias("g"), leader["least"], leader["alike"]),
    )
    near = F.array_min(measured)
    return F.when(F.col("alike").isNotNull(), near["alike"])


def _level(state: DataFrame, depth: int) -> DataFrame:
    """The state with one more segment of every template."""
    here = F.get("segments", F.lit(depth))
    child = F.when(here.isNull(), F.lit("")).otherwise(_lexical(here))
    rows = state.withColumn("child", child).withColumn(
        "below", _form(F.get("segments", F.lit(depth + 1)))
    )
    node = ["host", "prefix"]
    counts = [F.sum((F.col("below") == form).cast("long")).alias(f"n_{form}") for form in _FORMS]
    branches = rows.groupBy(*node, "child").agg(
        F.count("*").alias("paths"), F.sum("bad").alias("bad"), F.sum("good").alias("good"), *counts
    )
    parents = branches.filter("child <> ''").groupBy(*node).agg(
        F.count("*").alias("children"), F.sum("paths").alias("under")
    )
    rejects = _smoothed(F.col("bad"), F.col("good")) > LIMIT
    purity = (F.col("bad") + 1) / (F.col("bad") + F.col("good") + 2)
    profile = F.concat_ws(
        ",",
        *[F.round(F.col(f"n_{form}") * 4 / F.col("paths")).cast("int").cast("string") for form in _FORMS],
        F.floor(purity * 3).cast("string"),
        rejects.cast("int").cast("string"),
    )
    branches = branches.join(parents, node, "left").withColumn("profile", profile)
    wild = (F.col("children") >= WILD_CHILDREN) & (F.col("children") * 2 >= F.col("under"))
    branches = branches.withColumn("wild", F.coalesce(wild, F.lit(False))).withColumn("rejects", rejects)
    merges = ~F.col("wild") & (F.col("paths") >= MERGE_PATHS) & (F.col("child") != "")
    branches = branches.withColumn("alike", F.when(merges, F.col("profile")))
    led = branches.join(_leaders(branches, node), node, "left").withColumn("lead", _led_by()).drop("leaders")
    merged = led.filter("lead is not null").groupBy(*node, "lead").agg(F.min("child").alias("least"))
    named = led.join(merged, [*node, "lead"], "left")
    name = (
        F.when(F.col("child") == "", "")
        .when(F.col("wild"), "/*")
        .otherwise(F.concat(F.lit("/"), F.coalesce("least", "child")))
    )
    names = named.select(*node, "child", name.alias("name"), (F.col("paths") - F.col("n_end")).alias("longer"))
    going_on = names.groupBy(*node, "name").agg(F.sum("longer").alias("going_on"))
    names = names.join(going_on, [*node, "name"]).drop("longer")
    longer = rows.join(names, [*node, "child"])
    return longer.select(
        "host", "path", "ruled", "segments", "bad", "good", F.concat("prefix", "name").alias("prefix"), "going_on"
    )


def templates(paths: DataFrame) -> DataFrame:
    """Each of the distinct ``host, path, ruled, bad, good`` with its ``template``."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    state = paths.withColumn("segments", parts).withColumn("prefix", F.lit(""))
    state = materialise(state, "paths")
    columns = ["host", "path", "ruled", "bad", "good"]
    ended = [state.filter(F.size("segments") <= 0).select(*columns, F.col("prefix").alias("template"))]
    state = state.filter(F.size("segments") > 0)
    depth = 0
    while not state.isEmpty():
        written = materialise(_level(state, depth), "level")
        depth += 1
        left = F.size("segments") - depth
        # fewer paths are neither a wildcard nor merged, at this level or below
        further = (left > 0) & (F.col("going_on") >= min(MERGE_PATHS, WILD_CHILDREN))
        rest = F.slice("segments", F.lit(depth + 1), F.greatest(left, F.lit(0)))
        tail = F.array_join(F.transform(rest, lambda s: F.concat(F.lit("/"), _lexical(s))), "")
        ended.append(written.filter(~further).select(*columns, F.concat("prefix", tail).alias("template")))
        state = written.filter(further).drop("going_on")
    return reduce(DataFrame.unionByName, ended)


def judge(
    pages: DataFrame,
    rules: tuple[UrlRule, ...] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Per row: ``page_id, host, path, rule, verdict, template``."""
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = split.withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", F.col("r.text").alias("rule"), F.col("r.verdict").alias("ruled"))
    label = [
        F.sum((F.coalesce("ruled", F.lit("")) == verdict).cast("long")).alias(name)
        for verdict, name in (("block", "bad"), ("allow", "good"))
    ]
    paths = rows.groupBy("host", "path").agg(F.first("ruled").alias("ruled"), *label)
    known = templates(paths)
    rejected = _smoothed(F.sum("bad"), F.sum("good")) > LIMIT
    leaves = known.groupBy("host", "template").agg(rejected.alias("rejected"))
    judged = known.join(leaves, ["host", "template"]).select("host", "path", "template", "rejected")
    verdict = F.coalesce("ruled", F.when(F.col("rejected"), "block").otherwise("allow"))
    return rows.join(judged, ["host", "path"]).select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "template"
    )
