"""Hand codes: reshaping, reconciling and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import coding as ops
from threadloom.operators import relational as rel
from threadloom.plans import fixtures as fx
from threadloom.plans.registry import query
from threadloom.sources import survey

CODERS = ("Coder1", "Coder2")


@query(
    "pivot_codes",
    fx.with_views(
        """select cid, c1_on_topic as "Coder1_on_topic", c1_topic as "Coder1_topic",
                  case when doc_id % 4 != 0 then c1_english end as "Coder1_english",
                  c2_on_topic as "Coder2_on_topic", c2_topic as "Coder2_topic", cast(null as varchar) as "Coder2_english"
           from coding_fx"""
    ),
)
def pivot_codes(spark: SparkSession, sf: str) -> DataFrame:
    return ops.pivot_codes(survey.read_survey(spark, fx.write_sheets(spark, sf)), CODERS)


MELTED = """
melted as (select cid, round, 'c1_on_topic' as coder, c1_on_topic as code from coding_fx
           union all select cid, round, 'c2_on_topic', c2_on_topic from coding_fx)
"""


@query("melt_codes", fx.with_views("select * from melted", MELTED.strip()))
def melt_codes(spark: SparkSession, sf: str) -> DataFrame:
    return ops.melt_codes(fx.coding(spark, sf), ["c1_on_topic", "c2_on_topic"], ["cid", "round"])


# every item of round 1 was entered again in round 4 by swapped coders
CLEANED = """
entered as (select cid, round, c1_on_topic, c2_on_topic, c1_english from coding_fx
            union all select cid, 4, c2_on_topic, c1_on_topic, c1_english from coding_fx where round = 1),
latest as (select * from entered e where round = (select max(round) from entered x where x.cid = e.cid))
"""


@query(
    "clean_coding",
    fx.with_views("select * from latest where c1_english is null or c1_english <> 'No'", CLEANED.strip()),
)
def clean_coding(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["cid", "round", "c1_on_topic", "c2_on_topic", "c1_english"]
    first = fx.coding(spark, sf).select(*columns)
    again = first.where(F.col("round") == 1).select(
        "cid",
        F.lit(4).cast("long").alias("round"),
        F.col("c2_on_topic").alias("c1_on_topic"),
        F.col("c1_on_topic").alias("c2_on_topic"),
        "c1_english",
    )
    latest = rel.dedup_keep(first.unionByName(again), ["cid"], ["round"], "last")
    return ops.english_only(latest, "c1_english")


AGREED = """
agreed as (select cid, doc_id, case when c1_on_topic = c2_on_topic then c1_on_topic end as final_on_topic,
                  case when c1_topic = c2_topic then c1_topic end as final_topic from coding_fx)
"""


def agreed(spark: SparkSession, sf: str) -> DataFrame:
    return fx.coding(spark, sf).select(
        "cid",
        "doc_id",
        ops.consensus(F.col("c1_on_topic"), F.col("c2_on_topic")).alias("final_on_topic"),
        ops.consensus(F.col("c1_topic"), F.col("c2_topic")).alias("final_topic"),
    )


@query("consensus", fx.with_views("select cid, final_on_topic, final_topic from agreed", AGREED.strip()))
def consensus(spark: SparkSession, sf: str) -> DataFrame:
    return agreed(spark, sf).drop("doc_id")


FINAL = """
final as (select a.cid, a.doc_id,
                 case when s.convo_id is not null then s.final_on_topic else a.final_on_topic end as final_on_topic,
                 case when s.convo_id is not null then s.final_is_topic else a.final_topic end as final_topic
          from agreed a left join settled_fx s on s.convo_id = a.cid)
"""


def final(spark: SparkSession, sf: str) -> DataFrame:
    return ops.apply_overrides(
        agreed(spark, sf),
        fx.settled(spark, sf).withColumnRenamed("convo_id", "cid"),
        {"final_on_topic": "final_on_topic", "final_topic": "final_is_topic"},
    )


@query(
    "apply_settled",
    fx.with_views("select cid, final_on_topic, final_topic from final", AGREED.strip(), FINAL.strip()),
)
def apply_settled(spark: SparkSession, sf: str) -> DataFrame:
    return final(spark, sf).drop("doc_id")


# corrections name a topic for some items and an answer for fewer
@query(
    "apply_corrections",
    fx.with_views(
        """select cid, case when doc_id % 38 = 0 then 'Yes' else final_on_topic end as final_on_topic,
                  case when doc_id % 19 = 0 then 'Childcare/parenting' else final_topic end as final_topic
           from final""",
        AGREED.strip(),
        FINAL.strip(),
    ),
)
def apply_corrections(spark: SparkSession, sf: str) -> DataFrame:
    done = final(spark, sf)
    corrections = done.where(F.col("doc_id") % 19 == 0).select(
        "cid",
        F.when(F.col("doc_id") % 38 == 0, "Yes").alias("on_topic"),
        F.lit("Childcare/parenting").alias("topic"),
    )
    corrected = ops.apply_overrides(
        done, corrections, {"final_on_topic": "on_topic", "final_topic": "topic"}, keep_null=False
    )
    return corrected.drop("doc_id")


@query(
    "open_disagreements",
    fx.with_views(
        """select cid, final_on_topic, final_topic, case when final_on_topic is null then 'on_topic' else 'topic' end as open
           from final where final_on_topic is null or (final_on_topic = 'Yes' and final_topic is null)""",
        AGREED.strip(),
        FINAL.strip(),
    ),
)
def open_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    return ops.open_disagreements(final(spark, sf).drop("doc_id"))


# --- agreement ----------------------------------------------------------------

SCORED = """
scored as (select round, coalesce(c1_on_topic = c2_on_topic, false) as agree,
                  coalesce(c1_on_topic = 'Not sure', false) or coalesce(c2_on_topic = 'Not sure', false) as unsure from coding_fx)
"""
AGREEMENT = """
select {scope} as scope, count(*) filter (agree) as n_agree, count(*) as n_items,
       count(*) filter (agree or not unsure) as n_sure, 1e0 * count(*) filter (agree) / count(*) as agreement,
       1e0 * count(*) filter (agree) / count(*) filter (agree or not unsure) as agreement_sure
from scored group by 1
"""


@query(
    "percent_agreement",
    fx.with_views(
        AGREEMENT.format(scope="round") + " union all " + AGREEMENT.format(scope="cast(null as bigint)"),
        SCORED.strip(),
    ),
)
def percent_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return ops.percent_agreement(
        fx.coding(spark, sf), F.col("c1_on_topic"), F.col("c2_on_topic"), F.col("round")
    )


def alpha_sql(source: str, scope: str, drop: str) -> str:
    """Alpha by scope from rows ``(scope, unit, code)``, written as sums over pairs of codes."""
    return f"""
select scope, {drop} as drop_not_sure, cast(n as bigint) as n_codes,
       1 - (disagree / n) / ((n * n - squares) / (n * (n - 1))) as alpha
from (
  select scope, sum(n_c) as n, sum(n_c * n_c) as squares, max(d) as disagree
  from (select scope, code, count(*) as n_c from {source}_{scope} group by scope, code) c
  join (select scope, sum(1e0 * differing / (m - 1)) as d
        from (select a.scope, a.unit, count(*) filter (a.code <> b.code) as differing, max(a.m) as m
              from {source}_{scope} a join {source}_{scope} b on a.scope = b.scope and a.unit = b.unit group by a.scope, a.unit) u
        group by scope) d using (scope)
  group by scope) t"""


def pairable(name: str, rows: str) -> str:
    """View of coded rows in units with at least two codes."""
    return (
        f"{name} as (select * from (select *, count(*) over (partition by scope, unit) as m"
        f" from ({rows}) r where code is not null) q where m >= 2)"
    )


ALL_ROWS = "select {scope} as scope, cid as unit, code from melted where {keep}"


@query(
    "krippendorff_alpha",
    fx.with_views(
        alpha_sql("kept", "all", "false") + " union all " + alpha_sql("sure", "all", "true"),
        MELTED.strip(),
        pairable("kept_all", ALL_ROWS.format(scope="'all'", keep="true")),
        pairable("sure_all", ALL_ROWS.format(scope="'all'", keep="code <> 'Not sure'")),
    ),
)
def krippendorff_alpha(spark: SparkSession, sf: str) -> DataFrame:
    codes = fx.coding(spark, sf).select(F.col("cid").alias("unit"), F.lit("all").alias("scope"), "c1_on_topic", "c2_on_topic")
    long = codes.unpivot(["scope", "unit"], ["c1_on_topic", "c2_on_topic"], "coder", "code")
    return ops.krippendorff_alpha(ops.with_and_without_unsure(long), ["scope", "drop_not_sure"])


BY_ROUND = """
scoped as (select cast(round as varchar) as scope, cid, c1_on_topic as first, c2_on_topic as second from coding_fx
           union all select 'all', cid, c1_on_topic, c2_on_topic from coding_fx
           union all select 'topic', cid, c1_topic, c2_topic from coding_fx where c1_on_topic = 'Yes' and c2_on_topic = 'Yes')
"""


@query(
    "agreement_by_round",
    fx.with_views(
        f"""select a.scope, a.drop_not_sure, a.n_codes, a.alpha, p.agreement
            from ({alpha_sql('kept', 'scope', 'false')} union all {alpha_sql('sure', 'scope', 'true')}) a
            join (select scope, false as drop_not_sure, 1e0 * count(*) filter (first = second) / count(*) as agreement from scoped group by scope
                  union all
                  select scope, true, 1e0 * count(*) filter (first = second) / count(*) filter (coalesce(first = second, false)
                         or not (coalesce(first = 'Not sure', false) or coalesce(second = 'Not sure', false))) from scoped group by scope) p
            using (scope, drop_not_sure)""",
        BY_ROUND.strip(),
        pairable("kept_scope", "select scope, cid as unit, unnest([first, second]) as code from scoped"),
        pairable(
            "sure_scope",
            "select * from (select scope, cid as unit, unnest([first, second]) as code from scoped) s where code <> 'Not sure'",
        ),
    ),
)
def agreement_by_round(spark: SparkSession, sf: str) -> DataFrame:
    """Alpha and percent agreement for each round, all rounds, and topics where both said on topic."""
    coding = fx.coding(spark, sf)
    both_on = (F.col("c1_on_topic") == "Yes") & (F.col("c2_on_topic") == "Yes")
    scopes = F.array(
        F.struct(F.col("round").cast("string").alias("scope"), F.col("c1_on_topic").alias("first"), F.col("c2_on_topic").alias("second")),
        F.struct(F.lit("all").alias("scope"), F.col("c1_on_topic").alias("first"), F.col("c2_on_topic").alias("second")),
        F.when(
            both_on,
            F.struct(F.lit("topic").alias("scope"), F.col("c1_topic").alias("first"), F.col("c2_topic").alias("second")),
        ),
    )
    scoped = coding.select("cid", F.explode(F.array_compact(scopes)).alias("s")).select("cid", "s.*")
    codes = scoped.withColumnRenamed("cid", "unit").unpivot(["scope", "unit"], ["first", "second"], "coder", "code")
    alphas = ops.krippendorff_alpha(ops.with_and_without_unsure(codes), ["scope", "drop_not_sure"])
    shares = ops.percent_agreement(scoped, F.col("first"), F.col("second"), F.col("scope"))
    agreement = F.when(F.col("drop_not_sure"), F.col("agreement_sure")).otherwise(F.col("agreement"))
    return alphas.join(shares, "scope").select("scope", "drop_not_sure", "n_codes", "alpha", agreement.alias("agreement"))


@query(
    "agreement_types",
    fx.with_views(
        """select pair, count(*) as n, 1e0 * count(*) / sum(count(*)) over () as share
           from (select case when c1_on_topic = c2_on_topic then c1_on_topic
                             else concat(least(c1_on_topic, c2_on_topic), '_', greatest(c1_on_topic, c2_on_topic)) end as pair
                 from coding_fx where c1_on_topic is not null and c2_on_topic is not null) t group by pair"""
    ),
)
def agreement_types(spark: SparkSession, sf: str) -> DataFrame:
    return ops.agreement_types(fx.coding(spark, sf), F.col("c1_on_topic"), F.col("c2_on_topic"))
