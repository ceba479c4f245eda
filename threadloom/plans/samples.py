"""Samples, splits and binned distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import distributions as dist
from threadloom.operators import graph, rollups, sampling
from threadloom.plans import conversations as conv
from threadloom.plans import fixtures as fx
from threadloom.plans.registry import query, table
from threadloom.plans.scans import PAIRS

# --- samples ---------------------------------------------------------------------


# a twentieth was searched already, so that every topic still needs some
SEARCHED = "searched_fx as (select distinct conversation_id from posts_fx where conv_id % 50 = 3)"


@query(
    "quota_sample",
    fx.with_views(
        """select topic, conversation_id from (
             select topic, conversation_id, need,
                    row_number() over (partition by topic order by md5(concat('42:', conversation_id)), conversation_id) as rank
             from pairs join (select topic, cast(floor(count(*) * 0.05e0) as bigint) + 1
                                     - count(*) filter (conversation_id in (from searched_fx)) as need
                              from pairs group by topic) q using (topic)
             where conversation_id not in (from searched_fx)) r
           where rank <= need""",
        PAIRS.strip(),
        SEARCHED,
    ),
)
def quota_sample(spark: SparkSession, sf: str) -> DataFrame:
    searched = fx.conversation_ids(spark, sf).where(F.col("conv_id") % 50 == 3)
    return sampling.quota_sample(rollups.topic_pairs(fx.posts(spark, sf)), searched)


@query(
    "quota_union",
    fx.with_views(
        """select distinct conversation_id from (
             select topic, conversation_id, need,
                    row_number() over (partition by topic order by md5(concat('42:', conversation_id)), conversation_id) as rank
             from pairs join (select topic, cast(floor(count(*) * 0.05e0) as bigint) + 1
                                     - count(*) filter (conversation_id in (from searched_fx)) as need
                              from pairs group by topic) q using (topic)
             where conversation_id not in (from searched_fx)) r
           where rank <= need""",
        PAIRS.strip(),
        SEARCHED,
    ),
)
def quota_union(spark: SparkSession, sf: str) -> DataFrame:
    """The list to search: conversations drawn for any topic, once."""
    return sampling.quota_union(quota_sample(spark, sf))


HASHED = "row_number() over (order by md5(concat('42:', doc_id)), doc_id)"
BALANCED = f"""
balanced as (select doc_id, quality, true as yes from labels where quality = 0
             union all
             select doc_id, quality, false from (select *, {HASHED} as rank from labels where quality <> 0) r
             where rank <= (select count(*) from labels where quality = 0))
"""


@query("balance_classes", f"with {BALANCED.strip()} select * from balanced")
def balance_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").select("doc_id", "quality", (F.col("quality") == 0).alias("yes"))
    return sampling.balance_classes(rows, "doc_id", "yes")


@query(
    "split_sets",
    f"""select doc_id, case when rank <= floor(n * 0.8e0) then 'train' else 'test' end as part,
               case when rank <= floor(n * 0.75e0) then 'train' when rank <= floor(n * 0.9e0) then 'validate' else 'test' end as part3
        from (select doc_id, {HASHED} as rank, count(*) over () as n from labels) r""",
)
def split_sets(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").select("doc_id")
    two = sampling.split_sets(rows, "doc_id")
    three = sampling.split_sets(rows, "doc_id", (0.75, 0.9), ("train", "validate", "test"))
    return two.join(three.withColumnRenamed("part", "part3"), "doc_id")


# --- distributions ------------------------------------------------------------------


SCORES = """
scores as (select case when conv_id % 3 = 0 then 'b' else 'a' end as platform, tox_mean, new_topic_spread
           from tox_fx join spread_fx using (conversation_id)
           join (select distinct conversation_id, conv_id from posts_fx) c using (conversation_id)),
cells as (select platform, cast(floor(new_topic_spread * 10 + 1e-12) as integer) as spread_cell,
                 cast(floor(tox_mean * 10 + 1e-12) as integer) as tox_cell
          from scores where new_topic_spread >= 0 and new_topic_spread < 1 and tox_mean >= 0 and tox_mean < 1)
"""


@query(
    "density_grid",
    fx.with_views(
        """select platform, cast(i as integer) as spread_cell, cast(j as integer) as tox_cell, n, n / sum(n) over (partition by platform) as density
           from (select p.platform, i, j, (select count(*) from cells c where c.platform = p.platform and c.spread_cell = i and c.tox_cell = j) as n
                 from (select distinct platform from cells) p, range(10) a(i), range(10) b(j)) g""",
        conv.TOX.strip(),
        conv.SPREAD.strip(),
        SCORES.strip(),
    ),
)
def density_grid(spark: SparkSession, sf: str) -> DataFrame:
    platforms = fx.raw_posts(spark, sf).select("conversation_id", "platform").distinct()
    scores = conv.spread_and_tox(spark, sf).join(platforms, "conversation_id")
    return dist.density_grid(scores, ("platform",))


@query(
    "density_grid_topic",
    fx.with_views(
        """select classified_topic, cast(i as integer) as spread_cell, cast(j as integer) as tox_cell, n, n / sum(n) over (partition by classified_topic) as density
           from (select p.classified_topic, i, j, (select count(*) from cells c where c.classified_topic = p.classified_topic and c.spread_cell = i and c.tox_cell = j) as n
                 from (select distinct classified_topic from cells) p, range(10) a(i), range(10) b(j)) g""",
        conv.TOX.strip(),
        conv.SPREAD.strip(),
        conv.CLASSIFIED.strip(),
        SCORES.replace("platform", "classified_topic")
        .replace("case when conv_id % 3 = 0 then 'b' else 'a' end as classified_topic", "classified_topic")
        .replace("(select distinct conversation_id, conv_id from posts_fx) c", "classified")
        .strip(),
    ),
)
def density_grid_topic(spark: SparkSession, sf: str) -> DataFrame:
    scores = conv.spread_and_tox(spark, sf).join(conv.classified(spark, sf), "conversation_id")
    return dist.density_grid(scores, ("classified_topic",))


@query(
    "histogram_eqw",
    """select bin, low + bin * (high - low) / 30e0 as left_edge, count(*) as n, 1e0 * count(*) / total as share
       from (select least(cast(floor((n_chars - low) / ((high - low) / 30e0)) as bigint), 29) as bin, low, high, total
             from documents, (select min(n_chars) * 1e0 as low, max(n_chars) * 1e0 as high, count(*) as total from documents) b) t
       group by bin, low, high, total""",
)
def histogram_eqw(spark: SparkSession, sf: str) -> DataFrame:
    return dist.histogram(table(spark, sf, "documents"), "n_chars")


def bins_sql(values: str, log: bool = True) -> str:
    """Binned density of rows ``(grp, v, nb)``, bins found by comparing with all edges."""
    start = "case when min(v) > 0 then log10(min(v)) else 0 end" if log else "min(v)"
    end = "log10(max(v) + 1)" if log else "max(v) + 1"
    at = "a + i * (z - a) / (nb - 1)"
    edge = f"case when i = 0 and low > 0 then low else pow(10e0, {at}) end" if log else at
    return f"""
select grp, bin, (e0 + e1) / 2 as midpoint, n, n / sum(n) over (partition by grp) as share
from (select e.grp, e.bin, e.e0, e.e1, count(*) as n
      from (select grp, i as bin, edge as e0, lead(edge) over (partition by grp order by i) as e1
            from (select grp, i, {edge} as edge
                  from (select grp, low, a, z, nb, unnest(generate_series(0, nb - 1)) as i
                        from (select grp, min(v) as low, {start} as a, {end} as z, max(nb) as nb from {values} group by grp) g) s) q) e
      join {values} v on v.grp is not distinct from e.grp and v.v >= e.e0 and v.v < e.e1
      group by e.grp, e.bin, e.e0, e.e1) t"""


PRICES = "prices as (select 0 as grp, o_totalprice as v, 50 as nb from orders)"


@query(
    "log_bins",
    f"""with {PRICES}
        select 'log' as scale, bin, midpoint, n, share from ({bins_sql('prices')}) a
        union all select 'linear', bin, midpoint, n, share from ({bins_sql('prices', log=False)}) b""",
)
def log_bins(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    scales = {"log": True, "linear": False}
    parts = [
        dist.binned_density(orders, "o_totalprice", log=log).withColumn("scale", F.lit(name))
        for name, log in scales.items()
    ]
    return parts[0].unionByName(parts[1])


MEASURES = """
measures as (select s.conversation_id, case when c.conv_id % 3 = 0 then 'b' else 'a' end as platform, k.classified_topic,
                    size * 1e0 as size, 1e0 * size / n_users as posts_per_user, breadth * 1e0 as breadth, depth * 1e0 as depth
             from size_fx s join users_fx using (conversation_id) join breadth_fx using (conversation_id)
             join depth_fx using (conversation_id) join (select distinct conversation_id, conv_id from posts_fx) c using (conversation_id)
             join classified k using (conversation_id)),
scoped as (select *, 'all' as scope from measures union all select *, classified_topic from measures),
points as (select concat_ws('|', 'size', platform, scope) as grp, size as v, 20 as nb from scoped
           union all select concat_ws('|', 'posts_per_user', platform, scope), posts_per_user, 20 from scoped
           union all select concat_ws('|', 'breadth', platform, scope), breadth, 50 from scoped
           union all select concat_ws('|', 'depth', platform, scope), depth, 20 from scoped)
"""


@query(
    "distribution_matrix",
    fx.with_views(
        f"""select split_part(grp, '|', 1) as metric, split_part(grp, '|', 2) as platform, split_part(grp, '|', 3) as scope,
                   bin, midpoint, n, share from ({bins_sql('points')}) b""",
        conv.USERS.strip(), conv.EDGES.strip(), conv.NODES, conv.SIZE, conv.BREADTH.strip(), conv.DEPTH.strip(),
        conv.CLASSIFIED.strip(), MEASURES.strip(),
        recursive=True,
    ),
)
def distribution_matrix(spark: SparkSession, sf: str) -> DataFrame:
    posts = fx.raw_posts(spark, sf)
    edges = graph.reply_edges(posts)
    network = graph.network_summary(edges).join(graph.conversation_depth(edges), "conversation_id")
    users = posts.groupBy("conversation_id", "platform", "author").agg(F.lit(1)).groupBy(
        "conversation_id", "platform"
    ).agg(F.count("*").alias("n_users"))
    measured = network.join(users, "conversation_id").join(conv.classified(spark, sf), "conversation_id")
    measured = measured.withColumn("posts_per_user", rollups.share(F.col("size"), F.col("n_users")))
    return dist.distribution_matrix(measured, conv.LABEL_TOPICS)
