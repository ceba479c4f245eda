"""Reply graphs: edges, size, breadth, depth and connectedness per conversation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import discard, materialise, materialise_counting

CONVERSATION = "conversation_id"
HOPS_PER_ROUND = 2
#: Links of a conversation that one task may hold with the sets of ancestors, 50 MB of bits at most.
SMALL_LINKS = 10_000


def reply_edges(posts: DataFrame) -> DataFrame:
    """Distinct links from a post (``src``) to the post it answers (``dst``)."""
    return (
        posts.where(F.col("parent_id").isNotNull())
        .select(CONVERSATION, F.col("pid").alias("src"), F.col("parent_id").alias("dst"))
        .distinct()
    )


def node_degrees(edges: DataFrame) -> DataFrame:
    """One row per post that replies or is replied to, with both degrees.

    ``links`` leaves out links of a post with itself, which ``self_links`` counts.
    """
    own = (F.col("src") == F.col("dst")).cast("int")
    ends = F.array(
        F.struct(
            F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in"), own.alias("self")
        ),
        F.struct(
            F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in"), F.lit(0).alias("self")
        ),
    )
    return (
        edges.select(CONVERSATION, F.explode(ends).alias("_e"))
        .groupBy(CONVERSATION, "_e.node")
        .agg(
            F.sum("_e.out").alias("out_degree"),
            F.sum("_e.in").alias("in_degree"),
            F.sum("_e.self").alias("self_links"),
        )
        .withColumn("links", F.col("out_degree") - F.col("self_links"))
    )


def network_summary(edges: DataFrame) -> DataFrame:
    """Size, breadth, number of links and, for a reply forest, connectedness.

    A forest of ``n`` posts with ``k`` links has ``n - k`` trees. Posts with two
    parents (``forks``) break that rule; their conversations get a null and
    belong to :func:`connected`, and so do those whose links form a cycle,
    which counts do not show. Links of a post with itself count for size and
    breadth only.
    """
    return (
        node_degrees(edges)
        .groupBy(CONVERSATION)
        .agg(
            F.count("*").alias("size"),
            F.max("in_degree").alias("breadth"),
            F.sum("links").alias("n_links"),
            F.sum(F.when(F.col("links") > 1, 1).otherwise(0)).alias("forks"),
        )
        .withColumn(
            "connected",
            F.when(F.col("forks") == 0, (F.col("size") - F.col("n_links") == 1).cast("int")),
        )
    )


def conversation_depth(edges: DataFrame) -> DataFrame:
    """Most ancestors of any post, for each conversation that has a link.

    An ancestor is any other post that the links lead to; on forks and cycles
    it counts once.
    """
    return reply_walks(edges)[0]


def reply_walks(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conversation_id, depth`` and the conversations that are no forest of replies."""
    links = edges.where(F.col("src") != F.col("dst")).distinct()
    forks = links.groupBy(CONVERSATION, "src").count().where("count > 1")
    forked = materialise(forks.select(CONVERSATION).distinct(), "forked")
    above, cyclic = deepest_answered(links.join(forked, CONVERSATION, "left_anti"))
    irregular = materialise(forked.unionByName(cyclic), "irregular")
    linked = edges.groupBy(CONVERSATION).agg(F.max((F.col("src") != F.col("dst")).cast("int")).alias("_real"))
    by_jumps = (
        linked.join(irregular, CONVERSATION, "left_anti")
        .join(above, CONVERSATION, "left")
        .select(CONVERSATION, (F.coalesce("above", F.lit(0)) + F.col("_real")).alias("depth"))
    )
    if irregular.isEmpty():
        return by_jumps, irregular
    by_sets = most_ancestors(links.join(irregular, CONVERSATION, "left_semi"))
    return by_jumps.unionByName(by_sets), irregular


def most_ancestors(links: DataFrame, small: int = SMALL_LINKS) -> DataFrame:
    """``conversation_id, depth`` for links of any shape.

    A conversation of ``small`` links at most is settled by one task, which holds its sets of
    ancestors as bits; larger ones by :func:`ancestors_by_keys`.
    """
    few, large = _by_size(links, small)
    depth = few.groupBy(CONVERSATION).applyInArrow(_deepest_of, f"{CONVERSATION} string, depth long")
    if large.isEmpty():
        return depth
    return depth.unionByName(ancestors_by_keys(links.join(large, CONVERSATION, "left_semi")))


def _by_size(links: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """The links of conversations that one task may hold, and the ids of the others."""
    sizes = links.groupBy(CONVERSATION).agg(F.count("*").alias("_links"))
    large = materialise(sizes.where(F.col("_links") > small).select(CONVERSATION), "large")
    return links.join(large, CONVERSATION, "left_anti").select(CONVERSATION, "src", "dst"), large


def _deepest_of(links: pa.Table) -> pa.Table:
    ends = [links.column(c).to_pylist() for c in ("src", "dst")]
    return pa.table({CONVERSATION: links.column(CONVERSATION)[:1], "depth": [_largest_reach(*ends)]})


def _largest_reach(sources: list[str], targets: list[str]) -> int:
    """Most other nodes that any node leads to.

    A walk through the graph closes one strongly connected part at a time, after all parts that it
    leads to; a part's set is its own nodes and the sets of those.
    """
    number = {node: i for i, node in enumerate(dict.fromkeys([*sources, *targets]))}
    onward: list[list[int]] = [[] for _ in number]
    for a, b in zip(sources, targets, strict=True):
        onward[number[a]].append(number[b])
    order, low, reach = [-1] * len(number), [0] * len(number), [0] * len(number)
    open_nodes: list[int] = []
    seen, most = 0, 0
    for start in range(len(number)):
        walk = [(start, 0)] if order[start] < 0 else []
        while walk:
            node, at = walk.pop()
            if at == 0:
                order[node] = low[node] = seen
                seen += 1
                open_nodes.append(node)
            else:
                low[node] = min(low[node], low[onward[node][at - 1]])
            while at < len(onward[node]):
                next_node = onward[node][at]
                at += 1
                if order[next_node] < 0:
                    walk += [(node, at), (next_node, 0)]
                    break
                if not reach[next_node]:  # still open: on the way here, or in a part that is
                    low[node] = min(low[node], order[next_node])
            else:
                if low[node] == order[node]:
                    part, held = [open_nodes.pop()], 0
                    while part[-1] != node:
                        part.append(open_nodes.pop())
                    for member in part:
                        held |= 1 << member
                        for next_node in onward[member]:
                            held |= reach[next_node]
                    for member in part:
                        reach[member] = held
                    most = max(most, held.bit_count() - 1)
    return most


def ancestors_by_keys(links: DataFrame) -> DataFrame:
    """:func:`most_ancestors` of conversations of any size.

    Each post keeps one link upward, which leaves a tree or a cycle; the other
    links of forks are few. Posts that a fork or a cycle leads to make up the
    upper part, where walks may meet again. Of these only *keys* matter: forks,
    one post of each cycle, posts where walks meet, and posts without a link.
    Between keys lie plain runs of posts, which are measured by pointer jumping,
    and only keys have their sets of ancestors found, so that the work grows
    with the posts and with the pairs of keys, not with the pairs of posts.
    """
    parent = links.groupBy(CONVERSATION, F.col("src").alias("node")).agg(
        F.min("dst").alias("up"), F.count("*").alias("_n")
    )
    parent = materialise(parent, "parents")
    forks = parent.where("_n > 1").select(CONVERSATION, "node")
    extra = links.join(
        forks.withColumnRenamed("node", "src"), [CONVERSATION, "src"], "left_semi"
    ).select(CONVERSATION, F.col("src").alias("node"), F.col("dst").alias("up"))
    extra = extra.join(parent.drop("_n"), [CONVERSATION, "node", "up"], "left_anti")
    extra = materialise(extra, "fork-links")
    jumps, cycles = _jumps(parent.drop("_n"))
    seeds = forks.unionByName(cycles).unionByName(extra.select(CONVERSATION, F.col("up").alias("node")))
    upper = _marked(seeds.distinct(), jumps)

    inner = parent.drop("_n").join(upper, [CONVERSATION, "node"], "left_semi").unionByName(extra)
    inner = materialise(inner, "upper-links")
    ends = inner.groupBy(CONVERSATION, F.col("up").alias("node")).agg(F.count("*").alias("_in"))
    met = ends.where("_in > 1").select(CONVERSATION, "node")
    tops = upper.join(inner.select(CONVERSATION, "node"), [CONVERSATION, "node"], "left_anti")
    keys = forks.unionByName(cycles).unionByName(met).unionByName(tops).distinct()
    keys = materialise(keys, "keys")

    # Runs of plain posts between keys; `last` is a run's post below its upper key, and names it.
    plain = inner.join(keys, [CONVERSATION, "node"], "left_anti")
    plain = materialise(plain, "plain")
    steps = plain.join(
        keys.withColumnRenamed("node", "up").withColumn("_key", F.lit(True)), [CONVERSATION, "up"], "left"
    )
    runs = _run_ends(steps.select(CONVERSATION, "node", F.when(F.col("_key").isNull(), F.col("up")).alias("up")))
    above = plain.select(CONVERSATION, F.col("node").alias("last"), F.col("up").alias("key"))
    # `hops` from a plain post to its upper key, which is also the number of plain posts on the way.
    runs = runs.join(above, [CONVERSATION, "last"]).select(
        CONVERSATION, "node", "last", "key", (F.col("hops") + 1).alias("hops")
    )
    runs = materialise(runs, "runs")
    out = inner.join(keys, [CONVERSATION, "node"], "left_semi")
    first = runs.select(CONVERSATION, F.col("node").alias("up"), "last", "key", "hops")
    out = out.join(first, [CONVERSATION, "up"], "left").select(
        CONVERSATION,
        F.col("node").alias("lower"),
        F.coalesce("key", "up").alias("upper"),
        F.coalesce("hops", F.lit(0)).alias("between"),
        "last",
    )
    out = materialise(out, "key-links")
    reach = _reached(keys, out)

    # Posts above a key are those of its set, and the runs that begin at it or at one of the set.
    between = out.groupBy(CONVERSATION, F.col("lower").alias("ancestor")).agg(F.sum("between").alias("_between"))
    counted = reach.join(between, [CONVERSATION, "ancestor"], "left").groupBy(CONVERSATION, "node").agg(
        F.sum((F.col("node") != F.col("ancestor")).cast("long") + F.coalesce("_between", F.lit(0))).alias("_above")
    )
    counted = materialise(counted, "above-keys")

    # A plain post has as many as its upper key if that leads back to it, else those on the way too.
    lower = out.where("last is not null").select(CONVERSATION, "last", "lower")
    back = reach.select(CONVERSATION, F.col("node").alias("key"), F.col("ancestor").alias("lower"), F.lit(True).alias("_back"))
    inside = (
        runs.join(lower, [CONVERSATION, "last"], "left")
        .join(back, [CONVERSATION, "key", "lower"], "left")
        .join(counted.withColumnRenamed("node", "key"), [CONVERSATION, "key"])
        .select(
            CONVERSATION,
            "node",
            (F.col("_above") + F.when(F.col("_back").isNull(), F.col("hops")).otherwise(0)).alias("_above"),
        )
    )
    known = materialise(counted.select(CONVERSATION, "node", "_above").unionByName(inside), "above-upper")

    # The other posts lead to one of the upper part, or to a post without a link, by a plain run.
    outer = parent.drop("_n").join(upper, [CONVERSATION, "node"], "left_anti")
    entered = upper.withColumnRenamed("node", "up").withColumn("_in", F.lit(True))
    outer = materialise(outer.join(entered, [CONVERSATION, "up"], "left"), "outer")
    own = outer.select(CONVERSATION, F.col("node").alias("last"), F.col("up").alias("entry"))
    below = _run_ends(outer.select(CONVERSATION, "node", F.when(F.col("_in").isNull(), F.col("up")).alias("up")))
    # A run that enters nothing ends at a post without a link, which has no row of its own.
    longest = below.join(own, [CONVERSATION, "last"], "left").groupBy(
        CONVERSATION, F.coalesce("entry", "last").alias("node")
    ).agg(F.max(F.col("hops") + F.col("entry").isNotNull().cast("long")).alias("_hops"))
    outside = longest.join(known, [CONVERSATION, "node"], "left").select(
        CONVERSATION, (F.col("_hops") + F.coalesce("_above", F.lit(0))).alias("_above")
    )
    every = known.select(CONVERSATION, "_above").unionByName(outside)
    return every.groupBy(CONVERSATION).agg(F.max("_above").alias("depth"))


def _jumps(parent: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables ``node, up`` of ever doubled distance, and the least post of each cycle.

    The last table has the posts that go on for longer than there are posts,
    hence lead to a cycle; its ends are the posts of cycles.
    """
    step = parent.select(CONVERSATION, "node", "up", F.col("up").alias("least"))
    step, seen = materialise_counting(step, "jumps", n=F.count("*"))
    tables, bound = [step], seen["n"]
    while seen["n"] and 1 << (len(tables) - 1) <= bound:
        onward = step.select(
            CONVERSATION, F.col("node").alias("up"), F.col("up").alias("_to"), F.col("least").alias("_least")
        )
        step = step.join(onward, [CONVERSATION, "up"]).select(
            CONVERSATION, "node", F.col("_to").alias("up"), F.least("least", "_least").alias("least")
        )
        step, seen = materialise_counting(step, "jumps", n=F.count("*"))
        tables.append(step)
    on_cycle = step.select(CONVERSATION, F.col("up").alias("node")).distinct()
    cycles = step.join(on_cycle, [CONVERSATION, "node"], "left_semi")
    return tables, materialise(cycles.select(CONVERSATION, F.col("least").alias("node")).distinct(), "cycles")


def _marked(seeds: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """The seeds and all that their kept links lead to, however far."""
    marked = materialise(seeds, "marked")
    for jump in jumps:
        further = jump.join(marked, [CONVERSATION, "node"], "left_semi")
        both = marked.unionByName(further.select(CONVERSATION, F.col("up").alias("node"))).distinct()
        before = marked
        marked = materialise(both, "marked")
        discard(before)
        discard(jump)
    return marked


def _run_ends(steps: DataFrame) -> DataFrame:
    """``node, last, hops``: the end of the run that each post is on, by pointer jumping.

    ``steps`` has the next post of a run as ``up``, null at its end; runs have no cycle. What ``up``
    names without a row of its own ends a run too.
    """
    first = steps.select(
        CONVERSATION,
        "node",
        F.coalesce("up", "node").alias("last"),
        F.col("up").isNotNull().cast("long").alias("hops"),
        F.col("up").isNotNull().alias("open"),
    )
    moving, seen = materialise_counting(first, "runs", n=F.count_if("open"))
    finished = moving.where("not open").drop("open")
    moving = moving.where("open").drop("open")
    while seen["n"]:
        onward = finished.unionByName(moving).select(
            CONVERSATION, F.col("node").alias("last"), F.col("last").alias("_to"), F.col("hops").alias("_more")
        )
        moved = moving.join(onward, [CONVERSATION, "last"], "left").select(
            CONVERSATION,
            "node",
            F.coalesce("_to", "last").alias("last"),
            (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"),
            (F.coalesce("_more", F.lit(0)) > 0).alias("open"),
        )
        moved, seen = materialise_counting(moved, "runs", n=F.count_if("open"))
        finished = finished.unionByName(moved.where("not open").drop("open"))
        moving = moved.where("open").drop("open")
    return finished


def _reached(keys: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of a key and each key that it leads to, and of every key with itself.

    Each round joins the pairs with themselves, which doubles the length of the walks they stand for.
    """
    own = keys.select(CONVERSATION, "node", F.col("node").alias("ancestor"))
    pairs = links.select(CONVERSATION, F.col("lower").alias("node"), F.col("upper").alias("ancestor"))
    pairs, seen = materialise_counting(own.unionByName(pairs).distinct(), "reached", n=F.count("*"))
    known = 0
    while seen["n"] > known:
        known = seen["n"]
        onward = pairs.select(
            CONVERSATION, F.col("node").alias("ancestor"), F.col("ancestor").alias("_further")
        )
        wider = pairs.join(onward, [CONVERSATION, "ancestor"]).select(
            CONVERSATION, "node", F.col("_further").alias("ancestor")
        )
        before = pairs
        pairs, seen = materialise_counting(wider.distinct(), "reached", n=F.count("*"))
        discard(before)
    return pairs


def deepest_answered(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ancestors (``above``) of the deepest reply that was itself answered, and cyclic conversations.

    ``links`` have one parent per post. Pointer jumping: each round moves a
    post's pointer two pointers onward, so a chain of ``d`` replies takes
    ``log3(d)`` rounds. Posts nobody answered are left out first, since the
    deepest of them is one below the deepest answered post; that also removes
    the bulk of the replies to a very popular post. Only pointers that can
    still move are written again. Those that can after as many steps as any
    conversation has answered posts are on the way to a cycle.
    """
    answered = links.select(CONVERSATION, F.col("dst").alias("src")).distinct()
    pointers = links.join(answered, [CONVERSATION, "src"], "left_semi").select(
        CONVERSATION,
        F.col("src").alias("node"),
        F.col("dst").alias("ancestor"),
        F.lit(1).cast("long").alias("steps"),
    )
    moving, seen = materialise_counting(pointers, "depth", n=F.count("*"))
    sizes = moving.groupBy(CONVERSATION).agg(F.count("*").alias("_posts"))
    most = sizes.agg(F.max("_posts")).first()[0] or 0
    reached = 1
    finished = moving.limit(0)
    # One round more, in which a pointer that has just come to its end is seen not to move.
    while seen["n"] and reached <= most * (HOPS_PER_ROUND + 1):
        onward = finished.unionByName(moving).select(
            CONVERSATION,
            F.col("node").alias("ancestor"),
            F.col("ancestor").alias("_further"),
            F.col("steps").alias("_more"),
        )
        moved = moving
        for _ in range(HOPS_PER_ROUND):
            moved = moved.join(onward, [CONVERSATION, "ancestor"], "left").select(
                CONVERSATION,
                "node",
                F.coalesce("_further", "ancestor").alias("ancestor"),
                (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"),
                F.col("_further").isNotNull().alias("open"),
            )
        moved, seen = materialise_counting(moved, "depth", n=F.count_if("open"))
        finished = finished.unionByName(moved.where(~F.col("open")).drop("open"))
        moving = moved.where("open").drop("open")
        reached *= HOPS_PER_ROUND + 1
    cyclic = moving.select(CONVERSATION).distinct()
    above = finished.join(cyclic, CONVERSATION, "left_anti") if seen["n"] else finished
    return above.groupBy(CONVERSATION).agg(F.max("steps").alias("above")), cyclic


def component_stars(edges: DataFrame) -> DataFrame:
    """Undirected components as stars: each post linked to the least post it reaches.

    Alternates linking larger neighbours to the least one and smaller
    neighbours to the least one until nothing changes; the number of rounds
    grows with the logarithm of the longest chain, whatever its shape.
    """
    links = edges.where(F.col("src") != F.col("dst")).select(
        CONVERSATION,
        F.greatest("src", "dst").alias("u"),
        F.least("src", "dst").alias("v"),
    )
    links, state = materialise_counting(links.distinct(), "components", **_fingerprint())
    while True:
        both = links.unionByName(links.select(CONVERSATION, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(CONVERSATION, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(least, [CONVERSATION, "u"])
            .select(CONVERSATION, F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        least = large.groupBy(CONVERSATION, "u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, [CONVERSATION, "u"])
            .where(F.col("v") != F.col("m"))
            .select(CONVERSATION, F.col("v").alias("u"), F.col("m").alias("v"))
        )
        stars = small.unionByName(least.select(CONVERSATION, "u", F.col("m").alias("v"))).distinct()
        before, last = links, state
        links, state = materialise_counting(stars, "components", **_fingerprint())
        discard(before)
        if state == last:
            return links


def _fingerprint() -> dict[str, Column]:
    """Two aggregates that differ when two sets of links differ."""
    total = F.sum(F.xxhash64(CONVERSATION, "u", "v").cast("decimal(38,0)"))
    return {"n": F.count("*"), "total": total}


def connected(edges: DataFrame, irregular: DataFrame | None = None) -> DataFrame:
    """1 if a conversation's posts form one component.

    Counting settles every forest of replies; the conversations that are none
    (``irregular``, found here if not given) have their components found.
    """
    if irregular is None:
        irregular = reply_walks(edges)[1]
    counted = network_summary(edges).select(CONVERSATION, "connected")
    if irregular.isEmpty():
        return counted
    odd = materialise(edges.join(irregular, CONVERSATION, "left_semi"), "irregular-edges")
    settled = counted.join(irregular, CONVERSATION, "left_anti")
    return settled.unionByName(connected_by_components(odd))


def _joined_of(links: pa.Table) -> pa.Table:
    """Whether the links of one conversation join all their posts."""
    above: dict[str, str] = {}

    def root(node: str) -> str:
        while above.setdefault(node, node) != node:
            above[node] = node = above[above[node]]
        return node

    for a, b in zip(*[links.column(c).to_pylist() for c in ("src", "dst")], strict=True):
        above[root(a)] = root(b)
    parts = len({root(node) for node in list(above)})
    one = pa.array([int(parts == 1)], pa.int32())
    return pa.table({CONVERSATION: links.column(CONVERSATION)[:1], "connected": one})


def connected_by_components(edges: DataFrame, small: int = SMALL_LINKS) -> DataFrame:
    """The same for links of any shape: one star must hold all posts.

    A conversation of ``small`` links at most is settled by one task.
    """
    few, large = _by_size(edges, small)
    joined = few.groupBy(CONVERSATION).applyInArrow(_joined_of, f"{CONVERSATION} string, connected int")
    if large.isEmpty():
        return joined
    return joined.unionByName(_one_star(edges.join(large, CONVERSATION, "left_semi")))


def _one_star(edges: DataFrame) -> DataFrame:
    nodes = node_degrees(edges).groupBy(CONVERSATION).agg(F.count("*").alias("_nodes"))
    stars = component_stars(edges).groupBy(CONVERSATION).agg(F.count("*").alias("_links"))
    return nodes.join(stars, CONVERSATION, "left").select(
        CONVERSATION,
        (F.col("_nodes") - F.coalesce("_links", F.lit(0)) == 1).cast("int").alias("connected"),
    )
