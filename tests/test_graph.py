import random

import pytest

from threadloom import schemas
from threadloom.operators import graph, rollups

POST = "conversation_id string, pid string, parent_id string"


def edges(spark, links):
    return spark.createDataFrame(links, "conversation_id string, src string, dst string")


def forest(seed, conversations=12, size=60):
    rng = random.Random(seed)
    links = []
    for c in range(conversations):
        for i in range(1, rng.randint(2, size)):
            shape = rng.choice(["chain", "star", "any"])
            parent = {"chain": i - 1, "star": 0, "any": rng.randrange(i)}[shape]
            if rng.random() > 0.1:
                links.append((f"c{c}", f"p{i}", f"p{parent}"))
    return links


def brute_depth(links):
    parent = {(c, s): d for c, s, d in links}
    deepest = {}
    for c, s, _ in links:
        steps, at = 0, s
        while (c, at) in parent:
            at, steps = parent[c, at], steps + 1
        deepest[c] = max(deepest.get(c, 0), steps)
    return deepest


def brute_connected(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for c, s, d in links:
        root[find((c, s))] = find((c, d))
    parts = {}
    for node in list(root):
        parts.setdefault(node[0], set()).add(find(node))
    return {c: int(len(p) == 1) for c, p in parts.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_depth_and_connectedness_of_random_forests(spark, seed):
    links = forest(seed)
    df = edges(spark, links)
    assert {r[0]: r[1] for r in graph.conversation_depth(df).collect()} == brute_depth(links)
    expected = brute_connected(links)
    assert {r[0]: r[1] for r in graph.connected(df).collect()} == expected
    assert {r[0]: r[1] for r in graph.connected_by_components(df, small=20).collect()} == expected


def test_long_chain(spark):
    links = [("c", f"p{i}", f"p{i - 1}") for i in range(1, 301)]
    assert graph.conversation_depth(edges(spark, links)).first().depth == 300


def test_star_is_one_deep_and_as_broad_as_its_replies(spark):
    links = [("c", f"p{i}", "root") for i in range(50)]
    df = edges(spark, links)
    assert graph.conversation_depth(df).first().depth == 1
    row = graph.network_summary(df).first()
    assert (row["size"], row.breadth, row.connected) == (51, 50, 1)


def brute_ancestors(links):
    """Most other posts that any post's links lead to."""
    parents = {}
    for c, s, d in links:
        parents.setdefault((c, s), set()).add(d)
    deepest = {}
    for c, s, _ in links:
        seen, todo = set(), [s]
        while todo:
            for d in parents.get((c, todo.pop()), ()):
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        deepest[c] = max(deepest.get(c, 0), len(seen - {s}))
    return deepest


def test_cycles_forks_and_self_links_do_not_stop_the_others(spark):
    links = [
        ("two", "a", "b"), ("two", "b", "a"),
        ("self", "a", "a"),
        ("both", "a", "a"), ("both", "a", "b"), ("both", "b", "c"),
        ("tail", "a", "b"), ("tail", "b", "c"), ("tail", "c", "d"), ("tail", "d", "b"),
        ("fork", "a", "b"), ("fork", "a", "c"), ("fork", "c", "d"), ("fork", "e", "a"),
        ("apart", "a", "b"), ("apart", "x", "y"), ("apart", "y", "x"),
        ("plain", "a", "b"), ("plain", "b", "c"),
    ]
    df = edges(spark, links)
    depth = {r[0]: r[1] for r in graph.conversation_depth(df).collect()}
    assert depth == brute_ancestors(links) | {"self": 0}
    assert {r[0]: r[1] for r in graph.connected(df).collect()} == brute_connected(links)
    rng = random.Random(3)
    links = sorted({(f"c{c}", f"p{rng.randrange(9)}", f"p{rng.randrange(9)}") for c in range(12) for _ in range(7)})
    df = edges(spark, links)
    assert {r[0]: r[1] for r in graph.conversation_depth(df).collect()} == brute_ancestors(links)
    assert {r[0]: r[1] for r in graph.connected(df).collect()} == brute_connected(links)


@pytest.mark.parametrize("seed", range(3))
def test_ancestors_of_links_of_any_shape(spark, seed):
    """Trees with some more links, dense graphs, and cycles with tails and exits, against a search."""
    rng, links = random.Random(seed), set()
    for c in range(25):
        n = rng.randrange(2, 26)
        for i in range(1, n):
            links.add((f"tree{c}", f"p{i}", f"p{rng.randrange(max(0, i - rng.choice([1, 4, 30])), i)}"))
        for _ in range(rng.randrange(4)):
            links.add((f"tree{c}", f"p{rng.randrange(n)}", f"p{rng.randrange(n)}"))
        for _ in range(rng.randrange(1, 14)):
            links.add((f"any{c}", f"p{rng.randrange(8)}", f"p{rng.randrange(8)}"))
        size = rng.randrange(2, 7)
        for i in range(size):
            links.add((f"cycle{c}", f"p{i}", f"p{(i + 1) % size}"))
        for i in range(size, size + rng.randrange(9)):
            links.add((f"cycle{c}", f"p{i}", f"p{rng.randrange(i)}"))
        if c % 2:
            links.add((f"cycle{c}", f"p{rng.randrange(size)}", "exit"))
            links.add((f"cycle{c}", "exit", "top"))
    links = sorted(x for x in links if x[1] != x[2])
    df = edges(spark, links)
    assert {r[0]: r[1] for r in graph.most_ancestors(df).collect()} == brute_ancestors(links)
    if seed == 0:
        got = {r[0]: r[1] for r in graph.most_ancestors(df, small=8).collect()}
        assert got == brute_ancestors(links)


def test_one_fork_above_a_long_chain(spark):
    n = 20_000
    links = [("c", f"p{i}", f"p{i - 1}") for i in range(1, n)]
    links += [("c", "p7000", "q0"), ("c", "q0", "q1"), ("c", "q1", "p100")]
    links += [("d", f"p{i}", f"p{(i + 1) % 3000}") for i in range(3000)] + [("d", "tail", "p5")]
    got = {r[0]: r[1] for r in graph.conversation_depth(edges(spark, links)).collect()}
    assert got == {"c": n - 1 + 2, "d": 3000}


def test_graphs_with_forks(spark):
    rng = random.Random(7)
    links = [
        (f"c{c}", f"p{rng.randrange(20)}", f"p{rng.randrange(20)}") for c in range(10) for _ in range(rng.randint(3, 25))
    ]
    links = sorted({x for x in links if x[1] != x[2]})
    for small in (0, 10_000):
        got = {r[0]: r[1] for r in graph.connected_by_components(edges(spark, links), small).collect()}
        assert got == brute_connected(links)
    forked = graph.network_summary(edges(spark, links)).where("forks > 0 and connected is not null")
    assert forked.isEmpty()


def test_missing_parent_counts_and_isolated_root_does_not(spark):
    posts = spark.createDataFrame(
        [("c", "1", "gone"), ("c", "2", "1"), ("c", "root", None), ("c", "2", "1")], POST
    )
    row = graph.network_summary(graph.reply_edges(posts)).first()
    assert (row["size"], row.breadth, row.n_links, row.connected) == (3, 1, 2, 1)


def test_statistics_of_a_conversation_without_replies(spark):
    posts = spark.createDataFrame(
        [("c", "1", None, "u", 0.5, "", 0), ("d", "2", None, "u", None, "russia", 0), ("d", "3", "2", "v", None, "a | russia", 1)],
        POST + ", author string, tox double, topics string, turn long",
    )
    names = ", ".join(f"{t} double" for t in rollups.LOADINGS)
    loadings = spark.createDataFrame(
        [("c", *[0.1] * 10), ("d", 1.0, *[0.0] * 9), ("d", 1.0, *[0.0] * 9)], f"conversation_id string, {names}"
    )
    stats = rollups.convo_stats(posts, loadings, "turn")
    assert [(f.name, f.dataType) for f in stats.schema] == [(f.name, f.dataType) for f in schemas.CONVO_STATS]
    rows = {r.conversation_id: r for r in stats.collect()}
    c, d = rows["c"], rows["d"]
    assert (c["size"], c.depth, c.breadth, c.connected, c.keyword_topic) == (0, -1, 0, 0, None)
    assert (c.tox_mean, c.tox_median, c.n_users, c.most_comments) == (0.5, 0.5, 1, 1)
    assert c.old_topic_spread == pytest.approx(1) and c.new_topic_spread == pytest.approx(0)
    assert (d["size"], d.depth, d.breadth, d.connected, d.keyword_topic) == (2, 1, 1, 1, "russia")
    assert (d.tox_mean, d.tox_median, d.tox_max, d.russia, d.n_users) == (None, None, None, 1, 2)
    assert d.old_topic_spread == pytest.approx(0) and d.new_topic_spread == pytest.approx(0.9)


def test_null_topics_vote_as_missing_and_no_conversation_is_lost(spark):
    rows = [
        ("c", "1", None, "u", None, None, "2022-01-01"), ("c", "2", "1", "u", 0.2, None, "2022-01-02"),
        ("c", "3", "1", "u", 0.2, ["russia"], "2022-01-03"), ("d", "4", "4", "v", None, None, "2022-01-01"),
        ("e", "5", None, "v", None, [], "2022-01-01"), ("e", "6", "5", "v", None, ["russia"], None),
        ("e", "6", "7", "v", None, ["childcare"], "2022-01-02"),
    ]
    posts = spark.createDataFrame(rows, POST + ", author string, tox double, topics array<string>, created_at string")
    names = ", ".join(f"{t} double" for t in rollups.LOADINGS)
    loadings = spark.createDataFrame([("c", *[0.1] * 10)], f"conversation_id string, {names}")
    got = {r.conversation_id: r for r in rollups.convo_stats(posts, loadings, "created_at").collect()}
    assert set(got) == {"c", "d", "e"}
    assert (got["c"].keyword_topic, got["c"].russia, got["c"].old_topic_spread) == (None, 1, pytest.approx(1))
    assert (got["d"]["size"], got["d"].depth, got["d"].connected, got["d"].old_topic_spread) == (1, 0, 1, None)
    assert (got["e"].depth, got["e"].connected, got["e"].keyword_topic) == (2, 1, "russia")
