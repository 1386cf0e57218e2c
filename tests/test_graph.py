import itertools
import random

import pytest

from chronofold.operators import graph as G
from chronofold.operators.components import connected_components
from chronofold.queries import QUERIES

COLUMNS = "source_id string, target_id string, relationship_type string"


def frame(spark, pairs, kind="r"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], COLUMNS)


def brute_components(pairs):
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    pairs = [(f"n{r.randint(0, 40):02d}", f"n{r.randint(0, 40):02d}") for _ in range(25)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == brute_components(pairs)


def test_a_long_chain_a_star_and_odd_edges(spark):
    chain = [(k, k + 1) for k in range(70)]
    star = [(1000, k) for k in range(1001, 1100)]
    odd = [(5000, 5000), (None, 3), (4, None), (70, 69)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(chain + star + odd, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(71), 0), **dict.fromkeys(range(1000, 1100), 1000), 5000: 5000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_searches(spark):
    e = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("d", "e"), ("b", "e")])
    assert {r["entity_id"]: r["depth"] for r in G.traverse(e, "a", depth=9).collect()} == {"a": 0, "b": 1, "c": 2, "e": 2, "d": 3}
    assert {r["entity_id"]: r["depth"] for r in G.traverse(e, "d", depth=1, directed=False).collect()} == {"d": 0, "c": 1, "e": 1}
    assert G.path(e, "d", "a") == ["d", "c", "a"] and G.path(e, "a", "x") == [] and G.path(e, "a", "a") == ["a"] and G.path(e, "a", "d", max_depth=1) == []
    assert sorted((r["entity_id"], r["direction"]) for r in G.neighbors(e, "c").collect()) == [("a", "outbound"), ("b", "inbound"), ("d", "outbound")]
    likeness = {r["entity_id"]: r["score"] for r in G.similar(e, "a").collect()}
    near = {n: {b if a == n else a for a, b in [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("b", "e")] if n in (a, b)} for n in "abcde"}
    assert likeness == {n: len(near[n] & near["a"]) / len(near[n] | near["a"]) for n in "bcde" if near[n] & near["a"]}


def brute_betweenness(pairs):
    nodes = sorted({x for p in pairs for x in p})
    out = {n: [b for a, b in set(pairs) if a == n and b != n] for n in nodes}

    def paths(s, t):
        front, found = [[s]], []
        while front and not found:
            found = [p for p in front if p[-1] == t]
            front = [p + [n] for p in front for n in out[p[-1]] if n not in p]
        return found

    score = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        got = paths(s, t)
        for p in got:
            for n in p[1:-1]:
                score[n] += 1 / len(got)
    n = len(nodes)
    return {k: v / ((n - 1) * (n - 2)) for k, v in score.items()}


def test_measures(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "e"), ("b", "d"), ("e", "a")]
    e = frame(spark, pairs)
    got = {r["entity_id"]: r["score"] for r in G.centrality(e, "betweenness").collect()}
    for k, v in brute_betweenness(pairs).items():
        assert got[k] == pytest.approx(v), k
    ranks = {r["entity_id"]: r["score"] for r in G.pagerank(frame(spark, [*pairs, ("d", "sink")])).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and len(ranks) == 6
    assert {r["entity_id"]: r["score"] for r in G.centrality(e, "degree").collect()}["b"] == pytest.approx(3 / 4)
    with pytest.raises(ValueError):
        G.centrality(e, "fame")
    with pytest.raises(ValueError):
        G.communities(e, "tribes")


@pytest.mark.parametrize("algorithm", ["louvain", "label_propagation"])
def test_two_cliques_are_two_communities(spark, algorithm):
    left, right = ["a", "b", "c", "d"], ["w", "x", "y", "z"]
    pairs = [*itertools.combinations(left, 2), *itertools.combinations(right, 2), ("a", "w")]
    got = {r["entity_id"]: r["community"] for r in G.communities(frame(spark, pairs), algorithm).collect()}
    assert len({got[x] for x in left}) == 1 and len({got[x] for x in right}) == 1 and got["b"] != got["x"]


def test_queries_take_the_whole_graph(spark, tmp_path):
    """graph_betweenness by brute force, graph_louvain by the best of all partitions; customers are most of both graphs."""
    customers, suppliers, nations = [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)], [(1, 0), (2, 1)], [(0, 0), (1, 1)]
    for name, rows, columns in [("customer", customers, "c_custkey long, c_nationkey long"), ("supplier", suppliers, "s_suppkey long, s_nationkey long"), ("nation", nations, "n_nationkey long, n_regionkey long")]:
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    pairs = [(f"{a}{x}", f"{b}{y}") for a, b, rows in [("c", "n", customers), ("s", "n", suppliers), ("n", "r", nations)] for x, y in rows]
    got = {r["entity_id"]: r["score"] for r in QUERIES["graph_betweenness"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(brute_betweenness(pairs)) and len(got) == 11

    nodes = sorted({x for p in pairs for x in p})
    degree = {x: sum(x in p for p in pairs) for x in nodes}

    def modularity(label):
        inside = sum(label[a] == label[b] for a, b in pairs) / len(pairs)
        return inside - sum((sum(degree[x] for x in nodes if label[x] == c) / (2 * len(pairs))) ** 2 for c in set(label.values()))

    def partitions(k, label, used):
        if k == len(nodes):
            yield label
            return
        for c in range(used + 1):
            label[nodes[k]] = c
            yield from partitions(k + 1, label, max(used, c + 1))

    found = {r["entity_id"]: r["community"] for r in QUERIES["graph_louvain"](spark, str(tmp_path)).collect()}
    assert sorted(found) == nodes
    assert modularity(found) == pytest.approx(max(modularity(label) for label in partitions(0, {}, 0)))
