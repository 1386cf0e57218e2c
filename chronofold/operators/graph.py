"""Graph queries over relationships: edges are a frame (source_id, target_id, relationship_type).

Loops run a bounded number of rounds over frames, cut their lineage in the shared folder and stop when a round finds
nothing new. Single-entity searches keep a frontier; whole-graph measures never gather a node's neighbours in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.operators.components import connected_components as _components
from chronofold.session import cut


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "relationship_type")
    return edges.select("source_id", "target_id", "relationship_type").unionByName(back).distinct()


def traverse(edges: DataFrame, start: str | DataFrame, relationship: str | None = None, depth: int = 1, directed: bool = True) -> DataFrame:
    """(entity_id, depth): what can be reached within ``depth`` steps, the start at 0, each at its least depth.

    start: an id, or a frame with a column ``entity_id``. A cycle ends where all is seen.
    """
    spark = edges.sparkSession
    chosen = edges.filter(F.col("relationship_type") == relationship) if relationship else edges
    steps = chosen.select("source_id", "target_id").distinct() if directed else both_ways(chosen).select("source_id", "target_id").distinct()
    first = spark.createDataFrame([(start,)], "entity_id string") if isinstance(start, str) else start.select("entity_id").distinct()
    seen = cut(first.withColumn("depth", F.lit(0)))
    for d in range(depth):
        front = seen.filter(F.col("depth") == d)
        new = steps.join(front.select(F.col("entity_id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("entity_id")).distinct().join(seen.select("entity_id"), "entity_id", "left_anti")
        new = cut(new.withColumn("depth", F.lit(d + 1)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def path(edges: DataFrame, a: str, b: str, max_depth: int = 20) -> list[str]:
    """A shortest path between two entities whatever the directions, of equals the first by ids; none: []."""
    if a == b:
        return [a]
    spark = edges.sparkSession
    steps = both_ways(edges).select("source_id", "target_id").distinct()
    seen = cut(spark.createDataFrame([(a, [a])], "entity_id string, trail array<string>"))
    front = seen
    for _ in range(max_depth):
        reached = steps.join(front.withColumnRenamed("entity_id", "source_id"), "source_id").select(F.col("target_id").alias("entity_id"), F.concat("trail", F.array("target_id")).alias("trail"))
        front = cut(reached.join(seen.select("entity_id"), "entity_id", "left_anti").groupBy("entity_id").agg(F.min("trail").alias("trail")))
        found = front.filter(F.col("entity_id") == b).first()
        if found:
            return list(found["trail"])
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return []


def neighbors(edges: DataFrame, entity_id: str) -> DataFrame:
    """(entity_id, relationship_type, direction) of all entities one step away, both ways."""
    out = edges.filter(F.col("source_id") == entity_id).select(F.col("target_id").alias("entity_id"), "relationship_type", F.lit("outbound").alias("direction"))
    back = edges.filter(F.col("target_id") == entity_id).select(F.col("source_id").alias("entity_id"), "relationship_type", F.lit("inbound").alias("direction"))
    return out.unionByName(back)


def related(edges: DataFrame, current: DataFrame, key: str, entity_id: str, relationship: str) -> DataFrame:
    """Current rows of the entities that an entity relates to by a relationship, with its name."""
    ends = edges.filter((F.col("source_id") == entity_id) & (F.col("relationship_type") == relationship)).select(F.col("target_id").alias(key), "relationship_type").distinct()
    return current.join(ends, key)


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(entity_id, component): weak components, named by their smallest id; nodes without edges are their own."""
    found = _components(edges, "source_id", "target_id").withColumnRenamed("node", "entity_id")
    if nodes is None:
        return found
    alone = nodes.select("entity_id").distinct().join(found, "entity_id", "left_anti")
    return found.unionByName(alone.withColumn("component", F.col("entity_id")))


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(entity_id, community): each round a node takes the label most frequent around it, itself included, of equals the smallest.

    Counting is (node, label) aggregation, so hubs are combined map-side. Stops when no label changes.
    """
    steps = cut(both_ways(edges.filter("source_id != target_id")).select("source_id", "target_id").distinct())
    labels = cut(steps.select(F.col("source_id").alias("entity_id")).distinct().withColumn("community", F.col("entity_id")))
    for _ in range(rounds):
        around = steps.join(labels.withColumnRenamed("entity_id", "target_id"), "target_id").select(F.col("source_id").alias("entity_id"), "community").unionByName(labels)
        counted = around.groupBy("entity_id", "community").agg(F.count("*").alias("n"))
        best = counted.groupBy("entity_id").agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("community"))
        new = cut(best)
        changed = new.join(labels.withColumnRenamed("community", "was"), "entity_id").filter("community != was").isEmpty()
        labels = new
        if changed:
            break
    return labels


def louvain(edges: DataFrame, levels: int = 3, rounds: int = 6) -> DataFrame:
    """(entity_id, community) by modularity: nodes move to the neighbouring community of largest gain, then communities become nodes.

    Deterministic: in a round only nodes of one half (by hash and round) move, all at once, of equal gains to the smallest.
    """
    start = both_ways(edges).filter("source_id != target_id").groupBy("source_id", "target_id").agg(F.lit(1.0).alias("w"))
    links = cut(start)
    member = cut(links.select(F.col("source_id").alias("entity_id")).distinct().withColumn("community", F.col("entity_id")))
    for _ in range(levels):
        degree = cut(links.groupBy(F.col("source_id").alias("n")).agg(F.sum("w").alias("k")))
        total = degree.agg(F.sum("k")).first()[0] or 0.0
        if not total:
            break
        home = cut(degree.select("n", F.col("n").alias("c"), "k"))
        moved_ever, still = False, 0
        for r in range(rounds):
            weight = home.groupBy("c").agg(F.sum("k").alias("tot"))
            toward = links.join(home.select(F.col("n").alias("target_id"), "c"), "target_id").filter("source_id != target_id").groupBy(F.col("source_id").alias("n"), "c").agg(F.sum("w").alias("w"))
            choices = toward.unionByName(home.select("n", "c", F.lit(0.0).alias("w"))).groupBy("n", "c").agg(F.sum("w").alias("w"))
            own = home.select("n", F.col("c").alias("own"), "k")
            scored = choices.join(own, "n").join(weight, "c").withColumn("gain", F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / F.lit(total))
            best = scored.groupBy("n", "own", "k").agg(F.max(F.struct("gain", F.when(F.col("c") == F.col("own"), 1).otherwise(0).alias("stay"))).alias("top"), F.min_by("c", F.struct(-F.col("gain"), F.when(F.col("c") == F.col("own"), 0).otherwise(1), F.col("c"))).alias("to"))
            turn = F.pmod(F.xxhash64("n", F.lit(r)), F.lit(2)) == 0
            new = cut(best.select("n", F.when(turn, F.col("to")).otherwise(F.col("own")).alias("c"), "k", (turn & (F.col("to") != F.col("own"))).alias("moved")))
            moved = not new.filter("moved").isEmpty()
            home = new.drop("moved")
            moved_ever = moved_ever or moved
            still = 0 if moved else still + 1
            if still == 2:  # neither half has moved
                break
        if not moved_ever:
            break
        member = cut(member.join(home.select(F.col("n").alias("community"), "c"), "community").select("entity_id", F.col("c").alias("community")))
        ends = home.select("n", "c")
        links = cut(links.join(ends.select(F.col("n").alias("source_id"), F.col("c").alias("a")), "source_id").join(ends.select(F.col("n").alias("target_id"), F.col("c").alias("b")), "target_id").groupBy(F.col("a").alias("source_id"), F.col("b").alias("target_id")).agg(F.sum("w").alias("w")))
    least = member.groupBy("community").agg(F.min("entity_id").alias("name"))
    return member.join(least, "community").select("entity_id", F.col("name").alias("community"))


def modularity(edges: DataFrame, members: DataFrame) -> float:
    """How much heavier the communities (entity_id, community) are inside than chance would have it: 0 for one community of all."""
    steps = both_ways(edges.filter("source_id != target_id")).select("source_id", "target_id").distinct()
    a, b = (members.select(F.col("entity_id").alias(c), F.col("community").alias(f"_{c}")) for c in ("source_id", "target_id"))
    sums = steps.join(a, "source_id").join(b, "target_id").groupBy(F.col("_source_id").alias("community")).agg(F.count("*").alias("ends"), F.count_if(F.col("_source_id") == F.col("_target_id")).alias("inside"))
    total = F.sum("ends").cast("double")
    found = sums.agg((F.sum("inside") / total - F.sum(F.col("ends").cast("double") ** 2) / total**2).alias("q")).first()["q"]
    return float(found or 0.0)


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(entity_id, score) after a fixed number of rounds; what nodes without an exit hold is shared out evenly."""
    steps = cut(edges.select("source_id", "target_id").distinct())
    nodes = cut(steps.select(F.col("source_id").alias("entity_id")).unionByName(steps.select(F.col("target_id").alias("entity_id"))).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    out = steps.groupBy(F.col("source_id").alias("entity_id")).agg(F.count("*").alias("out"))
    shaped = cut(nodes.join(out, "entity_id", "left"))
    ranks = shaped.withColumn("score", F.lit(1.0 / n))
    for i in range(rounds):
        held = ranks.filter("out is null").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("held"))
        given = steps.join(ranks.filter("out is not null").select(F.col("entity_id").alias("source_id"), (F.col("score") / F.col("out")).alias("part")), "source_id").groupBy(F.col("target_id").alias("entity_id")).agg(F.sum("part").alias("got"))
        ranks = shaped.join(given, "entity_id", "left").crossJoin(F.broadcast(held)).select("entity_id", "out", (F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("held") / F.lit(float(n)))).alias("score"))
        if i % 5 == 4:
            ranks = cut(ranks)
    return ranks.select("entity_id", "score")


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(entity_id, score): in and out edges by the number of other nodes."""
    ends = edges.select(F.col("source_id").alias("entity_id")).unionByName(edges.select(F.col("target_id").alias("entity_id")))
    counted = ends.groupBy("entity_id").agg(F.count("*").alias("n"))
    total = counted.count()
    return counted.select("entity_id", (F.col("n") / F.lit(float(max(1, total - 1)))).alias("score"))


def betweenness(edges: DataFrame, sources: DataFrame | None = None, max_depth: int = 50) -> DataFrame:
    """(entity_id, score): Brandes' sums over directed shortest paths from every source, all sources side by side, normalised.

    Rows are (source, node) pairs, so this is for graphs, or samples of sources, whose pairs fit the cluster.
    """
    steps = cut(edges.select("source_id", "target_id").filter("source_id != target_id").distinct())
    nodes = cut(steps.select(F.col("source_id").alias("entity_id")).unionByName(steps.select(F.col("target_id").alias("entity_id"))).distinct())
    n = nodes.count()
    starts = nodes if sources is None else sources.select("entity_id").distinct()
    seen = cut(starts.select(F.col("entity_id").alias("s"), F.col("entity_id").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("sigma")))
    depth = 0
    for depth in range(1, max_depth + 1):
        front = seen.filter(F.col("d") == depth - 1)
        reached = front.join(steps, front["v"] == steps["source_id"]).groupBy("s", F.col("target_id").alias("v")).agg(F.sum("sigma").alias("sigma"))
        new = cut(reached.join(seen.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit(depth).alias("d"), "sigma"))
        if new.isEmpty():
            depth -= 1
            break
        seen = seen.unionByName(new)
    seen = cut(seen)
    delta = seen.filter(F.col("d") == depth).select("s", "v", F.lit(0.0).alias("delta"))
    total = delta
    for d in range(depth - 1, -1, -1):
        below = seen.filter(F.col("d") == d + 1).join(delta, ["s", "v"]).select("s", F.col("v").alias("w"), F.col("sigma").alias("sw"), "delta")
        here = seen.filter(F.col("d") == d)
        part = here.join(steps, here["v"] == steps["source_id"]).select("s", "v", "sigma", F.col("target_id").alias("w")).join(below, ["s", "w"]).groupBy("s", "v").agg(F.sum(F.col("sigma") / F.col("sw") * (1 + F.col("delta"))).alias("part"))
        delta = cut(here.select("s", "v").join(part, ["s", "v"], "left").select("s", "v", F.coalesce("part", F.lit(0.0)).alias("delta")))
        total = total.unionByName(delta)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    summed = total.filter("s != v").groupBy(F.col("v").alias("entity_id")).agg(F.sum("delta").alias("x"))
    return nodes.join(summed, "entity_id", "left").select("entity_id", (F.coalesce("x", F.lit(0.0)) * F.lit(scale)).alias("score"))


def similar(edges: DataFrame, entity_id: str, top_n: int = 10) -> DataFrame:
    """(entity_id, score): entities with the largest Jaccard likeness of neighbours, over 0; of equals the smallest ids."""
    near = both_ways(edges).select("source_id", "target_id").distinct()
    own = cut(near.filter(F.col("source_id") == entity_id).select("target_id"))
    mine = own.count()
    shared = near.filter(F.col("source_id") != entity_id).join(own, "target_id", "left_semi").groupBy("source_id").agg(F.count("*").alias("both"))
    sizes = near.join(shared.select("source_id"), "source_id", "left_semi").groupBy("source_id").agg(F.count("*").alias("n"))
    scored = shared.join(sizes, "source_id").select(F.col("source_id").alias("entity_id"), (F.col("both") / (F.col("n") + F.lit(mine) - F.col("both"))).alias("score"))
    return scored.orderBy(F.desc("score"), "entity_id").limit(top_n)


COMMUNITIES = {"label_propagation": label_propagation, "louvain": louvain}
CENTRALITIES = {"pagerank": pagerank, "betweenness": betweenness, "degree": degree_centrality}


def communities(edges: DataFrame, algorithm: str = "louvain") -> DataFrame:
    if algorithm not in COMMUNITIES:
        raise ValueError(f"unknown algorithm '{algorithm}' ({sorted(COMMUNITIES)})")
    return COMMUNITIES[algorithm](edges)


def centrality(edges: DataFrame, algorithm: str = "pagerank") -> DataFrame:
    """(entity_id, score), largest first."""
    if algorithm not in CENTRALITIES:
        raise ValueError(f"unknown algorithm '{algorithm}' ({sorted(CENTRALITIES)})")
    return CENTRALITIES[algorithm](edges).orderBy(F.desc("score"), "entity_id")


def cypher(rows: list[tuple[str, str, str]]) -> list[str]:
    """MERGE statements for edges (source, target, type), for a graph database."""
    quote = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    return [f"MERGE (a {{id: '{quote(a)}'}}) MERGE (b {{id: '{quote(b)}'}}) MERGE (a)-[:{t.upper()}]->(b)" for a, b, t in rows]
