"""Graph algorithms as driver loops over edge and vector DataFrames.

Loops cut their state into the shared folder every round, so plans stay flat and a
lost executor costs a round at most. Edges are (src, dst[, weight]).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwalk.plans.durable import cut, discard

from .brandes import brandes
from .brandes import nodes as brandes_nodes
from .closing import counts_of, triangles_of
from .components import connected_components
from .cores import cores
from .trusses import truss

INF = float("inf")
#: A limit of so many hops means none: what isn't settled by then is an error, not an answer.
UNBOUNDED = 1000
#: Ids and estimates of so many nodes, 12 bytes each, are sent to every task (48 MB).
ARRAY_NODES = 4_000_000
#: Links of so many, 4 bytes each, are sent to every task at once (80 MB).
ARRAY_LINKS = 20_000_000
#: Of so many pairs, a byte each says to every task whether it is left (150 MB).
ARRAY_PAIRS = 150_000_000


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Each unordered pair once, with src < dst; self-loops go."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def counted(edges: DataFrame) -> DataFrame:
    """(src, dst, _k): the edges, computed once before a loop, with how often each is there."""
    return cut(edges.groupBy("src", "dst").agg(F.count("*").alias("_k")))


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, max_iter: int = 20, epsilon: float | None = None) -> DataFrame:
    """(node, rank). Parallel edges count; what has no out-edge passes nothing on."""
    links = counted(edges)
    nodes = cut((nodes_of(links) if nodes is None else nodes).select("node").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    degree = links.groupBy("src").agg(F.sum("_k").alias("_deg"))
    shares = cut(links.join(degree, "src").select("src", "dst", (F.col("_k") / F.col("_deg")).alias("share")), [links])
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(max_iter):
        sent = shares.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("_in"))
        new = cut(nodes.join(sent, "node", "left").select("node", (F.coalesce("_in", F.lit(0.0)) * damping + (1 - damping) / n).alias("rank")))
        old, rank = rank, new
        if epsilon is not None:
            delta = new.join(old.withColumnRenamed("rank", "_old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("_old")))).first()[0]
            if delta < epsilon:
                return new
        discard(old)
    return rank


def bfs_levels(edges: DataFrame, seeds: DataFrame, max_hops: int = 1024) -> DataFrame:
    """(node, level): hops from the nearest seed, over nodes that can be reached."""
    new = cut(seeds.select("node").distinct().withColumn("level", F.lit(0)))
    seen = new
    ends = cut(edges.select("src", "dst").distinct())
    for level in range(1, max_hops + 1):
        new = cut(new.join(ends, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        if new.isEmpty():
            return seen
        seen = cut(seen.unionByName(new), [seen])
    if max_hops >= UNBOUNDED:
        raise RuntimeError(f"levels did not settle in {max_hops} hops")
    return seen


def shortest_paths(edges: DataFrame, seeds: DataFrame, weight: str = "weight", max_iter: int = 1000) -> DataFrame:
    """(node, distance) by relaxing the edges of nodes whose distance fell; weights must not be negative."""
    w = edges.groupBy("src", "dst").agg(F.min(F.col(weight).cast("double")).alias("_w")).where("_w IS NOT NULL")
    if not w.where("_w < 0").isEmpty():
        raise ValueError("negative weights")
    w = cut(w)
    best = cut(seeds.select("node").distinct().withColumn("distance", F.lit(0.0)))
    changed = best
    for _ in range(max_iter):
        offers = changed.join(w, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("distance") + F.col("_w")).alias("_offer"))
        changed = cut(offers.join(best, "node", "left").where(F.col("distance").isNull() | (F.col("_offer") < F.col("distance"))).select("node", F.col("_offer").alias("distance")))
        if changed.isEmpty():
            return best
        best = cut(best.unionByName(changed).groupBy("node").agg(F.min("distance").alias("distance")), [best])
    raise RuntimeError(f"distances did not settle in {max_iter} rounds")


def _degree(pairs: DataFrame) -> DataFrame:
    return both_ways(pairs).groupBy("src").agg(F.count("*").alias("d"))


def _whole(pairs: DataFrame) -> bool:
    return {t for _, t in pairs.select("src", "dst").dtypes} <= {"tinyint", "smallint", "int", "bigint"}


def _triangles(pairs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Triangles of pairs that are there once, with src < dst, and the cuts that they are read from."""
    degree = cut(_degree(pairs))
    if _whole(pairs):
        found, read = triangles_of(pairs, degree)
        discard(degree)
        return found, read
    ranked = pairs.join(degree.select(F.col("src"), F.col("d").alias("ds")), "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    low_first = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    e = cut(ranked.select(F.when(low_first, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(low_first, F.col("dst")).otherwise(F.col("src")).alias("v")), [degree])
    paths = e.alias("x").join(e.alias("y"), F.col("x.u") == F.col("y.u")).where(F.col("x.v") < F.col("y.v")).select(F.col("x.u").alias("u"), F.col("x.v").alias("v"), F.col("y.v").alias("w"))
    closed = e.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("w"))
    found = paths.join(closed, ["v", "w"])
    row = F.array_sort(F.array("u", "v", "w"))
    return found.select(row[0].alias("a"), row[1].alias("b"), row[2].alias("c")), [e]


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles (a, b, c) of the undirected simple graph, each once.

    Edges point from the end of lower degree, so no node is the middle of more than
    the square root of the edges' number of paths, hubs included. Nodes that are not
    whole numbers take joins of paths with edges; others see closing.py.
    """
    pairs = cut(undirected(edges))
    found, _ = _triangles(pairs)
    discard(pairs)
    return found


def triangle_counts(edges: DataFrame) -> DataFrame:
    """(node, triangles) over nodes of at least one; those of whole numbers are counted where they are found."""
    pairs = cut(undirected(edges))
    if _whole(pairs):
        degree = cut(_degree(pairs))
        found = counts_of(pairs, degree)
        discard(pairs)
        discard(degree)
        return found.groupBy("node").agg(F.sum("n").alias("triangles"))
    return triangles(pairs).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def motifs3(edges: DataFrame) -> DataFrame:
    """Counts of the connected 3-node shapes of the undirected simple graph: open wedges and triangles."""
    pairs = cut(undirected(edges))
    degree = cut(_degree(pairs))
    wedges = cut(degree.agg(F.coalesce(F.sum(F.expr("d * (d - 1) div 2")), F.lit(0)).alias("wedges")))
    if _whole(pairs):
        closed = counts_of(pairs, degree).agg(F.expr("coalesce(sum(n), 0) div 3").alias("triangles"))
    else:
        closed = _triangles(pairs)[0].agg(F.count("*").alias("triangles"))
    discard(pairs)
    discard(degree)
    return wedges.join(F.broadcast(closed)).select((F.col("wedges") - 3 * F.col("triangles")).alias("open_wedges"), "triangles")


def core_numbers(edges: DataFrame, max_iter: int = 10_000) -> DataFrame:
    """(node, core) of the undirected simple graph.

    Every node's estimate starts at its degree and falls to the h-index of its
    neighbours' estimates until nothing changes, which gives the core numbers. Up to
    ARRAY_NODES nodes, all estimates are an array that is sent to every task (cores.py).
    """
    pairs = cut(undirected(edges))
    links = both_ways(pairs)
    if links.select("src").distinct().count() <= ARRAY_NODES and set(dict(links.dtypes).values()) <= {"tinyint", "smallint", "int", "bigint"}:
        found = cores(links, max_iter)
        discard(pairs)
        return found
    links = cut(links, [pairs])
    core = cut(links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("core")))
    for _ in range(max_iter):
        # h-index from counts by value: values are below the node's own estimate or clipped to it.
        seen = links.join(core.select(F.col("node").alias("dst"), F.col("core").alias("_c")), "dst").join(core.select(F.col("node").alias("src"), F.col("core").alias("_own")), "src")
        counts = seen.groupBy("src", F.least("_c", "_own").alias("_v")).agg(F.count("*").alias("_k"))
        upto = Window.partitionBy("src").orderBy(F.desc("_v"))
        new = counts.withColumn("_n", F.sum("_k").over(upto)).groupBy(F.col("src").alias("node")).agg(F.max(F.least("_n", "_v")).alias("core"))
        new = cut(new)
        moved = new.join(core.withColumnRenamed("core", "_old"), "node").where("core <> _old").isEmpty()
        discard(core)
        core = new
        if moved:
            return core
    raise RuntimeError(f"cores did not settle in {max_iter} rounds")


def k_truss(edges: DataFrame, k: int, max_iter: int = 1000) -> DataFrame:
    """Pairs (src, dst) of the k-truss: each in k - 2 triangles of what is left.

    Up to ARRAY_PAIRS pairs of whole numbers, triangles are searched once (trusses.py).
    """
    left = cut(undirected(edges))
    size = left.count()
    if k > 2 and _whole(left) and 0 < size <= ARRAY_PAIRS:
        return truss(left, cut(_degree(left)), k, max_iter)
    for _ in range(max_iter):
        t, read = _triangles(left)
        held = t.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("a").alias("src"), F.col("c").alias("dst")), F.struct(F.col("b").alias("src"), F.col("c").alias("dst")))).alias("e")).select("e.*")
        good = held.groupBy("src", "dst").count().where(F.col("count") >= k - 2).select("src", "dst") if k > 2 else left
        left = cut(left.join(good, ["src", "dst"], "left_semi"), [left, *read])
        now = left.count()
        if now == size:
            return left
        size = now
    raise RuntimeError(f"the truss did not settle in {max_iter} rounds")


def hits(edges: DataFrame, nodes: DataFrame | None = None, max_iter: int = 20) -> DataFrame:
    """(node, hub, authority), each with unit Euclidean length."""
    links = counted(edges)
    nodes = cut((nodes_of(links) if nodes is None else nodes).select("node").distinct())
    n = max(1, nodes.count())
    hub = nodes.withColumn("x", F.lit(n**-0.5))
    auth = hub

    def push(x: DataFrame, near: str, far: str) -> DataFrame:
        got = links.select(F.col(near).alias("node"), F.col(far).alias("to"), "_k").join(x, "node").groupBy(F.col("to").alias("node")).agg(F.sum(F.col("x") * F.col("_k")).alias("x"))
        full = cut(nodes.join(got, "node", "left").select("node", F.coalesce("x", F.lit(0.0)).alias("x")))
        norm = full.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
        return full.select("node", (F.col("x") / norm).alias("x"))

    for _ in range(max_iter):
        auth = push(hub, "src", "dst")
        hub = push(auth, "dst", "src")
    return hub.withColumnRenamed("x", "hub").join(auth.withColumnRenamed("x", "authority"), "node")


def katz(edges: DataFrame, nodes: DataFrame | None = None, alpha: float = 0.01, beta: float = 1.0, max_iter: int = 20) -> DataFrame:
    """(node, score): score = alpha * A^T score + beta, so many times from 0."""
    links = counted(edges)
    nodes = cut((nodes_of(links) if nodes is None else nodes).select("node").distinct())
    score = nodes.withColumn("score", F.lit(0.0))
    for _ in range(max_iter):
        got = links.join(score.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("_k")).alias("_in"))
        score = cut(nodes.join(got, "node", "left").select("node", (F.coalesce("_in", F.lit(0.0)) * alpha + beta).alias("score")), [score])
    return score


def eigenvector(edges: DataFrame, nodes: DataFrame | None = None, max_iter: int = 20) -> DataFrame:
    """(node, score) by power iteration along the edges, with unit Euclidean length."""
    links = counted(edges)
    nodes = cut((nodes_of(links) if nodes is None else nodes).select("node").distinct())
    score = nodes.withColumn("score", F.lit(max(1, nodes.count()) ** -0.5))
    for _ in range(max_iter):
        got = links.join(score.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("_k")).alias("_in"))
        full = cut(nodes.join(got, "node", "left").select("node", F.coalesce("_in", F.lit(0.0)).alias("_x")))
        norm = full.agg(F.sqrt(F.sum(F.col("_x") * F.col("_x")))).first()[0] or 1.0
        score = full.select("node", (F.col("_x") / norm).alias("score"))
    return score


def neighbour_similarity(edges: DataFrame, measure: str = "jaccard", pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, score) of node pairs by their out-neighbour sets: jaccard or cosine.

    Without ``pairs``, of all pairs with a common neighbour.
    """
    links = edges.select("src", "dst").distinct()
    degree = links.groupBy("src").agg(F.count("*").alias("d"))
    if pairs is None:
        met = links.alias("x").join(links.alias("y"), F.col("x.dst") == F.col("y.dst")).where(F.col("x.src") < F.col("y.src"))
        common = met.groupBy(F.col("x.src").alias("a"), F.col("y.src").alias("b")).agg(F.count("*").alias("n"))
    else:
        want = pairs.select("a", "b").distinct()
        met = want.join(links.select(F.col("src").alias("a"), "dst"), "a").join(links.select(F.col("src").alias("b"), "dst"), ["b", "dst"])
        common = want.join(met.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))
    full = common.join(degree.select(F.col("src").alias("a"), F.col("d").alias("da")), "a", "left").join(degree.select(F.col("src").alias("b"), F.col("d").alias("db")), "b", "left")
    n, da, db = F.col("n"), F.coalesce("da", F.lit(0)), F.coalesce("db", F.lit(0))
    by = {"jaccard": F.try_divide(n, da + db - n), "cosine": F.try_divide(n, F.sqrt(da * db))}[measure]
    return full.select("a", "b", F.coalesce(by, F.lit(0.0)).alias("score"))


def topological_levels(edges: DataFrame, nodes: DataFrame | None = None, max_iter: int = 100_000) -> DataFrame:
    """(node, level): the longest way from a source; sorting by it is a topological order. A cycle is an error."""
    links = cut(edges.select("src", "dst").distinct())
    left = cut((nodes_of(edges) if nodes is None else nodes).select("node").distinct())
    found: list[DataFrame] = []
    for level in range(max_iter):
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found) if found else left.withColumn("level", F.lit(0))
        heads = cut(left.join(links.select(F.col("dst").alias("node")), "node", "left_anti"))
        if heads.isEmpty():
            raise ValueError("the graph has a cycle")
        found.append(heads.withColumn("level", F.lit(level)))
        if len(found) > 16:  # keep the union flat
            found = [cut(reduce(DataFrame.unionByName, found))]
        left = cut(left.join(heads, "node", "left_anti"))
        links = cut(links.join(heads.withColumnRenamed("node", "src"), "src", "left_anti"))
    raise RuntimeError("too many levels")


def minimum_spanning_forest(edges: DataFrame, weight: str = "weight", max_iter: int = 64) -> DataFrame:
    """(src, dst, weight) of a minimum spanning forest by Boruvka rounds; ties by (weight, src, dst)."""
    e = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min(F.col(weight)).alias("weight"))
    e = cut(e.where("weight IS NOT NULL"))
    label = cut(nodes_of(e).withColumn("c", F.col("node")))
    tree = e.limit(0)
    for _ in range(max_iter):
        live = e.join(label.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(label.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").where("cs <> cd")
        live = cut(live)
        if live.isEmpty():
            return tree
        best = live.select(F.explode(F.array("cs", "cd")).alias("c"), F.struct("weight", "src", "dst").alias("e")).groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct()
        best = cut(best)
        tree = cut(tree.unionByName(best.select("src", "dst", "weight")).distinct())
        merged = best.join(label.select(F.col("node").alias("src"), F.col("c").alias("a")), "src").join(label.select(F.col("node").alias("dst"), F.col("c").alias("b")), "dst")
        roots = connected_components(merged.select("a", "b"), "a", "b")
        label = cut(label.join(roots.select(F.col("node").alias("c"), "component"), "c", "left").select("node", F.coalesce("component", "c").alias("c")))
    raise RuntimeError("the forest did not settle")


def betweenness(edges: DataFrame, sources: DataFrame, max_hops: int = 1024, both: bool = False) -> DataFrame:
    """(node, score): sum of dependencies over the given sources, all of them at once.

    Edges go either way if ``both``. Forward levels carry (source, node, paths); backward levels
    add dependencies. Links of whole numbers between up to ARRAY_NODES nodes are arrays of up to
    ARRAY_LINKS links that are sent to every task (brandes.py).
    """
    edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")) if both else edges.select("src", "dst")
    if set(dict(edges.dtypes).values()) <= {"tinyint", "smallint", "int", "bigint"}:
        links = cut(edges.where("src IS NOT NULL AND dst IS NOT NULL").repartition("src").distinct().sortWithinPartitions("src"))
        names = cut(brandes_nodes(links))
        if names.count() <= ARRAY_NODES:
            found = brandes(links, names, sources, max_hops, both, ARRAY_LINKS)
            discard(links)
            discard(names)
            return found
    else:
        links = cut(edges.distinct())
    links = cut(both_ways(links).distinct(), [links]) if both else links
    level = cut(sources.select(F.col("node").alias("s"), "node").distinct().withColumn("paths", F.lit(1.0)))
    seen, levels = level.select("s", "node"), [level]
    for _ in range(max_hops):
        step = level.join(links, F.col("node") == F.col("src")).groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = cut(step.join(seen, ["s", "node"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = cut(seen.unionByName(level.select("s", "node")))
    total, later = None, None
    for at in range(len(levels) - 1, 0, -1):
        own = levels[at] if later is None else levels[at].join(later, ["s", "node"], "left")
        own = own.select("s", "node", "paths", (F.coalesce("delta", F.lit(0.0)) if later is not None else F.lit(0.0)).alias("delta"))
        own = cut(own)
        total = own.select("node", "delta") if total is None else total.unionByName(own.select("node", "delta"))
        back = own.join(links, F.col("node") == F.col("dst")).select("s", F.col("src").alias("v"), "paths", "delta")
        met = back.join(levels[at - 1].select("s", F.col("node").alias("v"), F.col("paths").alias("pv")), ["s", "v"])
        later = met.groupBy("s", F.col("v").alias("node")).agg(F.sum(F.col("pv") / F.col("paths") * (1 + F.col("delta"))).alias("delta"))
    zero = nodes_of(links).withColumn("delta", F.lit(0.0))
    return (zero if total is None else zero.unionByName(total)).groupBy("node").agg(F.sum("delta").alias("score"))


def communities(edges: DataFrame, max_iter: int = 10, seed: int = 0) -> DataFrame:
    """(node, community) by greedy modularity moves, half of the nodes (by hash) a round.

    A node joins the neighbouring community of the largest modularity gain; ties go to
    the least label. Labels are the least node of the community at the end.
    """
    links = cut(both_ways(undirected(edges)))
    m2 = links.count()
    degree = cut(links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k")))
    label = cut(degree.select("node", F.col("node").alias("c")))
    for turn in range(max_iter):
        total = label.join(degree, "node").groupBy("c").agg(F.sum("k").alias("tot"))
        into = links.join(label.select(F.col("node").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("node"), "c").agg(F.count("*").alias("kin"))
        own = label.select("node", F.col("c").alias("own")).join(degree, "node")
        options = into.join(own, "node").join(total, "c")
        gain = F.col("kin") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0)) / m2
        best = options.withColumn("gain", gain).groupBy("node").agg(F.max(F.struct("gain", (-F.col("c")).alias("neg"))).alias("b"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"))
        movers = F.pmod(F.xxhash64("node", F.lit(seed + turn)), F.lit(2)) == 0
        # Staying is worth leaving nothing: the own community without the node.
        alone = own.join(total.withColumnRenamed("c", "own"), "own").select("node", (-F.col("k") * (F.col("tot") - F.col("k")) / m2).alias("none"))
        step = label.join(best, "node").join(alone, "node").select("node", F.when(movers & (F.col("b.gain") > F.coalesce("stay", "none") + 1e-12), -F.col("b.neg")).otherwise(F.col("c")).alias("c"), F.col("c").alias("was"))
        step = cut(step)
        still = step.where("c <> was").isEmpty()
        label = step.select("node", "c")
        if still and turn % 2:
            break
    names = label.groupBy("c").agg(F.min("node").alias("community"))
    return label.join(names, "c").select("node", "community")


def modularity(edges: DataFrame, label: DataFrame) -> DataFrame:
    """One row ``modularity`` of (node, community) on the undirected simple graph."""
    links = cut(both_ways(undirected(edges)))
    m2 = links.count()
    within = links.join(label.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(label.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst").where("a = b").groupBy(F.col("a").alias("community")).agg(F.count("*").alias("inside"))
    total = links.join(label.withColumnRenamed("node", "src"), "src").groupBy("community").agg(F.count("*").alias("tot"))
    return total.join(within, "community", "left").agg(F.sum(F.coalesce("inside", F.lit(0)) / m2 - (F.col("tot") / m2) ** 2).alias("modularity"))


def island_pairs(edges: DataFrame, links: DataFrame) -> DataFrame:
    """(l1, l2) of edge ids whose joint removal leaves more components than before.

    ``edges`` has edge_id; ``links`` names the candidates, which should be few: every
    pair is a graph of its own, all of them solved at once with the pair as a key.
    """
    ids = links.select("edge_id").distinct()
    pairs = ids.select(F.col("edge_id").alias("l1")).join(ids.select(F.col("edge_id").alias("l2")), F.col("l1") < F.col("l2"))
    base = component_count(edges)
    pairs = cut(pairs)
    worlds = pairs.join(edges.select("edge_id", "src", "dst"), (F.col("edge_id") != F.col("l1")) & (F.col("edge_id") != F.col("l2")))
    key = lambda c: F.struct("l1", "l2", F.col(c).alias("n"))
    loops = pairs.join(nodes_of(edges)).select(key("node").alias("src"), key("node").alias("dst"))
    comp = connected_components(worlds.select(key("src").alias("src"), key("dst").alias("dst")).unionByName(loops))
    count = comp.groupBy(F.col("node.l1").alias("l1"), F.col("node.l2").alias("l2")).agg(F.count_distinct("component").alias("n"))
    return count.where(F.col("n") > base).select("l1", "l2")


def component_count(edges: DataFrame) -> int:
    return connected_components(edges).select("component").distinct().count()


def isomorphic(a: DataFrame, b: DataFrame, rounds: int = 8) -> bool:
    """Whether colour refinement of the two graphs' edges tells them apart: False is certain, True is not for regular graphs."""

    def colours(e: DataFrame) -> DataFrame:
        e = cut(e.select("src", "dst").distinct())
        c = nodes_of(e).withColumn("c", F.lit(0).cast("long"))
        for _ in range(rounds):
            outs = e.join(c.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.xxhash64("c", F.lit("o")).cast("decimal(38,0)")).alias("o"))
            ins = e.join(c.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.xxhash64("c", F.lit("i")).cast("decimal(38,0)")).alias("i"))
            c = cut(c.join(outs, "node", "left").join(ins, "node", "left").select("node", F.xxhash64("c", F.col("o").cast("string"), F.col("i").cast("string")).alias("c")))
        return c.groupBy("c").count()

    left, right = cut(colours(a)), cut(colours(b).withColumnRenamed("count", "other"))
    return left.join(right, "c", "full_outer").where(~F.col("count").eqNullSafe(F.col("other"))).isEmpty()
