"""Graphs of networks: links (eid, a, b, rel), rel -1 where a provides for b, 0 between peers, 1 within one network.

Iterations are driver loops over distributed steps; what an iteration leaves is written to the shared folder, so plans stay short and a lost
executor costs only the step it was in. Link numbers (eid) break every tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import staged

KERNEL_LINKS = 1_000_000  # links of a graph that is sent whole to the executors: 24 bytes each
BLOCK_ENDS = 1 << 21  # link ends of a block of nodes that is peeled at once: some 100 bytes each


def until_settled(most: int | None) -> Iterator[int]:
    """Rounds of a loop that ends itself when nothing changes; with a bound that isn't enough it fails instead of giving half a result."""
    yield from count() if most is None else range(most)
    raise RuntimeError(f"not settled after {most} rounds")


class Compact:
    """A graph of counted size as arrays: node numbers, and for each node its links as (other end, place in eid order)."""

    def __init__(self, a: np.ndarray, b: np.ndarray, eid: np.ndarray, rel: np.ndarray, both: bool):
        o = np.argsort(eid, kind="stable")
        a, b, self.eid, rel = a[o], b[o], eid[o], rel[o]
        self.ids = np.unique(np.r_[a, b])
        x, y = np.searchsorted(self.ids, a), np.searchsorted(self.ids, b)
        k, down = np.arange(len(x)), np.ones(len(x), bool)
        if both:
            x, y, k, down = np.r_[x, y], np.r_[y, x], np.r_[k, k], np.r_[down, ~down]
        o = np.argsort(x, kind="stable")
        self.to, self.link, self.down = y[o].astype(np.int32), k[o].astype(np.int32), down[o]
        self.rel = rel[self.link].astype(np.int8)
        self.first = np.searchsorted(x[o], np.arange(len(self.ids) + 1))

    def beside(self, nodes: np.ndarray) -> np.ndarray:
        """Places of all links of the nodes."""
        n = self.first[nodes + 1] - self.first[nodes]
        return np.repeat(self.first[nodes] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def compact(edges: DataFrame, both: bool = True) -> Compact | None:
    """The graph as arrays if it has at most KERNEL_LINKS links, which is counted first; None if it is larger.

    As with a broadcast join, the two ways give the same rows; tests hold them against each other on a graph of as many links.
    """
    if edges.count() > KERNEL_LINKS:
        return None
    p = edges.select("a", "b", "eid", "rel").toPandas()
    return Compact(*[p[c].to_numpy(np.int64) for c in ("a", "b", "eid", "rel")], both)


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, eid, rel, down): each link from both its ends; ``down`` if it goes from provider to customer."""
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "eid", "rel", F.lit(True).alias("down"))
    return out.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "eid", "rel", F.lit(False).alias("down")))


def degrees(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(node, degree, customers, providers, peers): a link to itself counts twice in the degree."""
    w = F.lit(1) if weight is None else F.col(weight)
    ends = edges.select(F.col("a").alias("node"), w.alias("w"), F.when(F.col("rel") == -1, 1).otherwise(0).alias("c"), F.lit(0).alias("p")).unionByName(edges.select(F.col("b").alias("node"), w.alias("w"), F.lit(0).alias("c"), F.when(F.col("rel") == -1, 1).otherwise(0).alias("p")))
    g = ends.groupBy("node").agg(F.sum("w").alias("degree"), F.sum("c").alias("customers"), F.sum("p").alias("providers"))
    return g.withColumn("peers", F.col("degree") - F.col("customers") - F.col("providers"))


def place_edges(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Links with the positions (alat, alon, blat, blon) of both ends; links of an unplaced end are left out."""
    p = positions.select(F.col("node").alias("a"), F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    q = positions.select(F.col("node").alias("b"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    return edges.join(p, "a").join(q, "b")


def customer_cones(edges: DataFrame, rounds: int | None = None, kernel: bool | None = None) -> DataFrame:
    """(node, cone): how many nodes a node reaches by going down to customers, itself included; cycles are no trouble.

    A graph of counted size goes to all executors, which search from their share of the nodes. A larger one takes the semi-naive closure:
    each round extends only the pairs that the last one found; its pairs are the sum of all cones.
    """
    edges = staged(edges.select("eid", "a", "b", "rel"), "edges")  # read several times
    graph = compact(edges.where(F.col("rel") == -1), False) if kernel is not False else None
    if graph is not None:
        sent = edges.sparkSession.sparkContext.broadcast(graph)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g = sent.value
            seen = np.full(len(g.ids), -1)
            for batch in batches:
                at = np.searchsorted(g.ids, batch["node"].to_numpy())
                at = np.minimum(at, max(len(g.ids) - 1, 0))
                cone = np.ones(len(batch), np.int64)
                for i, (v, node) in enumerate(zip(at, batch["node"], strict=True)):
                    if not len(g.ids) or g.ids[v] != node or g.first[v] == g.first[v + 1]:
                        continue
                    layer, n = np.array([v]), 1
                    seen[v] = v
                    while len(layer):
                        new = g.to[g.beside(layer)]
                        layer = np.unique(new[seen[new] != v])
                        seen[layer] = v
                        n += len(layer)
                    cone[i] = n
                yield pd.DataFrame({"node": batch["node"], "cone": cone})

        nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        # by a hash of the node, so that neighbours in number don't share a task
        return nodes.repartition(edges.sparkSession.sparkContext.defaultParallelism * 4, F.xxhash64("node")).mapInPandas(search, "node long, cone long")
    down = edges.where(F.col("rel") == -1).select(F.col("a").alias("mid"), F.col("b").alias("low")).distinct()
    down = staged(down, "down")
    # a node without customers is its own cone and nobody's middle
    new = down.select(F.col("mid").alias("top"), "low").where("top <> low")
    seen = staged(new, "cone")
    new = seen
    for _ in until_settled(rounds):
        step = new.join(down.withColumnRenamed("low", "next"), new.low == F.col("mid")).select("top", F.col("next").alias("low")).where("top <> low").distinct()
        new = staged(step.join(seen, ["top", "low"], "left_anti"), "cone")
        if new.isEmpty():
            break
        seen = staged(seen.unionByName(new), "seen")
    counts = seen.groupBy(F.col("top").alias("node")).agg((F.count("*") + 1).alias("cone"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return nodes.join(counts, "node", "left").select("node", F.coalesce("cone", F.lit(1).cast("long")).alias("cone"))


def peel(first: np.ndarray, to: np.ndarray, at: np.ndarray | None = None, value: np.ndarray | None = None) -> np.ndarray:
    """Core numbers of nodes whose links lie at ``to[first[i]:first[i + 1]]``. ``at`` are the ends of links to nodes elsewhere, ``value`` those
    nodes' core numbers, or bounds above them: such a link counts for cores up to its value.

    Each step looks at the links of what it takes away only, so long chains that come off end by end cost no more than others.
    """
    n = len(first) - 1
    degree = np.diff(first)
    if at is not None:
        o = np.argsort(value, kind="stable")
        at, value = at[o], value[o]
        degree = degree + np.bincount(at, minlength=n)
    core, alive, rest, gone = np.zeros(n, np.int64), np.ones(n, bool), np.arange(n), 0
    while len(rest):
        k = int(degree[rest].min())
        if at is not None and gone < len(at):
            k = min(k, int(value[gone]))
            end = int(np.searchsorted(value, k, "right"))
            degree -= np.bincount(at[gone:end], minlength=n)
            gone = end
        go = rest[degree[rest] <= k]
        while len(go):
            core[go], alive[go] = k, False
            count = first[go + 1] - first[go]
            near, lost = np.unique(to[np.repeat(first[go] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())], return_counts=True)
            degree[near] -= lost
            go = near[alive[near] & (degree[near] <= k)]
        rest = rest[alive[rest]]
    return core


def coreness(edges: DataFrame, rounds: int | None = None, kernel: bool | None = None, block: int = BLOCK_ENDS) -> DataFrame:
    """(node, core): k-core numbers. A graph of counted size is peeled in one task. The nodes of a larger one are cut into blocks of about
    ``block`` link ends; each round peels every block against the last values of the nodes outside it, which start at their degrees and
    only fall, until none does.

    Along a chain a round settles a whole block, not one node. A node's links are in one block, so a hub has its task hold all of its own.
    """
    edges = staged(edges.select("eid", "a", "b", "rel"), "edges")  # read several times
    graph = compact(edges.where("a <> b")) if kernel is not False else None
    if graph is not None:
        sent = edges.sparkSession.sparkContext.broadcast(graph)

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    g = sent.value
                    yield pd.DataFrame({"node": g.ids, "core": peel(g.first, g.to)})

        return edges.sparkSession.range(1).coalesce(1).mapInPandas(whole, "node long, core long")
    links = both_ways(edges.where("a <> b")).select("node", "other")
    parts = -(-links.count() // block)
    cuts = sorted(set(links.approxQuantile("node", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    of = lambda c: F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda x: x < F.col(c)))
    links = staged(links.select(of("node").alias("block"), "node", "other"), "links")
    far = staged(links.where(of("other") != F.col("block")).select("block", "other").distinct(), "far")
    value = staged(links.groupBy("node").agg(F.count("*").alias("core")), "core")

    def settle(own: pd.DataFrame, beyond: pd.DataFrame) -> pd.DataFrame:
        ids, x = np.unique(own["node"].to_numpy(), return_inverse=True)
        other = own["other"].to_numpy()
        y = np.minimum(np.searchsorted(ids, other), max(len(ids) - 1, 0))
        inside = ids[y] == other
        beyond = beyond.sort_values("other")
        value = beyond["core"].to_numpy()[np.searchsorted(beyond["other"].to_numpy(), other[~inside])]
        at, x, y = x[~inside], x[inside], y[inside]
        o = np.argsort(x, kind="stable")
        return pd.DataFrame({"node": ids, "core": peel(np.searchsorted(x[o], np.arange(len(ids) + 1)), y[o], at, value)})

    for _ in until_settled(rounds):
        near = far.join(value.withColumnRenamed("node", "other"), "other").select("block", "other", "core")
        settled = links.groupBy("block").cogroup(near.groupBy("block")).applyInPandas(settle, "node long, core long")
        new = staged(settled.join(value.withColumnRenamed("core", "old"), "node").select("node", "core", (F.col("core") < F.col("old")).alias("moved")), "core")
        value = new.select("node", "core")
        if not new.where("moved").head(1):
            break
    return value


def components(edges: DataFrame, nodes: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """(node, component): the least node of each connected component, by least labels and pointer jumping."""
    links = staged(both_ways(edges).select("node", "other").distinct(), "links")
    all_nodes = links.select("node").distinct() if nodes is None else nodes.select("node").union(links.select("node")).distinct()
    label = staged(all_nodes.withColumn("component", F.col("node")), "label")
    for _ in until_settled(rounds):
        near = links.join(label.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("n"))
        low = label.join(near, "node", "left").select("node", F.least("component", "n").alias("l"), F.col("component").alias("old"))
        jump = label.select(F.col("node").alias("l"), F.col("component").alias("ll"))
        new = staged(low.join(jump, "l").select("node", F.least("l", "ll").alias("component"), "old"), "label")
        label = new.select("node", "component")
        if not new.where("component <> old").head(1):
            break
    return label


def levels(cones: DataFrame, cores: DataFrame) -> DataFrame:
    """(node, level) from 0 to 1: blend of the logarithm of the cone and the core number, each against its largest."""
    j = cones.join(cores, "node", "left").select("node", F.log1p((F.col("cone") - 1).cast("double")).alias("l"), F.coalesce("core", F.lit(0)).alias("k"))
    top = j.agg(F.greatest(F.max("l"), F.lit(1e-9)).alias("ml"), F.greatest(F.max("k"), F.lit(1)).alias("mk"))
    level = 0.65 * F.col("l") / F.col("ml") + 0.35 * F.pow(F.col("k") / F.col("mk"), F.lit(1.5))
    return j.crossJoin(F.broadcast(top)).select("node", F.least(F.lit(1.0), F.greatest(F.lit(0.0), level)).alias("level"))


def backbone(edges: DataFrame, cones: DataFrame, level: DataFrame, core_level: float = 0.75) -> DataFrame:
    """(eid): each customer's link to the provider with the largest cone, links among core nodes, and links of nodes without provider."""
    p2c = edges.where(F.col("rel") == -1)
    best = p2c.join(cones.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min(F.struct((-F.col("cone")).alias("c"), "eid")).alias("k")).select(F.col("k.eid").alias("eid"))
    lv = lambda n: level.select(F.col("node").alias(n), F.col("level").alias(f"{n}_level"))
    core = edges.join(lv("a"), "a").join(lv("b"), "b").where((F.col("a_level") > core_level) & (F.col("b_level") > core_level)).select("eid")
    has = p2c.select(F.col("b").alias("node")).distinct().withColumn("has", F.lit(True))
    ends = both_ways(edges).join(has, "node", "left").where(F.col("has").isNull()).select("eid")
    return best.union(core).union(ends).distinct()


def spanning_forest(edges: DataFrame, cost: str, rounds: int | None = None) -> DataFrame:
    """(eid): minimum spanning forest by (cost, eid): in each round every component takes its cheapest way out."""
    e = staged(edges.where("a <> b").select("eid", "a", "b", F.col(cost).alias("cost")), "edges")
    chosen, label = None, None
    for _ in until_settled(rounds):
        if label is None:
            open_ = e.select("eid", "cost", F.col("a").alias("ca"), F.col("b").alias("cb"))
        else:
            la, lb = label.select(F.col("node").alias("a"), F.col("component").alias("ca")), label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
            open_ = e.join(la, "a").join(lb, "b").where("ca <> cb").select("eid", "cost", "ca", "cb")
        ways = open_.select("eid", "cost", F.col("ca").alias("c")).union(open_.select("eid", "cost", "cb"))
        new = ways.groupBy("c").agg(F.min(F.struct("cost", "eid")).alias("k")).select(F.col("k.eid").alias("eid")).distinct()
        new = staged(new if chosen is None else new.union(chosen), "forest")
        if chosen is not None and new.count() == chosen.count():
            break
        chosen = new
        label = components(e.join(chosen, "eid").select("eid", "a", "b", F.lit(1).alias("rel")), e.select(F.col("a").alias("node")).union(e.select("b")))
    return chosen.distinct()


def sample_trees(edges: DataFrame, roots: DataFrame, rounds: int | None = None, kernel: bool | None = None) -> DataFrame:
    """(eid, rank): the least tree number among the breadth-first trees of ``roots`` (tree, node) that use a link.

    A node's parent link is the one with the lowest eid from the layer before. Over a graph of counted size each tree is grown by itself, in
    parallel; over a larger one all trees grow together, one hop a round.
    """
    edges = staged(edges.select("eid", "a", "b", "rel"), "edges")  # read several times
    graph = compact(edges) if kernel is not False else None
    if graph is not None:
        sent = edges.sparkSession.sparkContext.broadcast(graph)

        def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g = sent.value
            for batch in batches:
                best = np.full(len(g.eid), np.iinfo(np.int64).max)
                for tree, node in zip(batch["tree"], batch["node"], strict=True):
                    v = int(np.searchsorted(g.ids, node))
                    if v == len(g.ids) or g.ids[v] != node:
                        continue
                    seen, layer = np.zeros(len(g.ids), bool), np.array([v])
                    seen[v] = True
                    while len(layer):
                        at = g.beside(layer)
                        to, link = g.to[at], g.link[at]
                        new = ~seen[to]
                        to, link = to[new], link[new]
                        o = np.lexsort((link, to))
                        to, link = to[o], link[o]
                        head = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, int)
                        best[link[head]] = np.minimum(best[link[head]], tree)
                        layer = to[head]
                        seen[layer] = True
                used = np.flatnonzero(best < np.iinfo(np.int64).max)
                yield pd.DataFrame({"eid": g.eid[used], "rank": best[used].astype(np.int32)})

        kind = roots.schema["tree"].dataType.simpleString()
        spread = roots.select("tree", "node").distinct().repartition(edges.sparkSession.sparkContext.defaultParallelism * 2, "tree")
        part = spread.mapInPandas(grow, "eid long, rank int")
        return part.groupBy("eid").agg(F.min("rank").cast(kind).alias("rank"))
    links = staged(both_ways(edges).select("node", "other", "eid"), "links")
    seen = staged(roots.select("tree", "node").distinct(), "seen")
    layer, used = seen, None
    for _ in until_settled(rounds):
        step = layer.join(links, "node").select("tree", F.col("other").alias("node"), "eid").join(seen, ["tree", "node"], "left_anti")
        new = staged(step.groupBy("tree", "node").agg(F.min("eid").alias("eid")), "layer")
        if new.isEmpty():
            break
        part = new.groupBy("eid").agg(F.min("tree").alias("rank"))
        used = staged(part if used is None else used.unionByName(part).groupBy("eid").agg(F.min("rank").alias("rank")), "used")
        layer = new.select("tree", "node")
        seen = staged(seen.unionByName(layer), "seen")
    return used


def _routes_kernel(graph: Compact, pairs: DataFrame, valley_free: bool) -> DataFrame:
    """:func:`routes` over arrays: one search over (phase, node) for each source, for all its targets."""
    spark = pairs.sparkSession
    sent = spark.sparkContext.broadcast(graph)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = sent.value
        n = len(g.ids)
        for batch in batches:
            out = []
            for src, part in batch.groupby("src"):
                out += [(src, src, [src]) for d in part["dst"] if d == src]
                v = int(np.searchsorted(g.ids, src))
                if v == n or g.ids[v] != src:
                    continue
                place = np.minimum(np.searchsorted(g.ids, part["dst"].to_numpy()), n - 1)
                want = {int(i) for i, d in zip(place, part["dst"], strict=True) if g.ids[i] == d and d != src}
                before, seen, layer = np.full(2 * n, -1), np.zeros(2 * n, bool), np.array([v])
                seen[v] = True
                while len(layer) and want:
                    p, u = layer // n, layer % n
                    count, at = g.first[u + 1] - g.first[u], g.beside(u)
                    pp, uu, rel, down = np.repeat(p, count), np.repeat(u, count), g.rel[at], g.down[at]
                    once = np.where(pp == 0, np.where(rel == 0, 1, 0), -1)
                    to = np.where(rel == 1, pp, np.where((rel == 0) | ((rel == -1) & ~down), once, 1)) if valley_free else np.zeros(len(at), int)
                    t = to * n + g.to[at]
                    ok = (to >= 0) & ~seen[t]
                    t, pp, uu, link = t[ok], pp[ok], uu[ok], g.link[at][ok]
                    o = np.lexsort((link, uu, pp, t))
                    t = t[o]
                    head = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, int)
                    layer = t[head]
                    before[layer] = (pp * n + uu)[o][head]
                    seen[layer] = True
                    for w in sorted({int(x) for x in layer % n} & want):
                        state, path = (w if seen[w] else w + n), []
                        while state >= 0:
                            path.append(int(g.ids[state % n]))
                            state = int(before[state])
                        out.append((src, int(g.ids[w]), path[::-1]))
                        want.discard(w)
            yield pd.DataFrame(out, columns=["src", "dst", "nodes"])

    spread = pairs.select("src", "dst").distinct().repartition(spark.sparkContext.defaultParallelism, "src")
    return spread.mapInPandas(walk, "src long, dst long, nodes array<long>").select("src", "dst", (F.size("nodes") - 1).alias("hops"), "nodes")


def routes(edges: DataFrame, pairs: DataFrame, rounds: int | None = None, valley_free: bool = True, kernel: bool | None = None) -> DataFrame:
    """(src, dst, hops, nodes): shortest routes for ``pairs`` (src, dst) that climb to providers, cross one peer link at most, and go down.

    Links within one network fit anywhere. Breadth-first over (node, phase), all pairs together; of equal steps the lowest state and eid holds.
    Pairs without route are missing. A graph of counted size is searched as arrays, a source at a time, in parallel.
    """
    edges = staged(edges.select("eid", "a", "b", "rel"), "edges")  # read several times
    graph = compact(edges) if kernel is not False else None
    if graph is not None:
        return _routes_kernel(graph, pairs, valley_free)
    links = staged(both_ways(edges).select("node", "other", "eid", "rel", "down"), "links")
    start = pairs.select("src", "dst").distinct()
    layer = staged(start.select("src", "dst", F.col("src").alias("node"), F.lit(0).alias("phase"), F.array("src").alias("nodes")), "layer")
    seen = layer.select("src", "dst", "node", "phase")
    done = layer.where("src = dst").select("src", "dst", "nodes")
    found = [done]
    open_pairs = start.where("src <> dst")
    up = (F.col("rel") == -1) & ~F.col("down")
    nxt = F.when(F.col("rel") == 1, F.col("phase")).when(up, F.when(F.col("phase") == 0, 0)).when(F.col("rel") == 0, F.when(F.col("phase") == 0, 1)).otherwise(1) if valley_free else F.lit(0)
    layer = layer.where("src <> dst")
    for _ in until_settled(rounds):
        step = layer.join(links, "node").withColumn("next", nxt).where(F.col("next").isNotNull())
        step = step.select("src", "dst", F.col("other").alias("node"), F.col("next").alias("phase"), F.struct("phase", "node", "eid").alias("via"), "nodes")
        best = step.join(seen, ["src", "dst", "node", "phase"], "left_anti").groupBy("src", "dst", "node", "phase").agg(F.min_by("nodes", "via").alias("before"))
        new = staged(best.select("src", "dst", "node", "phase", F.concat("before", F.array("node")).alias("nodes")), "layer")
        if new.isEmpty():
            break
        hit = new.where("node = dst").groupBy("src", "dst").agg(F.min_by("nodes", "phase").alias("nodes"))
        hit = staged(hit, "hit")
        found.append(hit)
        open_pairs = staged(open_pairs.join(hit, ["src", "dst"], "left_anti"), "open")
        seen = staged(seen.unionByName(new.select("src", "dst", "node", "phase")).join(open_pairs, ["src", "dst"], "left_semi"), "seen")
        layer = new.join(open_pairs, ["src", "dst"], "left_semi")
        if open_pairs.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("src", "dst", (F.size("nodes") - 1).alias("hops"), "nodes")


def routes_with_fallback(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Routes with ``valley_free``: where none is valley-free, the plain shortest path."""
    vf = staged(routes(edges, pairs), "routes").withColumn("valley_free", F.lit(True))
    rest = pairs.select("src", "dst").distinct().join(vf, ["src", "dst"], "left_anti")
    return vf.unionByName(routes(edges, rest, valley_free=False).withColumn("valley_free", F.lit(False)))


def shortest_costs(edges: DataFrame, sources: DataFrame, cost: str, rounds: int | None = None) -> DataFrame:
    """(node, dist, root): cheapest way from any of ``sources`` (node, start), by relaxing what has changed until nothing does. Costs below zero are refused.

    Sources are terminal: a way never leads through another source, which keeps its own start. Of equal ways the
    one from the least source holds.
    """
    if edges.where(F.col(cost) < 0).head(1):
        raise ValueError("a link's cost is below zero")
    links = both_ways(edges.select("eid", "a", "b", "rel")).join(edges.select("eid", F.col(cost).alias("cost")), "eid").select("node", "other", "cost")
    links = staged(links.join(sources.select(F.col("node").alias("other")).distinct(), "other", "left_anti"), "links")
    dist = staged(sources.groupBy("node").agg(F.min(F.struct(F.col("start").alias("dist"), F.col("node").alias("root"))).alias("k")).select("node", "k.dist", "k.root"), "dist")
    moved = dist
    for _ in until_settled(rounds):
        step = moved.join(links, "node").select(F.col("other").alias("node"), F.struct((F.col("dist") + F.col("cost")).alias("dist"), "root").alias("k"))
        best = step.groupBy("node").agg(F.min("k").alias("k")).select("node", F.col("k.dist").alias("nd"), F.col("k.root").alias("nr"))
        better = F.col("nd").isNotNull() & (F.col("dist").isNull() | (F.struct("nd", "nr") < F.struct("dist", "root")))
        all_ = staged(dist.join(best, "node", "full_outer").select("node", F.when(better, F.col("nd")).otherwise(F.col("dist")).alias("dist"), F.when(better, F.col("nr")).otherwise(F.col("root")).alias("root"), better.alias("moved")), "dist")
        dist, moved = all_.select("node", "dist", "root"), all_.where("moved").select("node", "dist", "root")
        if not moved.head(1):
            break
    return dist


def prune(pops: DataFrame, links: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """PoPs (pop, routers) with enough routers and a link left, and their links (a, b, ...): one pass is all it takes."""
    keep = pops.where(F.col("routers") >= least).select("pop")
    kept = links.join(keep.withColumnRenamed("pop", "a"), "a", "left_semi").join(keep.withColumnRenamed("pop", "b"), "b", "left_semi")
    linked = kept.select(F.col("a").alias("pop")).union(kept.select("b")).distinct()
    return pops.join(keep, "pop", "left_semi").join(linked, "pop", "left_semi"), kept


def tree_of_points(points: DataFrame, group: str, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(group, u, v, km): minimum spanning tree of each group's few points over great-circle distances (Prim)."""
    import numpy as np
    import pandas as pd

    from weftline.operators.spatial import great_circle

    def prim(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(key)
        k, y, x = df[key].to_numpy(), df[lat].to_numpy(), df[lon].to_numpy()
        best, via, inside, out = np.full(len(k), np.inf), np.zeros(len(k), int), np.zeros(len(k), bool), []
        at = 0
        inside[0] = True
        for _ in range(len(k) - 1):
            d = np.maximum(great_circle(y[at], x[at], y, x), 1e-3)
            near = ~inside & (d < best)
            best[near], via[near] = d[near], at
            at = int(np.where(inside, np.inf, best).argmin())
            inside[at] = True
            out.append((df[group].iloc[0], min(k[via[at]], k[at]), max(k[via[at]], k[at]), best[at]))
        return pd.DataFrame(out, columns=[group, "u", "v", "km"])

    types = {f.name: f.dataType.simpleString() for f in points.schema}
    return points.groupBy(group).applyInPandas(prim, f"{group} {types[group]}, u {types[key]}, v {types[key]}, km double")


def cluster_sites(sites: DataFrame, group: str, merge_km: float = 150.0, least_share: float = 0.005, most: int = 12) -> DataFrame:
    """(group, site, lat, lon, share, city): sites merged greedily, the largest first, each into the first cluster within reach.

    A group is one network's sites, at most a few dozen (top sites only).
    """
    import pandas as pd

    from weftline.operators.spatial import great_circle

    def merge(df: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        for r in df.sort_values(["share", "city"], ascending=[False, True]).itertuples():
            home = next((k for k in kept if great_circle(k[0], k[1], r.lat, r.lon) <= merge_km), None)
            if home:
                home[2] += r.share
            elif r.share >= least_share and len(kept) < most:
                kept.append([r.lat, r.lon, r.share, r.city])
        return pd.DataFrame([(df[group].iloc[0], i, *k) for i, k in enumerate(kept)], columns=[group, "site", "lat", "lon", "share", "city"])

    kind = sites.schema[group].dataType.simpleString()
    return sites.groupBy(group).applyInPandas(merge, f"{group} {kind}, site int, lat double, lon double, share double, city string")
