"""Communities: Leiden, its quality functions, coarsening and drift.

Quality, coarsening, aggregation and drift are DataFrame operations. The optimiser takes one connected component after
another, each with the whole graph's weight: on the driver for graphs of at most DRIVER_EDGES aggregated pairs, in grouped
tasks for larger ones, with the same results. Nodes of a component move one after another up to SERIAL_EDGES pairs, wherever
it is solved; in larger components, many move at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, pieces
from .cycles import DRIVER_EDGES, _tied, connected

#: Pairs of a connected component that one task optimises at most.
TASK_EDGES = 20_000_000
#: Pairs of a connected component up to which its nodes move one after another (about a minute).
SERIAL_EDGES = DRIVER_EDGES
#: Ends of pairs that are sorted at a time.
_BULK = 1 << 22


def undirected_pairs(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Rows 200-201: (a, b, w), a <= b: reciprocal pairs summed; weight 1 without one."""
    w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    rows = edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), w.alias("w"))
    return rows.groupBy("a", "b").agg(F.sum("w").alias("w"))


def loose_pairs(edges: DataFrame) -> DataFrame:
    """(a, b, w) with a row an edge: for sums over pairs, which need no row a pair."""
    return edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.lit(1.0).alias("w"))


def community_sums(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """Rows 376-377: (community, inner, degree, size): inner weight, summed node strength, nodes."""
    ma, mb = (membership.select(F.col("node").alias(x), F.col("community").alias(f"c{x}")) for x in "ab")
    # Tasks as the input asks for, not as the session says: each sorts its own rows.
    n = pieces(pairs)
    rows = pairs.repartition(n, "a").join(ma, "a").repartition(n, "b").join(mb, "b")
    ends = rows.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("w").alias("d")), F.struct(F.col("cb").alias("c"), F.col("w").alias("d")))).alias("e"), F.lit(0.0).alias("i")).select("e.c", "e.d", "i")
    inner = rows.filter("ca = cb").select(F.col("ca").alias("c"), F.lit(0.0).alias("d"), F.col("w").alias("i"))
    sums = ends.unionByName(inner).groupBy(F.col("c").alias("community")).agg(F.sum("i").alias("inner"), F.sum("d").alias("degree"))
    return membership.groupBy("community").agg(F.count(F.lit(1)).alias("size")).join(sums, "community", "left").fillna(0.0, ["inner", "degree"])


def modularity(pairs: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Row 197: one row: sum over communities of inner/m - gamma (degree/2m)^2."""
    m = pairs.agg(F.sum("w").alias("m"))
    rows = community_sums(pairs, membership).crossJoin(F.broadcast(m))
    return rows.agg(F.sum(F.col("inner") / F.col("m") - gamma * F.pow(F.col("degree") / (2 * F.col("m")), 2)).alias("quality"))


def cpm(pairs: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Row 199: constant Potts: sum of inner - gamma n(n-1)/2."""
    return community_sums(pairs, membership).agg(F.sum(F.col("inner") - gamma * F.col("size") * (F.col("size") - 1) / 2).alias("quality"))


def coarsen(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """Row 196: pairs between communities, weights summed."""
    ma, mb = (membership.select(F.col("node").alias(x), F.col("community").alias(f"c{x}")) for x in "ab")
    rows = pairs.join(ma, "a").join(mb, "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "w")
    return rows.groupBy("a", "b").agg(F.sum("w").alias("w"))


def mulberry(seed: int):
    """Row 202: the 32-bit generator of that name, as a function of no argument."""
    state = seed & 0xFFFFFFFF

    def step() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = state
        t = ((t ^ (t >> 15)) * (t | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296

    return step


def modularity_gain(links: float, strength: float, degree: float, total: float, gamma: float = 1.0) -> float:
    """Row 198: what a node of `strength` adds to a community of `degree` that it has `links` to, up to the factor 1/m."""
    return links - gamma * strength * degree / (2 * total)


def directed_modularity_gain(links_in: float, links_out: float, strength_in: float, strength_out: float, degree_in: float, degree_out: float, total: float, gamma: float = 1.0) -> float:
    """Row 379: the same where edges have directions; total is the weight of all of them."""
    return links_in + links_out - gamma * (strength_out * degree_in + strength_in * degree_out) / total


def cpm_gain(links: float, size: float, members: float, gamma: float = 1.0) -> float:
    """Row 378: what a node that stands for `size` ones adds to a community of `members` by the constant Potts model."""
    return links - gamma * size * members


def split_disconnected(pairs: list[tuple], found: dict) -> dict:
    """Row 195: communities whose members are not all tied within are split into their connected parts, named by their
    least members."""
    inner = [(a, b, w) for a, b, w in pairs if found[a] == found[b]]
    out = {x: x for x in found}
    for part in _parts(inner):
        members = {x for a, b, _ in part for x in (a, b)}
        out |= dict.fromkeys(members, min(members))
    return out


def leiden(pairs: list[tuple], gamma: float = 1.0, seed: int = 42, theta: float = 1.0, max_levels: int = 50, max_passes: int = 20, total: float | None = None, quality: str = "modularity") -> dict:
    """Rows 191-195: node -> community (least member): local moves, random refinement inside communities, coarsening, and
    at the end a split of communities that fall apart. total is the weight of the whole graph, if pairs are a part of it;
    quality is modularity or cpm."""
    return split_disconnected(pairs, _leiden(pairs, gamma, seed, theta, max_levels, max_passes, total, quality))


def _leiden(pairs: list[tuple], gamma: float, seed: int, theta: float, max_levels: int, max_passes: int, total: float | None, quality: str) -> dict:
    # By the constant Potts model, a node's mass is the number of nodes it stands for; by modularity, its strength.
    potts = quality == "cpm"
    rng = mulberry(seed)
    names = sorted({x for a, b, _ in pairs for x in (a, b)})
    at = {x: i for i, x in enumerate(names)}
    graph: list[dict[int, float]] = [{} for _ in names]
    loops = [0.0] * len(names)
    for a, b, w in pairs:
        i, j = at[a], at[b]
        if i == j:
            loops[i] += w
        else:
            graph[i][j] = graph[i].get(j, 0.0) + w
            graph[j][i] = graph[j].get(i, 0.0) + w
    total = sum(loops) + sum(sum(g.values()) for g in graph) / 2 if total is None else total
    if not total:
        return {x: x for x in names}
    scale = 1.0 if potts else 2 * total
    held = [1.0] * len(names)
    group = list(range(len(names)))  # of original nodes: the coarse node that holds them
    start = None
    for _ in range(max_levels):
        n = len(graph)
        strength = held if potts else [2 * loops[i] + sum(graph[i].values()) for i in range(n)]
        part = list(range(n)) if start is None else start
        sums: dict[int, float] = {}
        for i in range(n):
            sums[part[i]] = sums.get(part[i], 0.0) + strength[i]
        moved_any = False
        for _ in range(max_passes):
            order, moved = _shuffled(n, rng), False
            for i in order:
                links: dict[int, float] = {}
                for j, w in graph[i].items():
                    links[part[j]] = links.get(part[j], 0.0) + w
                own = part[i]
                sums[own] -= strength[i]
                stay = links.get(own, 0.0) - gamma * strength[i] * sums[own] / scale
                best, gain = own, 1e-12
                for c in sorted(links):
                    g = links[c] - gamma * strength[i] * sums.get(c, 0.0) / scale - stay
                    if g > gain:
                        best, gain = c, g
                sums[best] = sums.get(best, 0.0) + strength[i]
                part[i] = best
                moved = moved or best != own
            moved_any = moved_any or moved
            if not moved:
                break
        fine = _refined(graph, strength, part, gamma, scale, theta, rng)
        label = {c: k for k, c in enumerate(sorted(set(fine)))}
        if not moved_any and len(label) == n or len(label) == n:
            return _named(names, [part[group[i]] for i in range(len(names))])
        coarse: list[dict[int, float]] = [{} for _ in label]
        inner, count = [0.0] * len(label), [0.0] * len(label)
        start = [0] * len(label)
        for i in range(n):
            a = label[fine[i]]
            inner[a] += loops[i]
            count[a] += held[i]
            start[a] = part[i]
            for j, w in graph[i].items():
                b = label[fine[j]]
                if a == b:
                    inner[a] += w / 2
                else:
                    coarse[a][b] = coarse[a].get(b, 0.0) + w
        ids = {c: k for k, c in enumerate(sorted(set(start)))}
        start = [ids[c] for c in start]
        group = [label[fine[g]] for g in group]
        graph, loops, held = coarse, inner, count
    return _named(names, [start[group[i]] for i in range(len(names))])


def _shuffled(n: int, rng) -> list[int]:
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = int(rng() * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def _refined(graph, strength, part, gamma, scale, theta, rng) -> list[int]:
    """From singletons, one random sweep: each node that is still alone may join a neighbour's subset of its community."""
    n = len(graph)
    fine, sums, size = list(range(n)), list(strength), [1] * n
    for i in _shuffled(n, rng):
        if size[fine[i]] > 1:
            continue
        links: dict[int, float] = {}
        for j, w in graph[i].items():
            if part[j] == part[i]:
                links[fine[j]] = links.get(fine[j], 0.0) + w
        options = [(fine[i], 0.0)]
        for c in sorted(links):
            gain = links[c] - gamma * strength[i] * sums[c] / scale
            if c != fine[i] and gain > 0:
                options.append((c, gain))
        top = max(g for _, g in options)
        weights = [math.exp((g - top) / theta) for _, g in options]
        pick = rng() * sum(weights)
        for (c, _), w in zip(options, weights):
            pick -= w
            if pick <= 0:
                break
        if c != fine[i]:
            size[fine[i]] -= 1
            sums[fine[i]] -= strength[i]
            fine[i] = c
            size[c] += 1
            sums[c] += strength[i]
    return fine


def _named(names: list, part: list) -> dict:
    least: dict = {}
    for x, c in zip(names, part):
        least.setdefault(c, x)
    return {x: least[c] for x, c in zip(names, part)}


class _Ends:
    """Both ends of the pairs of nodes 0..n-1, by node: those of i are to[first[i] : first[i + 1]]; loops stand apart."""

    def __init__(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, loops: np.ndarray):
        """a, b, w: both directions of each pair, each once."""
        order = np.argsort(a, kind="stable")
        self.n, self.loops, self.to, self.w = len(loops), loops, b[order].astype(np.int32), w[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=self.n))])
        self.strength = 2 * loops + np.bincount(a, w, self.n)

    def source(self) -> np.ndarray:
        return np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.first))

    def links(self, nodes: np.ndarray, label: np.ndarray, within: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(node, label, weight of the node's pairs to it) by node and label, for some nodes at a time; within: only to
        nodes with the same of it."""
        sizes = self.first[nodes + 1] - self.first[nodes]
        for own, size in zip(*(np.split(x, np.flatnonzero(np.diff(np.cumsum(sizes) // _BULK)) + 1) for x in (nodes, sizes))):
            ends = np.cumsum(size)
            if not len(ends) or not ends[-1]:
                continue
            at = np.arange(ends[-1]) + np.repeat(self.first[own] - ends + size, size)
            node, to, w = np.repeat(own, size), self.to[at], self.w[at]
            if within is not None:
                same = within[to] == within[node]
                node, to, w = node[same], to[same], w[same]
            yield _summed(node, label[to], w, self.n)

    def worth(self, part: np.ndarray, gamma: float, scale: float) -> float:
        """Modularity, up to its scale."""
        inner = sum(self.w[i : i + _BULK][part[self.to[i : i + _BULK]] == part[s]].sum() for i, s in self._slices())
        return self.loops.sum() + inner / 2 - gamma * np.square(np.bincount(part, self.strength, self.n)).sum() / (2 * scale)

    def _slices(self) -> Iterator[tuple[int, np.ndarray]]:
        source = self.source()
        return ((i, source[i : i + _BULK]) for i in range(0, len(source), _BULK))

    def coarse(self, label: np.ndarray, n: int) -> _Ends:
        """Nodes with the same label, 0..n-1, become one."""
        found = []
        inner = np.bincount(label, self.loops, n)
        for i, source in self._slices():
            a, b, w = label[source], label[self.to[i : i + _BULK]], self.w[i : i + _BULK]
            far = a != b
            inner += np.bincount(a[~far], w[~far], n) / 2
            found.append(_summed(a[far], b[far], w[far], n))
        a, b, w = (np.concatenate([x[k] for x in found]) for k in range(3))
        return _Ends(*(_summed(a, b, w, n)), inner)


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b) of numbers below n, in order, with their summed w."""
    key = a.astype(np.int64) * n + b
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    return key[new] // n, key[new] % n, np.add.reduceat(w[order], new) if len(new) else w[:0]


def _tops(node: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Of rows by node, the first one with the greatest score of each node."""
    new = np.flatnonzero(np.diff(node, prepend=-1))
    if not len(new):
        return new
    top = np.flatnonzero(score == np.repeat(np.maximum.reduceat(score, new), np.diff(np.append(new, len(node)))))
    return top[np.flatnonzero(np.diff(node[top], prepend=-1))]


def _moved_at_once(graph: _Ends, part: np.ndarray, gamma: float, scale: float, rng, max_passes: int) -> np.ndarray:
    """Local moves in rounds: a random half of the nodes choose by the communities as they are, and go together. A round
    that makes things worse is not taken, and the next ones are of half as many nodes."""
    share, worth = 0.5, graph.worth(part, gamma, scale)
    strength = graph.strength
    for _ in range(max_passes):
        sums = np.bincount(part, strength, graph.n)
        after = part.copy()
        for node, c, links in graph.links(np.flatnonzero(rng.random(graph.n) < share), part):
            own = part[node] == c
            stay = np.zeros(graph.n)
            stay[node[own]] = links[own]
            node, c, links = node[~own], c[~own], links[~own]
            stays = stay[node] - gamma * strength[node] * (sums[part[node]] - strength[node]) / scale
            gain = links - gamma * strength[node] * sums[c] / scale - stays
            best = _tops(node, gain)
            best = best[gain[best] > 1e-12]
            after[node[best]] = c[best]
        now = graph.worth(after, gamma, scale)
        if now > worth:
            part, gained, worth = after, now - worth, now
            if gained < 1e-6 * scale:
                break
        elif share < 0.05:
            break
        else:
            share /= 2
    return part


def _refined_at_once(graph: _Ends, part: np.ndarray, gamma: float, scale: float, theta: float, rng) -> np.ndarray:
    """From singletons, in rounds: of each community's subsets a random half stay, and nodes of the others that are still
    alone may join one that they have a pair to, or stay alone, by the same chances as in _refined."""
    fine, strength = np.arange(graph.n), graph.strength
    sums, size = strength.copy(), np.ones(graph.n, np.int64)
    for _ in range(4):
        stays = rng.random(graph.n) < 0.5
        after = fine.copy()
        for node, c, links in graph.links(np.flatnonzero((fine == np.arange(graph.n)) & (size == 1) & ~stays), fine, part):
            gain = links - gamma * strength[node] * sums[c] / scale
            some = stays[c] & (gain > 0)
            node, c, gain = node[some], c[some], gain[some]
            score = gain / theta + rng.gumbel(size=len(gain))
            best = _tops(node, score)
            best = best[score[best] > rng.gumbel(size=len(best))]
            after[node[best]] = c[best]
        fine = after
        sums, size = np.bincount(fine, strength, graph.n), np.bincount(fine, minlength=graph.n)
    return fine


def leiden_at_once(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, gamma: float = 1.0, seed: int = 42, theta: float = 1.0, max_levels: int = 50, max_passes: int = 20, total: float | None = None) -> np.ndarray:
    """Rows 191-195 for a large graph: the community (least member) of nodes 0..n-1. The steps of leiden() by modularity,
    over whole arrays: many nodes move at a time, in rounds. Memory and time of a level grow with its pairs."""
    rng = np.random.default_rng(seed)
    loop = a == b
    both = [np.concatenate([x[~loop], y[~loop]]) for x, y in ((a, b), (b, a), (w, w))]
    graph = _Ends(*both, np.bincount(a[loop], w[loop], n))
    del both
    total = graph.strength.sum() / 2 if total is None else total
    if not total:
        return np.arange(n)
    group, part = np.arange(n), np.arange(n)
    for _ in range(max_levels):
        part = _moved_at_once(graph, part, gamma, 2 * total, rng, max_passes)
        label, fine = np.unique(_refined_at_once(graph, part, gamma, 2 * total, theta, rng), return_inverse=True)
        if len(label) == graph.n:
            break
        graph, group = graph.coarse(fine, len(label)), fine[group]
        # A subset is named by one of its nodes, which is in the community of them all.
        part = np.unique(part[label], return_inverse=True)[1]
    found = part[group]
    inner = found[a] == found[b]
    names, up = _tied(pa.table({"a": a[inner], "b": b[inner]}))
    out = np.arange(n)
    out[names.to_numpy()] = names.to_numpy()[up]
    return out


def _optimised(pairs: pa.Table, gamma: float, seed: int, total: float) -> pa.Table:
    """(node, community) of a connected component's pairs (a, b, w)."""
    a, b, w = (pairs[c].combine_chunks() for c in "abw")
    if len(w) <= SERIAL_EDGES:
        found = leiden(sorted(zip(*(x.to_pylist() for x in (a, b, w)))), gamma, seed, total=total)
        return pa.table({"node": pa.array(list(found), a.type), "community": pa.array(list(found.values()), a.type)})
    names = pa.chunked_array([a, b]).unique().sort()
    a, b = (pc.index_in(x, value_set=names).to_numpy() for x in (a, b))
    order = np.lexsort((b, a))
    found = leiden_at_once(a[order], b[order], w.to_numpy()[order], len(names), gamma, seed, total=total)
    return pa.table({"node": names, "community": names.take(pa.array(found))})


def communities(edges: DataFrame, weight: str | None = None, gamma: float = 1.0, seed: int = 42, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """Rows 191, 203, 373: (node, community), community the least member."""
    pairs = cut(undirected_pairs(edges, weight))
    kind = dict(pairs.dtypes)["a"]
    n, total = pairs.agg(F.count(F.lit(1)), F.sum("w")).first()
    if n <= min(driver_edges, SERIAL_EDGES):
        parts = _parts(sorted(tuple(r) for r in pairs.collect()))
        found = {x: c for part in parts for x, c in leiden(part, gamma, seed, total=total).items()}
        return edges.sparkSession.createDataFrame(sorted(found.items()), f"node {kind}, community {kind}")
    # Modularity couples components only through the total weight; a component is the unit of a task.
    of = cut(connected(pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))))
    tagged = cut(pairs.join(of.withColumnRenamed("node", "a"), "a"))
    sizes = tagged.groupBy("component").count()
    largest = sizes.agg(F.max("count")).first()[0]
    if largest > TASK_EDGES:
        raise ValueError(f"a connected component of {largest:,} pairs is more than one task takes ({TASK_EDGES:,})")
    # Many more tasks than cores, as components differ.
    dealt = tagged.repartition(max(1, min(4096, n // 10_000)), "component")
    return dealt.groupBy("component").applyInArrow(lambda own: _optimised(own, gamma, seed, total), f"node {kind}, community {kind}")


def _parts(pairs: list[tuple]) -> list[list[tuple]]:
    """The pairs of each connected component, in their order."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b, _ in pairs:
        up[top(a)] = top(b)
    parts: dict = {}
    for pair in pairs:
        parts.setdefault(top(pair[0]), []).append(pair)
    return list(parts.values())


def drift(membership: DataFrame) -> DataFrame:
    """Row 204: membership has (community, directory); one row: split_directories, merge_communities, drift_score."""
    rows = membership.select("community", "directory").distinct()
    dirs = rows.groupBy("directory").count().agg(F.count(F.lit(1)).alias("nd"), F.count_if(F.col("count") >= 2).alias("split_directories"))
    comms = rows.groupBy("community").count().agg(F.count(F.lit(1)).alias("nc"), F.count_if(F.col("count") >= 2).alias("merge_communities"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    score = F.floor((ratio("split_directories", "nd") + ratio("merge_communities", "nc")) / 2 * 100 + 0.5).cast("int")
    return dirs.crossJoin(comms).select("split_directories", "merge_communities", score.alias("drift_score"))
