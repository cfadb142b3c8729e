"""Embedding near-dedup over a robust-pruned flat graph built on overlapping cluster shards.

1. Equal vectors of a label become one node, with their number.
2. Shards: a label with more than `shard_rows` nodes is split around pivots (a hash sample of
   its own nodes), again and again until every part is small. Every node goes to its two nearest pivots, so
   shards overlap; the path of nearest pivots ends in its main shard.
3. Each shard's graph: nearest neighbours, thinned by robust pruning, with back edges. The
   adjacency lists of all shards a node is in are united into one flat graph.
4. Search: every node is a query. In its main shard a greedy search runs from the medoid, then
   expands through all nodes within a somewhat wider range. Where it reaches nodes that stand in
   other shards too, it goes on there from these, round by round, until no query enters another shard.
   Only cosines of nodes that the search meets are computed.
5. Pairs within reach are verified by their cosine in double precision. A node is counted in its
   main shard alone, so counts add up over shards, and only rows in proportion to (query, shard)
   visits leave a task, never pairs. A shard that lies as a whole inside the threshold around a query is
   counted without a search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshgrain.llm.common import Batches, components, discard, stash

SHARD_ROWS, MOST_PIVOTS, DEGREE, BEAM, SLACK = 1024, 256, 12, 12, 0.05
#: Queries of one shard that a task takes at a time, queries searched together, entries carried to another shard.
CHUNK, BLOCK, ENTRIES = 4096, 256, 4
_KEY = ["label", "size", "shard"]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 1))


def dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, step: int = 32768) -> np.ndarray:
    """Products of rows a[i] and b[j], a bounded number of them at a time."""
    out = np.empty(len(i), a.dtype)
    for lo in range(0, len(i), step):
        out[lo : lo + step] = np.einsum("nd,nd->n", a[i[lo : lo + step]], b[j[lo : lo + step]])
    return out


def robust_graph(x: np.ndarray, degree: int, alpha: float = 1.2) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of a graph on unit vectors: nearest first, leaving out what a kept
    neighbour is alpha times nearer to; with the nearest 2 * degree back edges of each node."""
    n = len(x)
    width = min(n - 1, 4 * degree)
    if width <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sources, targets, near_by = [], [], []
    for lo in range(0, n, BLOCK):
        rows = np.arange(lo, min(lo + BLOCK, n))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -np.inf
        cand = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        cand = np.take_along_axis(cand, np.argsort(-np.take_along_axis(sims, cand, 1), axis=1, kind="stable"), 1)
        near = np.take_along_axis(sims, cand, 1)
        far = np.sqrt(np.maximum(0, 2 - 2 * near))
        between = np.sqrt(np.maximum(0, 2 - 2 * (x[cand] @ x[cand].transpose(0, 2, 1))))
        alive, at = np.ones(cand.shape, bool), np.arange(len(rows))
        for _ in range(degree):
            first = alive.argmax(1)
            some = alive[at, first]
            sources.append(rows[some])
            targets.append(cand[at, first][some])
            near_by.append(near[at, first][some])
            alive[at, first] = False
            alive &= ~((alpha * between[at, first] <= far) & some[:, None])
    a, b, s = (np.concatenate(part) for part in (sources, targets, near_by))
    order = np.lexsort((-s, b))
    first = np.searchsorted(b[order], np.arange(n))
    back = order[np.arange(len(b)) - first[b[order]] < 2 * degree]
    edges = np.unique(np.r_[a * n + b, b[back] * n + a[back]])
    return edges // n, edges % n


def shard_graph(table: pa.Table) -> pa.Table:
    """(node, shard, near): adjacency lists of one shard."""
    node = table["node"].to_numpy()
    a, b = robust_graph(_matrix(table["vector"]).astype(np.float32), DEGREE)
    edge = np.searchsorted(a, np.arange(len(node) + 1)).astype(np.int32)
    return pa.table({"node": pa.array(node), "shard": table["shard"], "near": pa.ListArray.from_arrays(pa.array(edge), pa.array(node[b]))})


class Shard:
    """Nodes of a shard with the lists of the united graph, as far as they stay in the shard."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by("node").combine_chunks()
        self.node, self.weight, self.main = table["node"].to_numpy(), table["n"].to_numpy(), table["main"].to_numpy(zero_copy_only=False)
        self.shard = table["shard"][0].as_py()
        self.x = _matrix(table["vector"])
        self.fine = self.x.astype(np.float32)
        mean = self.x.mean(0)
        self.medoid = int(np.argmax(self.x @ mean))
        self.centre = mean / max(np.linalg.norm(mean), 1e-12)
        self.radius = float(np.arccos(np.clip(self.x @ self.centre, -1, 1)).max())
        owner, target = self._flat(table["near"])
        at, inside = self.places(target)
        owner, at = owner[inside], at[inside]
        place = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(self.node)))[owner]
        self.table = np.full((len(self.node), int(place.max(initial=0)) + 1), -1, np.int32)
        self.table[owner, place] = at
        owner, home = self._flat(table["homes"])
        other = home != self.shard
        self.home_owner, self.home = owner[other], home[other]
        self.home_edge = np.searchsorted(self.home_owner, np.arange(len(self.node) + 1))

    @staticmethod
    def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()

    def places(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
        return at, self.node[at] == node

    def greedy(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) and their cosines in the beams of greedy searches from the medoid."""
        m, n = len(y), len(self.node)
        beam, sims, done = np.full((m, BEAM), -1), np.full((m, BEAM), -np.inf, np.float32), np.zeros((m, BEAM), bool)
        seen = np.zeros((m, n), bool)
        beam[:, 0], sims[:, 0] = self.medoid, y @ self.fine[self.medoid]
        seen[:, self.medoid] = True
        active = np.arange(m)
        while True:
            open_ = np.where(~done[active] & (beam[active] >= 0), sims[active], -np.inf)
            best = open_.argmax(1)
            go = open_[np.arange(len(active)), best] > -np.inf
            active, best = active[go], best[go]
            if not len(active):
                keep = beam >= 0
                return np.nonzero(keep)[0] * n + beam[keep], sims[keep]
            done[active, best] = True
            near = self.table[beam[active, best]]
            fresh = (near >= 0) & ~seen[active[:, None], near]
            who = np.repeat(active, fresh.sum(1))
            seen[who, near[fresh]] = True
            new = np.full(near.shape, -np.inf, np.float32)
            new[fresh] = dots(y, who, self.fine, near[fresh])
            both = np.concatenate([sims[active], new], 1)
            top = np.argsort(-both, axis=1, kind="stable")[:, :BEAM]
            sims[active] = np.take_along_axis(both, top, 1)
            beam[active] = np.where(np.isfinite(sims[active]), np.take_along_axis(np.concatenate([beam[active], near], 1), top, 1), -1)
            done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros(near.shape, bool)], 1), top, 1)

    def expand(self, y: np.ndarray, key: np.ndarray, sim: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
        """All (query * nodes + node) and cosines that range expansion reaches from those given, all of `low` or more."""
        n = len(self.node)
        tested = np.zeros(len(y) * n, bool)
        tested[key] = True
        found, sims = [key], [sim]
        while len(key):
            near = self.table[key % n]
            ok = near >= 0
            reach = ((key // n * n)[:, None] + near)[ok]
            mark = np.zeros(len(tested), bool)
            mark[reach] = True
            key = np.flatnonzero(mark & ~tested)
            tested[key] = True
            sim = dots(y, key // n, self.fine, key % n)
            key, sim = key[sim >= low], sim[sim >= low]
            found.append(key)
            sims.append(sim)
        return np.concatenate(found), np.concatenate(sims)


def visit(nodes: pa.Table, visits: pa.Table, threshold: float) -> pa.Table:
    """What queries find in a shard: (node, root, links, exits, known).

    links counts the linked nodes that have this as their main shard; (node, root) are edges that join
    queries and nodes as links do; exits are shards to go on in that the query does not know yet, with nodes to start from.
    """
    exit_type = pa.list_(pa.struct([("shard", pa.int64()), ("entries", pa.list_(pa.int64()))]))
    none = pa.table({"node": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "exits": pa.array([], exit_type), "known": pa.array([], pa.list_(pa.int64()))})
    if not len(nodes) or not len(visits):
        return none
    shard = Shard(nodes)
    n, low = len(shard.node), threshold - SLACK
    visits = visits.sort_by("query").combine_chunks()
    query, y = visits["query"].to_numpy(), _matrix(visits["sought"])
    start, entry = Shard._flat(visits["entries"])
    first = np.diff(np.searchsorted(start, np.arange(len(query) + 1))) == 0  # no entries: the main shard
    others, home = np.unique(shard.home, return_inverse=True)
    knows, known = Shard._flat(visits["known"])
    at = np.minimum(np.searchsorted(others, known), max(len(others) - 1, 0))
    stale = np.zeros((len(query), len(others)), bool)
    if len(others):
        ok = others[at] == known
        stale[knows[ok], at[ok]] = True
    angle = np.arccos(np.clip(y @ shard.centre, -1, 1))
    # a hair's breadth is left to the search, which decides in double precision
    whole = angle + shard.radius <= np.arccos(threshold) - 1e-6
    weight = np.where(shard.main, shard.weight, 0)
    links, group = np.zeros(len(query), np.int64), np.full(len(query), -1)
    own, has_own = shard.places(query)
    label = np.arange(n)
    ways: list[list[dict]] = [[] for _ in query]

    def join(q: np.ndarray, v: np.ndarray) -> None:
        """Unites the groups of all nodes that a query links with."""
        nonlocal label
        while len(q):
            least = np.full(len(query), n)
            np.minimum.at(least, q, label[v])
            parent = np.arange(n)
            np.minimum.at(parent, label[v], least[q])
            if (parent == np.arange(n)).all():
                return
            while (parent[parent] != parent).any():
                parent = parent[parent]
            label = parent[label]

    for lo in range(0, len(query), BLOCK):
        part = np.arange(lo, min(lo + BLOCK, len(query)))
        part = part[~whole[part]]
        if not len(part):
            continue
        fine = y[part].astype(np.float32)
        new = np.flatnonzero(first[part])
        key, sim = shard.greedy(fine[new])
        key = new[key // n] * n + key % n
        mine = np.flatnonzero(has_own[part])
        here = np.flatnonzero(np.isin(start, part))
        at, inside = shard.places(entry[here])
        more = np.r_[mine * n + own[part][mine], np.searchsorted(part, start[here][inside]) * n + at[inside]]
        key, sim = np.r_[key, more], np.r_[sim, dots(fine, more // n, shard.fine, more % n)]
        key, once = np.unique(key[sim >= low], return_index=True)
        key, sim = shard.expand(fine, key, sim[sim >= low][once], low)
        q, v = part[key // n], key % n
        near = sim >= threshold - 1e-4
        qn, vn = q[near], v[near]
        ok = dots(y, qn, shard.x, vn) >= threshold
        qn, vn = qn[ok], vn[ok]
        group[qn] = vn
        other = shard.node[vn] != query[qn]
        links += np.bincount(qn[other], weight[vn[other]], minlength=len(query)).astype(np.int64)
        join(qn, vn)
        # other shards of what was reached, with the nearest nodes to start from
        size = np.diff(shard.home_edge)[v]
        pick = np.repeat(shard.home_edge[v] - np.cumsum(size) + size, size) + np.arange(size.sum())
        q, sim, v = np.repeat(q, size), np.repeat(sim, size), np.repeat(v, size)
        to = home[pick]
        new = ~stale[q, to] if len(q) else np.zeros(0, bool)
        q, sim, v, to = q[new], sim[new], v[new], to[new]
        order = np.lexsort((-sim, to, q))
        q, to, v = q[order], others[to[order]] if len(order) else to, v[order]
        head = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (to[1:] != to[:-1])]) if len(q) else np.zeros(0, np.int64)
        for a, b in zip(head, [*head[1:], len(q)], strict=False):
            ways[q[a]].append({"shard": int(to[a]), "entries": shard.node[v[a : min(b, a + ENTRIES)]].tolist()})
    if whole.any():
        all_ = np.flatnonzero(whole)
        links[all_] = weight.sum() - np.where(has_own[all_], weight[own[all_]], 0)
        group[all_] = 0
        join(np.full(n, all_[0]), np.arange(n))
        order = np.argsort(home, kind="stable")
        edge = np.searchsorted(home[order], np.arange(len(others) + 1))
        out = [{"shard": int(t), "entries": shard.node[shard.home_owner[order[a : min(b, a + ENTRIES)]]].tolist()} for t, a, b in zip(others, edge, edge[1:], strict=False)]
        for i in all_:
            ways[i] = [out[k] for k in np.flatnonzero(~stale[i])]
    # the least node of each group, queries included
    root = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(root, label, shard.node)
    tied = group >= 0
    np.minimum.at(root, label[group[tied]], query[tied])
    of_query = np.where(tied, root[label[np.maximum(group, 0)]], query)
    apart = root[label] != shard.node
    rows = [np.r_[query, shard.node[apart]], np.r_[of_query, root[label][apart]], np.r_[links, np.zeros(apart.sum(), np.int64)]]
    return pa.table({"node": rows[0], "root": rows[1], "links": rows[2], "exits": pa.array(ways + [[]] * int(apart.sum()), exit_type), "known": pa.array([k if w else [] for k, w in zip(visits["known"].to_pylist(), ways, strict=True)] + [[]] * int(apart.sum()), pa.list_(pa.int64()))})


def _vectors(df: DataFrame, number: str, embedding: str) -> DataFrame:
    """(node, rep, label, v, size, n, vector): valid vectors, as they came (v) and scaled to length 1 in double precision, equal ones once, under the least number."""
    fine = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size(embedding) > 0) & F.exists(embedding, lambda v: v != 0)
    same = df.where(F.col(number).isNotNull() & F.col("label").isNotNull() & F.col(embedding).isNotNull()).where(fine)
    same = same.groupBy("label", F.transform(embedding, lambda v: v.cast("double")).alias("v")).agg(F.min(number).alias("rep"), F.count("*").alias("n"))

    def scale(batches: Batches) -> Batches:
        for batch in batches:
            raw = []
            for v in batch["v"].to_pylist():
                v = np.array(v) / np.abs(v).max()
                raw.append((v / np.linalg.norm(v)).tobytes())
            yield pa.record_batch([batch["rep"], batch["label"], batch["v"], pa.array([len(v) // 8 for v in raw], pa.int32()), batch["n"], pa.array(raw, pa.binary())], names=["rep", "label", "v", "size", "n", "vector"])

    scaled = same.mapInArrow(scale, f"rep long, label {same.schema['label'].dataType.simpleString()}, v array<double>, size int, n long, vector binary")
    return scaled.withColumn("node", F.monotonically_increasing_id())


def _shards(vectors: DataFrame, rows: int) -> DataFrame:
    """(label, size, shard, node, n, main, vector): every node in one shard or more, of `rows` nodes at most; in one of them as its main shard."""
    ready, open_ = None, vectors.select("label", "size", F.lit(0).cast("long").alias("shard"), "node", "n", F.lit(True).alias("main"), "vector")
    level = 0
    while True:
        open_ = stash(open_)
        sizes = open_.groupBy(*_KEY).agg(F.count("*").alias("rows"))
        large = stash(sizes.where(F.col("rows") > rows))
        small = open_.join(large, _KEY, "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        if large.isEmpty():
            return ready
        crowd = open_.join(large, _KEY).withColumn("salts", F.ceil(F.col("rows") / (4 * rows)).cast("long"))
        draw = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
        wanted = F.least(F.lit(float(MOST_PIVOTS)), F.ceil(4.0 * F.col("rows") / rows))
        pivots = crowd.where(draw < wanted / F.col("rows")).select(*(F.col(c).alias(f"of_{c}") for c in _KEY), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("of_salt"), F.col("node").alias("pivot"), F.col("vector").alias("place"))
        members = crowd.select(*_KEY, F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"), "node", "n", "main", "vector")
        at = [*_KEY, "salt"]
        open_ = members.groupBy(*at).cogroup(pivots.groupBy(*(f"of_{c}" for c in at))).applyInArrow(_assign, open_.schema)
        level += 1


def _assign(left: pa.Table, right: pa.Table) -> pa.Table:
    """Members of a shard to its two nearest pivots, the nearer one first; all stay together where fewer than two were drawn (the next level draws anew)."""
    names = ["label", "size", "shard", "node", "n", "main", "vector"]
    if len(right) < 2 or not len(left):
        return left.select(names)
    right = right.sort_by("pivot").combine_chunks()
    pivot, node = right["pivot"].to_numpy(), left["node"].to_numpy()
    near = _matrix(left["vector"]) @ _matrix(right["place"]).T
    # vectors that rounding can't tell apart are dealt out by hash, so that every shard splits
    near += 1e-9 * (((node[:, None] * 0x9E3779B1 + pivot[None] * 0x85EBCA77) >> 7) % 65536) / 65536
    two = np.argpartition(-near, 1, axis=1)[:, :2]
    two = np.take_along_axis(two, np.argsort(-np.take_along_axis(near, two, 1), axis=1), 1)
    child = (left["shard"].to_numpy()[:, None] * 1_000_003 + pivot[two] * 31 + 17).astype(np.int64)
    at = np.repeat(np.arange(len(left)), 2)
    out = left.select(names).take(pa.array(at))
    main = np.repeat(left["main"].to_numpy(), 2) & (np.arange(len(at)) % 2 == 0)
    return out.set_column(2, "shard", pa.array(child.ravel())).set_column(5, "main", pa.array(main))


def _rounds(ready: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(node, root, links) of all visits, round by round until no query enters another shard."""
    visits = ready.where("main").select(*_KEY, F.col("node").alias("query"), "vector", F.array().cast("array<long>").alias("entries"), F.array("shard").alias("known"))
    found = done = None
    while True:
        size = visits.groupBy(*_KEY).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        left = ready.join(size, _KEY).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        right = visits.join(size, _KEY).withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int"))
        at = [*_KEY, "chunk"]
        right = right.select(*(F.col(c).alias(f"to_{c}") for c in at), "query", F.col("vector").alias("sought"), "entries", "known")
        got = left.select(*at, "node", "n", "main", "vector", "near", "homes").groupBy(*at).cogroup(right.groupBy(*(f"to_{c}" for c in at)))
        got = stash(got.applyInArrow(lambda a, b: visit(a, b, threshold), "node long, root long, links long, exits array<struct<shard:long,entries:array<long>>>, known array<long>"))
        found = got.select("node", "root", "links") if found is None else found.unionAll(got.select("node", "root", "links"))
        ways = got.select(F.col("node").alias("query"), "known", F.explode("exits").alias("x")).groupBy("query", F.col("x.shard").alias("shard"))
        ways = ways.agg(F.first("known").alias("known"), F.slice(F.array_distinct(F.flatten(F.collect_list("x.entries"))), 1, 4 * ENTRIES).alias("entries"))
        # a query meets a shard once, so all its shards fit a row
        ways = ways.groupBy("query").agg(F.first("known").alias("known"), F.collect_list(F.struct("shard", "entries")).alias("to"))
        ways = ways.select("query", F.array_union("known", "to.shard").alias("known"), F.explode("to").alias("x"))
        next_ = stash(ways.join(vectors.select(F.col("node").alias("query"), "label", "size", "vector"), "query").select("label", "size", "x.shard", "query", "vector", "x.entries", "known"))
        if next_.isEmpty():
            return found
        if done is not None:
            discard(done)
        visits = done = next_


def embedding_links(rows: DataFrame, threshold: float = 0.98, number: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each row of `rows`: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine is at least
    `threshold`; null, empty, zero and non-finite vectors link with nothing, nor do vectors of
    different lengths. n_links counts the other vectors linked directly, equal ones included;
    component_id is the smallest vec_id reachable by links. A null vec_id keeps its row with no
    links, a null component and kept false. Rows that repeat a vec_id count as vectors of their
    own, with the same or with another vector. Other columns are ignored, an empty table gives an empty result.
    """
    rows = rows.select(F.col(number).cast("long").alias("vec_id"), "label", F.col(embedding).alias("embedding"))
    vectors = stash(_vectors(rows, "vec_id", "embedding"))
    placed = stash(_shards(vectors, shard_rows))
    graph = placed.groupBy(*_KEY).applyInArrow(shard_graph, "node long, shard long, near array<long>")
    flat = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.collect_list("shard").alias("homes"))
    found = _rounds(stash(placed.join(flat, "node")), vectors, threshold)
    label = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = vectors.select("node", "rep", "n").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = nodes.groupBy("component").agg(F.min("rep").alias("component_id"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = nodes.join(links, "node").join(least, "component").select("node", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    # equal vectors share a row of `keyed`: scaled vectors may round alike, so the key is the vector as it came
    vector = rows.withColumn("v", F.transform("embedding", lambda v: v.cast("double")))
    keyed = vectors.join(linked, "node").select("label", "v", "n_links", "component_id")
    out = vector.join(keyed, ["label", "v"], "left")
    mine = F.col("n_links").isNotNull() & F.col("vec_id").isNotNull()
    out = out.select("vec_id", F.when(mine, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.when(mine, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def audit(rows: DataFrame, found: DataFrame, threshold: float = 0.98, number: str = "vec_id", embedding: str = "embedding", every: int = 20, blocks: int = 16) -> DataFrame:
    """One row: links of every `every`-th vector by brute force against all rows, those that `found` has, and their ratio.

    The queries meet every row of their label in blocks; one task holds a block of queries and
    a part of the rows.
    """
    vectors = stash(_vectors(rows.select(F.col(number).cast("long").alias(number), "label", embedding), number, embedding))
    queries = vectors.where(F.col("rep") % every == 0).select("label", "size", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "node", "n", "vector")
    against = vectors.select("label", "size", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"), "node", "n", "vector")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        near = _matrix(left["vector"]) @ _matrix(right["vector"]).T >= threshold
        near &= left["node"].to_numpy()[:, None] != right["node"].to_numpy()[None, :]
        return pa.table({"node": left["node"], "links": pa.array(near @ right["n"].to_numpy())})

    true = queries.groupBy("label", "size", "block").cogroup(against.groupBy("label", "size", "block")).applyInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    both = true.join(vectors.select("node", "rep", (F.col("n") - 1).alias("copies")), "node").select(F.col("rep").alias("vec_id"), (F.col("links") + F.col("copies")).alias("true_links")).join(found.groupBy("vec_id").agg(F.max("n_links").alias("n_links")), "vec_id")
    return both.agg(F.sum("true_links").alias("links"), F.sum(F.least("true_links", "n_links")).alias("found"), (F.sum(F.least("true_links", "n_links")) / F.greatest(F.sum("true_links"), F.lit(1))).alias("recall"))
