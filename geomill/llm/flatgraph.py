"""Near-duplicate vectors by range search over a flat, robust-pruned graph.

Distinct vectors are dealt to the shards of their ``overlap`` nearest centres,
so shards overlap.  Each shard builds a pruned neighbour graph of its own; the
graph of the whole is the union of a vector's adjacency lists over its shards.
Every vector then searches it: greedily from the medoids of its own shards, and
on from every vector found within range over that vector's neighbours.  Where
a vector found lies in another shard too, its list there belongs to the union
as well, so the search goes on in that shard, in the next round.  A pair is
counted in one shard only, the first that both have in common, so cells return
one row a query (hits, smallest linked vector) and never pairs.  Every hit is
verified in double precision.

A bounded sample of queries is compared with all vectors by brute force; while
recall is below ``recall``, the graph is rebuilt with more overlap and a wider
beam.  Where the last graph misses it too, cells of the nearest centre are
compared in full: a vector meets every cell whose members' angles to their
centre leave room for a link, so no link is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.llm import vectors
from geomill.operators.graph import connected_components
from geomill.session import cut

#: Distinct vectors that the centres are fitted on, and centres at most.
FIT_ROWS, MAX_CENTRES = 16_384, 2048
#: Rows of a shard aimed at, and of the blocks that larger shards are split into.
SHARD_ROWS, BLOCK_ROWS = 2048, 8192
#: Neighbours of a vector, and how much nearer a kept neighbour must be to rule another out (of squared distances).
DEGREE, ALPHA = 16, 1.44
#: Nearest rows that a row's neighbours are chosen from, and its random links of either kind.
POOL, LOOSE = 40, 3
#: Unexpanded vectors that a search expands in one step, and queries searched side by side.
WIDTH, QUERIES = 4, 256
#: Queries of the audit.
AUDIT_ROWS = 512


def fit_centres(x: np.ndarray, many: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of spherical k-means; starts from evenly spread rows."""
    centres = x[np.linspace(0, len(x) - 1, many).astype(np.int64)]
    for _ in range(rounds):
        own = np.concatenate([(x[at : at + 2048] @ centres.T).argmax(1) for at in range(0, len(x), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


def robust_prune(x: np.ndarray, own: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours (-1: none) of each row of ``own`` out of its row of ``pool`` (-1: none).

    The nearest candidate is kept and rules out those that it is ``alpha``
    times nearer to than ``own`` is, again and again.
    """
    pool = np.where(pool == own[:, None], -1, pool)
    order = np.sort(pool, axis=1)
    repeat = np.zeros(pool.shape, bool)
    repeat[:, 1:] = order[:, 1:] == order[:, :-1]
    pool = np.where(repeat, -1, order)
    v = x[pool]
    far = np.where(pool >= 0, 1 - np.einsum("bpd,bd->bp", v, x[own]), np.inf)
    among = 1 - v @ v.transpose(0, 2, 1)
    out = np.full((len(own), degree), -1)
    rows = np.arange(len(own))
    for r in range(degree):
        best = far.argmin(1)
        has = np.isfinite(far[rows, best])
        if not has.any():
            break
        out[has, r] = pool[rows[has], best[has]]
        kills = alpha * among[rows, best] <= far
        far[kills & has[:, None]] = np.inf
        far[rows, best] = np.inf
    return out


def greedy(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, own: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row) of all rows in range that a greedy search with a bounded beam meets from ``starts`` and the rows ``own`` (-1: none), and what each query has visited."""
    n, q = len(x), len(queries)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    rows = np.arange(q)[:, None]
    ids = np.column_stack([np.tile(starts, (q, 1)), np.maximum(own, 0)])
    near = np.column_stack([queries @ x[starts].T, np.where((own >= 0) & ~np.isin(own, starts), vectors.cosines(queries, x[np.maximum(own, 0)]), -np.inf)])
    seen[rows, ids] = True
    done = ~np.isfinite(near)
    a, b = np.nonzero(near >= threshold)
    met = [(a, ids[a, b])]
    while True:
        open_ = np.where(done, -np.inf, near)
        pick = np.argsort(-open_, axis=1, kind="stable")[:, :WIDTH]
        live = np.isfinite(np.take_along_axis(open_, pick, 1))
        if not live.any():
            return np.concatenate([m[0] for m in met]), np.concatenate([m[1] for m in met]), seen
        np.put_along_axis(done, pick, True, 1)
        ahead = np.where(live[:, :, None], graph[np.take_along_axis(ids, pick, 1)], -1).reshape(q, -1)
        ahead = np.where(ahead < 0, n, ahead)
        ahead = np.where(seen[rows, ahead], n, ahead)
        ahead = np.sort(ahead, axis=1)
        ahead[:, 1:][ahead[:, 1:] == ahead[:, :-1]] = n
        seen[rows, ahead] = True
        a, b = np.nonzero(ahead < n)
        close = np.full(ahead.shape, -np.inf)
        close[a, b] = np.einsum("kd,kd->k", queries[a], x[ahead[a, b]])
        hit = close[a, b] >= threshold
        met.append((a[hit], ahead[a, b][hit]))
        ids = np.concatenate([ids, np.where(ahead < n, ahead, 0)], 1)
        near = np.concatenate([near, close], 1)
        done = np.concatenate([done, ~np.isfinite(close)], 1)
        keep = np.argsort(-near, axis=1, kind="stable")[:, :beam]
        ids, near, done = (np.take_along_axis(t, keep, 1) for t in (ids, near, done))


def medoids(x: np.ndarray, rows_each: int = 64) -> np.ndarray:
    """The row nearest to the mean of each of about len(x) / ``rows_each`` clusters."""
    centres = fit_centres(x, max(1, len(x) // rows_each), 2)
    near = np.concatenate([x[at : at + QUERIES] @ centres.T for at in range(0, len(x), QUERIES)])
    return np.unique(near.argmax(0))


def build_graph(x: np.ndarray, threshold: float, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours of each row, -1: none; rows to start from).

    A row keeps the robust-pruned of its ``POOL`` nearest rows and of those
    that keep it, ``LOOSE`` random rows, and as many random rows in range, so
    that rows in range of each other hang together however dense they lie.
    """
    n, draw = len(x), np.random.default_rng(seed)
    forward = np.full((n, DEGREE + 2 * LOOSE), -1)
    for lo in range(0, n if n > 1 else 0, QUERIES):
        own = np.arange(lo, min(lo + QUERIES, n))
        near = x[own] @ x.T
        near[np.arange(len(own)), own] = -np.inf
        pool = np.argpartition(-near, min(POOL, n - 1) - 1, axis=1)[:, :POOL]
        forward[own, :DEGREE] = robust_prune(x, own, pool)
        forward[own, DEGREE : DEGREE + LOOSE] = draw.integers(0, n, (len(own), LOOSE))
        i, j = np.nonzero(near >= threshold)
        first, many = np.searchsorted(i, np.arange(len(own))), np.bincount(i, minlength=len(own))
        some = np.flatnonzero(many)
        at = first[some, None] + (draw.random((len(some), LOOSE)) * many[some, None]).astype(np.int64)
        forward[own[some], DEGREE + LOOSE :] = j[at]
    source, target = np.repeat(np.arange(n), forward.shape[1]), forward.ravel()
    source, target = source[target >= 0], target[target >= 0]
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    inside = place < POOL
    incoming = np.full((n, POOL), -1)
    incoming[target[inside], place[inside]] = source[inside]
    back = [robust_prune(x, np.arange(lo, min(lo + QUERIES, n)), incoming[lo : lo + QUERIES]) for lo in range(0, n, QUERIES)]
    return np.concatenate([forward, np.concatenate(back)], 1), medoids(x)


def in_range(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, own: np.ndarray, threshold: float, beam: int):
    """(query, row) pairs of cosine ``threshold`` or more that a range-expanding search finds."""
    q, row, seen = greedy(x, graph, starts, queries, own, threshold, beam)
    found = [(q, row)]
    n = len(x)
    while len(found[-1][0]):
        q = np.repeat(found[-1][0], graph.shape[1])
        row = graph[found[-1][1]].ravel()
        q, row = q[row >= 0], row[row >= 0]
        new = ~seen[q, row]
        flat = np.unique(q[new] * (n + 1) + row[new])
        q, row = flat // (n + 1), flat % (n + 1)
        seen[q, row] = True
        close = np.concatenate([vectors.cosines(queries[q[k : k + 65536]], x[row[k : k + 65536]]) for k in range(0, len(q), 65536)]) if len(q) else np.empty(0)
        hit = close >= threshold
        found.append((q[hit], row[hit]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _lists(column) -> np.ndarray:
    """Lists of shards as rows filled up with -1."""
    rows = column.to_pylist()
    out = np.full((len(rows), max([1, *map(len, rows)])), -1)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _join_up(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the trees of linked rows; every row then points to its tree's smallest."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


_GRAPH = "shard int, block int, at int, node long, many long, shards array<int>, vec array<double>, next array<int>, start boolean"
_ROUTES = pa.list_(pa.struct({"shard": pa.int32(), "entry": pa.int64()}))
_FOUND = "node long, hits long, link long, onward array<struct<shard:int,entry:long>>"
_NOTHING = pa.table({"node": pa.array([], pa.int64()), "hits": pa.array([], pa.int64()), "link": pa.array([], pa.int64())})


def _search(cell_rows: pa.Table, guests: pa.Table, shard: int, threshold: float, beam: int) -> pa.Table:
    """Hits of ``guests`` among the rows of a cell, counted where this shard is the first new one that the two have in common."""
    t = cell_rows.sort_by("at")
    x = vectors.matrix(t.column("vec"))
    graph = np.array(t.column("next").to_pylist(), np.int64).reshape(len(x), -1)
    starts = np.flatnonzero(t.column("start").to_numpy(zero_copy_only=False))
    node, many, shards = t.column("node").to_numpy(), t.column("many").to_numpy(), _lists(t.column("shards"))
    by_node = np.argsort(node)
    entry = guests.column("entry").to_numpy()
    at = by_node[np.minimum(np.searchsorted(node, entry, sorter=by_node), len(node) - 1)]
    own = np.where(node[at] == entry, at, -1)
    g_node, new, past = guests.column("node").to_numpy(), _lists(guests.column("new")), _lists(guests.column("past"))
    y = vectors.matrix(guests.column("vec"))
    hits = np.zeros(len(y), np.int64)
    rank = np.concatenate([node, g_node])
    order = np.argsort(rank, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    root = np.arange(len(order))
    onward: list[dict] = [{} for _ in range(len(y))]
    for lo in range(0, len(y), QUERIES):
        q, row = in_range(x, graph, starts, y[lo : lo + QUERIES], own[lo : lo + QUERIES], threshold, beam)
        q = q + lo
        other = node[row] != g_node[q]
        q, row = q[other], row[other]
        for k in range(0, len(q), 1 << 18):
            a, b = q[k : k + (1 << 18)], row[k : k + (1 << 18)]
            theirs = shards[b]
            valid = theirs >= 0
            is_new = (theirs[:, :, None] == new[a][:, None, :]).any(2) & valid
            is_past = (theirs[:, :, None] == past[a][:, None, :]).any(2) & valid
            first = np.where(is_new, theirs, np.iinfo(np.int64).max).min(1)
            counted = ~is_past.any(1) & (first == shard)
            np.add.at(hits, a[counted], many[b[counted]])
            _join_up(root, place[len(x) + a], place[b])
            i, j = np.nonzero(valid & ~is_new & ~is_past)
            if len(i):
                pairs, one = np.unique(a[i] * (1 << 32) + theirs[i, j], return_index=True)
                for p, e in zip(pairs.tolist(), node[b[i[one]]].tolist()):
                    onward[p >> 32].setdefault(p & 0xFFFFFFFF, e)
    ids = rank[order]
    link = ids[root[place[len(x) :]]]
    return pa.table({"node": g_node, "hits": hits, "link": link, "onward": pa.array([[{"shard": s, "entry": e} for s, e in o.items()] for o in onward], _ROUTES)})


def fit_sample(nodes: DataFrame) -> np.ndarray:
    """Vectors of a hashed sample of at most ``FIT_ROWS`` nodes."""
    return vectors.matrix(nodes.orderBy(F.xxhash64("node", F.lit(3)), "node").limit(FIT_ROWS).select("vec").toArrow().column("vec"))


def _all_links(nodes: DataFrame, total: int, overlap: int, beam: int, threshold: float, rounds: int) -> DataFrame:
    """(node, hits, link) rows of every round's searches over ``nodes`` (node, many, vec)."""
    sample = fit_sample(nodes)
    many = max(1, min(MAX_CENTRES, len(sample) // 8, math.ceil(total * overlap / SHARD_ROWS)))
    centres = fit_centres(sample, many)
    take = min(overlap, many)

    def assign(batches):
        for batch in batches:
            x = vectors.matrix(batch.column("vec"))
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :take].astype(np.int32)
            shards = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, take, dtype=np.int32)), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "many", "vec")), shards], ["node", "many", "vec", "shards"])

    dealt = cut(nodes.select("node", "many", "vec").mapInArrow(assign, "node long, many long, vec array<double>, shards array<int>"))
    blocks = _blocks(dealt.select(F.explode("shards").alias("shard")), many)
    placed = dealt.withColumn("shard", F.explode("shards")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), blocks.cast("long")).cast("int"))

    def build(key, t):
        x = vectors.matrix(t.column("vec"))
        graph, starts = build_graph(x, threshold)
        begins = np.zeros(len(x), bool)
        begins[starts] = True
        fixed = {"shard": pa.array(np.full(len(x), key[0].as_py(), np.int32)), "block": pa.array(np.full(len(x), key[1].as_py(), np.int32)), "at": pa.array(np.arange(len(x), dtype=np.int32))}
        return pa.table({**fixed, **{c: t.column(c) for c in ("node", "many", "shards", "vec")}, "next": pa.array(graph.astype(np.int32).tolist(), pa.list_(pa.int32())), "start": begins})

    graph = cut(placed.groupBy("shard", "block").applyInArrow(build, _GRAPH))

    def search(key, rows, guests):
        if not rows.num_rows or not guests.num_rows:
            return _NOTHING.append_column("onward", pa.array([], _ROUTES))
        return _search(rows, guests, key[0].as_py(), threshold, beam)

    past = F.array().cast("array<int>")
    guests = dealt.select("node", "vec", F.col("shards").alias("new"), past.alias("past"), F.explode("shards").alias("shard"), F.col("node").alias("entry"))
    out = []
    for _ in range(rounds):
        asks = guests.withColumn("block", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
        found = cut(graph.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInArrow(search, _FOUND))
        out.append(found.select("node", "hits", "link"))
        routes = found.select("node", F.explode("onward").alias("o")).groupBy("node", "o.shard").agg(F.min("o.entry").alias("entry"))
        known = guests.select("node", "vec", F.array_union("past", "new").alias("past")).dropDuplicates(["node"])
        ahead = routes.groupBy("node").agg(F.collect_list("shard").alias("new"))
        guests = cut(known.join(ahead, "node").join(routes, "node").select("node", "vec", "new", "past", "shard", "entry"))
        if guests.isEmpty():
            break
    links = out[0]
    for more in out[1:]:
        links = links.unionByName(more)
    return links


def _blocks(shards: DataFrame, many: int):
    """Column: blocks of ``BLOCK_ROWS`` that ``shard``, one of ``many``, is split into."""
    sizes = {r[0]: r[1] for r in shards.groupBy("shard").count().collect()}  # MAX_CENTRES rows at most
    return F.element_at(F.array(*[F.lit(max(1, math.ceil(sizes.get(s, 0) / BLOCK_ROWS))) for s in range(many)]), F.col("shard") + 1)


def exact_links(nodes: DataFrame, total: int, threshold: float) -> DataFrame:
    """(node, hits, link) rows that hold every link of ``nodes`` (node, many, vec).

    A vector lies in the cell of its nearest centre.  The angle of two linked
    vectors is at most that of the threshold, so a vector asks just the cells
    whose range of angles to the centre comes that near to its own angle.
    """
    sample = fit_sample(nodes)
    many = max(1, min(MAX_CENTRES, len(sample) // 8, math.ceil(total / SHARD_ROWS)))
    centres = fit_centres(sample, many)

    def angles(x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ centres.T, -1, 1))

    def assign(batches):
        for batch in batches:
            far = angles(vectors.matrix(batch.column("vec")))
            own = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "many", "vec")), pa.array(own.astype(np.int32)), pa.array(far[np.arange(len(own)), own])], ["node", "many", "vec", "shard", "angle"])

    dealt = cut(nodes.select("node", "many", "vec").mapInArrow(assign, "node long, many long, vec array<double>, shard int, angle double"))
    ranges = {r[0]: (r[1], r[2]) for r in dealt.groupBy("shard").agg(F.min("angle"), F.max("angle")).collect()}  # MAX_CENTRES rows at most
    low, high = (np.array([ranges.get(s, (9.0, -9.0))[i] for s in range(many)]) for i in (0, 1))
    reach = math.acos(min(1.0, max(-1.0, threshold))) + 1e-6
    blocks = _blocks(dealt, many)

    def ask(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                far = angles(vectors.matrix(some.column("vec")))
                i, shard = np.nonzero((far - reach <= high) & (far + reach >= low))
                yield pa.RecordBatch.from_arrays([some.column("node").take(pa.array(i)), some.column("vec").take(pa.array(i)), pa.array(shard.astype(np.int32))], ["node", "vec", "shard"])

    placed = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), blocks.cast("long")).cast("int"))
    asks = nodes.select("node", "vec").mapInArrow(ask, "node long, vec array<double>, shard int").withColumn("block", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))

    def compare(key, rows, guests):
        if not rows.num_rows or not guests.num_rows:
            return _NOTHING
        x, node, times = vectors.matrix(rows.column("vec")), rows.column("node").to_numpy(), rows.column("many").to_numpy()
        y, asking = vectors.matrix(guests.column("vec")), guests.column("node").to_numpy()
        order = np.argsort(np.concatenate([node, asking]), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        root, hits = np.arange(len(order)), np.zeros(len(y), np.int64)
        for lo in range(0, len(y), QUERIES):
            q, row = np.nonzero(y[lo : lo + QUERIES] @ x.T >= threshold - 1e-9)
            q = q + lo
            near = (node[row] != asking[q]) & (vectors.cosines(y[q], x[row]) >= threshold)
            np.add.at(hits, q[near], times[row[near]])
            _join_up(root, place[len(x) + q[near]], place[row[near]])
        return pa.table({"node": asking, "hits": hits, "link": np.concatenate([node, asking])[order][root[place[len(x) :]]]})

    return cut(placed.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInArrow(compare, "node long, hits long, link long"))


def audit(nodes: DataFrame, links: DataFrame, threshold: float, rows: int = AUDIT_ROWS) -> float:
    """The share of the links of ``rows`` hashed sample nodes that ``links`` has, against brute force over all nodes."""
    some = nodes.orderBy(F.xxhash64("node", F.lit(11)), "node").limit(rows).select("node", "vec").toArrow()
    if not some.num_rows:
        return 1.0
    names, y = some.column("node").to_numpy(), vectors.matrix(some.column("vec"))

    def count(batches):
        total = np.zeros(len(y), np.int64)
        for batch in batches:
            near = vectors.matrix(batch.column("vec")) @ y.T >= threshold
            near &= batch.column("node").to_numpy()[:, None] != names
            total += (near * batch.column("many").to_numpy()[:, None]).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], ["node", "true"])

    true = nodes.select("node", "many", "vec").mapInArrow(count, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    got = links.groupBy("node").agg(F.sum("hits").alias("hits"))
    sums = true.join(got, "node", "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("hits", F.lit(0))))).first()
    return sums[1] / sums[0] if sums[0] else 1.0


def near_duplicates(rows: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", overlap: int = 2, beam: int = 32, recall: float = 0.999, attempts: int = 3, rounds: int = 6) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept.

    Rows link where the cosine of their vectors is ``threshold`` or more.
    Vectors equal in every component are one node of the graph, counted as
    often as they occur; a repeated row counts as another vector.  Vectors that
    ``usable`` leaves out have no link.  Rows of a null id keep a row each, are
    counted as partners and join the vectors that they link, but name no
    component: a component without any id has none.  An empty table gives no
    rows; other columns are ignored.  The graph's links are audited in every
    attempt; below ``recall`` in the last one ``exact_links`` replaces them.
    """
    own = vectors.usable(rows, vec_id, embedding)
    kind = rows.schema[embedding].dataType.simpleString()
    node = F.xxhash64("vec")
    groups = own.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("many")).withColumn("node", node)

    def scale(batches):
        for batch in batches:
            x = vectors.units(vectors.matrix(batch.column("vec")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("id"), batch.column("many"), lists], ["node", "id", "many", "vec"])

    nodes = cut(groups.select("node", "id", "many", "vec").mapInArrow(scale, "node long, id long, many long, vec array<double>"))
    total = nodes.count()
    everyone = rows.select(F.col(vec_id).alias("vec_id"), F.when(F.size(embedding) > 0, F.col(embedding)).cast(kind).alias("vec")).withColumn("node", node)
    if not total:
        return everyone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    for attempt in range(attempts):
        links = _all_links(nodes, total, overlap + attempt, beam << attempt, threshold, rounds)
        if audit(nodes, links, threshold) >= recall:
            break
    else:
        links = exact_links(nodes, total, threshold)
    parts = connected_components(links.filter("node <> link").select(F.col("node").alias("x"), F.col("link").alias("y")), "x", "y").withColumnRenamed("node", "_node")
    counts = links.groupBy("node").agg(F.sum("hits").alias("hits"))
    known = nodes.select("node", "id", "many").join(counts, "node", "left").join(parts, F.col("node") == F.col("_node"), "left").withColumn("part", F.coalesce("component", "node"))
    names = known.groupBy("part").agg(F.min("id").alias("c"))
    known = known.join(names, "part").select("node", (F.coalesce("hits", F.lit(0)) + F.col("many") - 1).alias("n"), "c", F.lit(True).alias("linked"))
    there = everyone.join(own.select("vec").distinct().select(node.alias("node")).join(known, "node"), "node", "left")
    component = F.when(F.col("linked"), F.col("c")).otherwise(F.col("vec_id").cast("long"))
    return there.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
