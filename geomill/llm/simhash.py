"""SimHash near-duplicates by a generalised pigeonhole over groups of correlated bits."""

from __future__ import annotations

import math
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.operators.graph import connected_components
from geomill.session import bound_batches, cut

BITS = 64
#: Runs of at most this many fingerprints are compared by offset, longer ones by a search that emits a tree.
SHORT_RUN = 16


def fingerprint(text: str | None, words: int = 3, seed: int = 42, many: int = 1) -> tuple[int, ...]:
    """``many`` unsigned 64-bit SimHashes of the word shingles of ``text``; 0 where it has no word.

    The first is of the shingles' XXH64, each other one of a mix of those.
    """
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return (0,) * many
    flat = b" ".join(parts)
    words = min(words, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(parts) - words + 1].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(flat[i:j], seed) for i, j in zip(starts, stops)], np.uint64)
    out = []
    for k in range(many):
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(h), 8192):
            some = h[at : at + 8192]
            if k:
                some = (some ^ (some >> np.uint64(29))) * np.uint64((0xBF58476D1CE4E5B9 * (2 * k + 1)) % 2**64)
                some ^= some >> np.uint64(32)
            ones += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]))
    return tuple(out)


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint's bits as a signed long."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, words, seed)[0] for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bit_statistics(fps: DataFrame) -> np.ndarray:
    """64 x 65 counts over all fingerprints: pairs of set bits, and rows in the last column."""

    def run(batches):
        total = np.zeros((BITS, BITS), np.int64)
        rows = 0
        for batch in batches:
            x = batch.column("fp").to_numpy(zero_copy_only=False)
            bits = np.unpackbits(x.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
            rows += len(x)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([total.ravel().tolist()])], ["n", "m"])

    parts = fps.select("fp").mapInArrow(run, "n long, m array<long>")
    summed = parts.select("n", F.posexplode("m")).groupBy("pos").agg(F.sum("col").alias("v"), F.sum("n").alias("n")).orderBy("pos").collect()  # 4096 rows, whatever the input
    if not summed:
        return np.zeros((BITS, BITS + 1))
    m = np.array([r.v for r in summed], float).reshape(BITS, BITS)
    return np.column_stack([m, np.full(BITS, float(summed[0].n))])


def group_bits(stats: np.ndarray, parts: int) -> list[list[int]]:
    """``parts`` groups of near equal width; each grows by the bit most correlated with those it holds."""
    n = max(1.0, stats[0, -1])
    p = np.diag(stats[:, :BITS]) / n
    var = np.maximum(p * (1 - p), 1e-9)
    corr = np.abs(stats[:, :BITS] / n - np.outer(p, p)) / np.sqrt(np.outer(var, var))
    free, groups = set(range(BITS)), []
    for g in range(parts):
        width = BITS // parts + (g < BITS % parts)
        own = [min(free)]
        free.discard(own[0])
        while len(own) < width:
            best = max(sorted(free), key=lambda b: corr[b, own].mean())
            own.append(best)
            free.discard(best)
        groups.append(sorted(own))
    return groups


def _radius(threshold: int) -> int:
    """Bits that each of two rows may flip so that rows within ``threshold`` have a value in common."""
    return (threshold + 1) // 2


def _ball(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(radius + 1)) if radius >= 0 else 0


def _masks(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def allocate(sample: np.ndarray, rows: int, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """Thresholds per group by dynamic programming on estimated candidates and cells, both counted in pairs compared.

    A pair within ``distance`` differs in at most t_i bits of some group i
    whenever the thresholds t_i sum to ``distance`` - groups + 1; -1 leaves a
    group out.  Rows travel t_i + 1 times for a group, so distance + 1 times
    under any such thresholds.  The share of pairs that meet, within t_i of each
    other on a group's bits or one more if t_i is odd, is measured on
    ``sample``, and never taken below that of uniform bits.
    """
    budget = distance - len(groups) + 1
    half = sample[: len(sample) // 2][:1024], sample[len(sample) // 2 :][:1024]
    best = {0: (0.0, [])}
    for bits in groups:
        mask = _masks(bits)
        d = np.bitwise_count((half[0][:, None] ^ half[1][None, :]) & mask) if len(sample) > 1 else np.zeros((0, 0), np.uint8)
        within = np.cumsum(np.bincount(d.ravel(), minlength=BITS + 1)) / max(1, d.size)
        met = [min(len(bits), 2 * _radius(t)) for t in range(distance + 1)]
        shares = [max(float(within[t]), _ball(len(bits), t) / 2.0 ** len(bits)) for t in met]
        cells = [(t + 1) * _ball(len(bits) - len(bits) // (t + 1), _radius(t)) for t in range(distance + 1)]
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, min(distance + 1, len(bits))):
                now = cost + (shares[t] * rows * rows / 2 + CELL_PAIRS * rows * cells[t] if t >= 0 else 0.0)
                if used + t not in step or now < step[used + t][0]:
                    step[used + t] = (now, [*chosen, t])
        best = step
    return best.get(budget, (math.inf, []))


def plan_probes(fps: DataFrame, distance: int = 3, sample_rows: int = 2048) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the cheapest partition found for ``fps``, from 2 to distance + 1 groups."""
    stats = _bit_statistics(fps)
    rows = int(stats[0, -1])
    sample = np.array([r.fp for r in fps.orderBy(F.xxhash64(F.col("fp"), F.lit(7)), "fp").limit(sample_rows).collect()], np.int64).view(np.uint64)
    plans = []
    for parts in range(2, distance + 2):
        groups = group_bits(stats, parts)
        cost, chosen = allocate(sample, rows, groups, distance)
        if chosen:
            plans.append((cost, [(b, t) for b, t in zip(groups, chosen) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


def _flips(bits: list[int], radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(bits, r)], np.uint64)


def _tree(x: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of ``x`` under the distance; every member is compared with all not yet reached."""
    left, out = x.copy(), []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = np.full(len(left), -1, np.int64)
            for at in range(0, len(front), 64):
                near = np.bitwise_count(front[at : at + 64, None] ^ left[None, :]) <= distance
                hit = near.any(0) & (reached < 0)
                reached[hit] = at + near[:, hit].argmax(0)
            got = reached >= 0
            out.append((front[reached[got]], left[got]))
            front, left = left[got], left[~got]
    return out


def _dense_links(x: np.ndarray, distance: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a long run: all of a member that has at most ``most``, else one to itself."""
    out, many = [], max(1, (1 << 20) // len(x))
    for lo in range(0, len(x), many):
        near = np.bitwise_count(x[lo : lo + many, None] ^ x[None, :]) <= distance
        count = near.sum(1) - 1
        few, dense = np.flatnonzero((count > 0) & (count <= most)), np.flatnonzero(count > most)
        i, j = np.nonzero(near[few])
        other = lo + few[i] != j
        out += [(x[lo + few[i[other]]], x[j[other]]), (x[lo + dense], x[lo + dense])]
    return out


def _run_edges(keys: np.ndarray, fps: np.ndarray, distance: int, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links among equal keys of arrays sorted by key: all of short runs, of long ones a spanning forest or, with ``most``, ``_dense_links``."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    long_run = np.repeat(sizes > SHORT_RUN, sizes)
    out = []
    for d in range(1, min(SHORT_RUN, int(sizes.max(initial=1)))):
        near = (keys[d:] == keys[:-d]) & ~long_run[d:] & (np.bitwise_count(fps[d:] ^ fps[:-d]) <= distance)
        out.append((fps[d:][near], fps[:-d][near]))
    for at, size in zip(starts[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN]):
        run = np.unique(fps[at : at + size])
        out += _dense_links(run, distance, most) if most and len(run) > 1 else _tree(run, distance)
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


#: Rows of one key that are compared in one task, and texts of a block of a region.
CELL_ROWS, BLOCK_TEXTS = 4096, 256
#: Rows that a key should have on average; with more of them keys are made of more bits.
KEY_ROWS = 1 << 16
#: Pairs that are compared in the time that a row takes to be put in a cell; at 235,850 fingerprints of check_l that made the cheapest plan of those measured.
CELL_PAIRS = 8.0
#: Cells' rows that a task holds at once, and rows that it gathers before it makes them.
HELD_ROWS, GATHERED_ROWS = 1 << 20, 1 << 14
#: Texts up to which their names are broadcast to the scan that reads them, and bits of the largest filter that stands for more.
BROADCAST_TEXTS, FILTER_BITS = 100_000, 1 << 25
#: Candidates in a cell up to which a text is verified against each; one with more is compared with its whole region in blocks.
MOST_CANDIDATES = 8


def _keys(bits: list[int], threshold: int, rows: int) -> list[tuple[np.uint64, np.ndarray]]:
    """(mask, flips) of the keys of a group: two rows within ``threshold`` on ``bits`` have all bits of some mask in common.

    The bits are dealt into parts, of which ``threshold`` may differ; a mask has
    the others.  The flips are of the bits beside the mask, up to the radius at
    which two such rows share a cell.
    """
    for parts in range(threshold + 1, len(bits) + 1):
        if rows >> (len(bits) * (parts - threshold) // parts) <= KEY_ROWS:
            break
    out = []
    for same in combinations(range(parts), parts - threshold):
        own = [b for i, b in enumerate(bits) if i % parts in same]
        out.append((_masks(own), _flips([b for b in bits if b not in own], _radius(threshold))))
    return out


def _keyed(rows: DataFrame, keys: list[np.uint64], most: int) -> DataFrame:
    """(part, key, block, fp): each row of ``rows`` (kind, fp) under each of its keys.

    A kind of fingerprint has keys of its own: part is kind times the number of
    masks, plus the mask.  The rows of a key of more than ``most`` are dealt
    into blocks by a hash, and ``block`` is a pair of them, so that every two
    rows meet in one block and no task holds all rows of a large key.
    """

    def under(batches):
        for batch in batches:
            x, kind = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), batch.column("kind").to_numpy(zero_copy_only=False)
            for i, mask in enumerate(keys):
                yield kind * len(keys) + i, (x & mask).view(np.int64), x

    def count(batches):
        for part, key, _ in under(batches):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(key)], ["part", "key"])

    large = rows.mapInArrow(count, "part int, key long").groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > most).collect()  # at most a row for so many
    by_part: dict[int, list] = {}
    for r in large:
        by_part.setdefault(r.part, []).append((r.key, -(-r.n // (most // 2))))
    found = [(i, *(np.array(c, np.int64) for c in zip(*sorted(cells)))) for i, cells in sorted(by_part.items())]

    def deal(batches):
        for part, key, x in under(batches):
            blocks = np.ones(len(part), np.int64)
            for i, known, n in found:
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = (part == i) & (known[at] == key)
                blocks[hit] = n[at[hit]]
            with np.errstate(over="ignore"):
                own = ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks
            for other in range(int(blocks.max(initial=0))):
                row = np.flatnonzero(other < blocks)
                block = np.minimum(own[row], other) * (1 << 32) + np.maximum(own[row], other)
                yield pa.RecordBatch.from_arrays([pa.array(part[row].astype(np.int32)), pa.array(key[row]), pa.array(block), pa.array(x[row].view(np.int64))], ["part", "key", "block", "fp"])

    return rows.mapInArrow(deal, "part int, key long, block long, fp long")


def _in_cells(x: np.ndarray, run: np.ndarray, mask: np.uint64, flips: np.ndarray):
    """(cell, fp) arrays sorted by cell, together all cells that the rows ``x`` of each ``run`` reach by ``flips`` under ``mask``.

    Cells are named by a hash; two of one name only cost comparisons.
    """
    with np.errstate(over="ignore"):
        salt = run.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        slices = np.uint64(-(-len(x) * len(flips) // HELD_ROWS) or 1)
        for part in range(int(slices)):
            cells, at = [], []
            for flip in flips:
                cell = (((x & mask) ^ flip) ^ salt) * np.uint64(0xD6E8FEB86659FD93)
                cell ^= cell >> np.uint64(32)
                own = np.flatnonzero(cell % slices == part)
                cells.append(cell[own])
                at.append(own.astype(np.int32))
            cell, row = np.concatenate(cells), np.concatenate(at)
            by = np.argsort(cell)
            yield cell[by], x[row[by]]


def fingerprint_links(fps: DataFrame, distance: int = 3, probes: list[tuple[list[int], int]] | None = None, most: int = 0) -> DataFrame:
    """(kind, a, b) links among the distinct (kind, fp) of ``fps``: enough to connect all of one kind within ``distance``.

    Without a column of that name all are of kind 0.
    A fingerprint travels under the keys of every group's threshold, of bits in
    which near ones agree; the task of a key puts it in the cells that it reaches
    by flips of the group's other bits, so those are never written, and a cell's
    members are verified on all 64 bits.  Cells with many members return a
    spanning forest instead of all pairs or, with ``most``, all links of members
    that have no more than that; a member that has more gets a link (a, a), and
    ``region_links`` finds what links it.
    """
    probes = probes or plan_probes(fps, distance)
    kind = F.col("kind").cast("long") if "kind" in fps.columns else F.lit(0).cast("long")
    own = fps.select(kind.alias("kind"), "fp")
    rows = own.groupBy("kind").count().agg(F.max("count")).first()[0] or 0
    keys = [(_masks(bits), *key) for bits, t in probes for key in _keys(bits, t, rows)]
    mean = max((rows >> int(mask).bit_count() for _, mask, _ in keys), default=0)

    def links(part, run, x):
        for p in np.unique(part):
            group, _, flips = keys[p % len(keys)]
            own = part == p
            for cell, fp in _in_cells(x[own], run[own], group, flips):
                a, b = _run_edges(cell, fp, distance, most)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), p // len(keys), np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "a", "b"])

    def compare(batches):
        held, n, enough = [], 0, GATHERED_ROWS
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                n += batch.num_rows
                if n < enough:
                    continue
            if not n:
                continue
            now = [np.concatenate(c) for c in zip(*held)]
            starts = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in now[:3]], axis=0))))
            end = n if batch is None else starts[-1]  # the last run may go on
            run = np.searchsorted(starts, np.arange(end), side="right")
            yield from links(now[0][:end], run, now[3][:end].view(np.uint64))
            held, n = [[c[end:] for c in now]], n - end
            enough = max(GATHERED_ROWS, 2 * n)

    found = _keyed(own, [mask for _, mask, _ in keys], max(CELL_ROWS, 4 * mean)).repartition("part", "key", "block").sortWithinPartitions("part", "key", "block").mapInArrow(compare, "kind long, a long, b long")
    return found.filter("a <> b" if not most else "true").select("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _runs(batches, keys: int):
    """The columns of ``batches``, sorted by their first ``keys`` columns, as arrays over whole runs of equal keys."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        if held is None or not len(held[0]):
            continue
        starts = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in held[:keys]], axis=0))))
        done = starts if batch is None else starts[:-1]
        for lo, hi in zip(done, np.append(starts[1:], len(held[0]))):
            yield [c[lo:hi] for c in held]
        if batch is not None:
            held = [c[starts[-1] :] for c in held]


def _common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of ``sets`` have in common, by matrix products over blocks of the shingles that occur more than once."""
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, name, times = np.unique(flat, return_inverse=True, return_counts=True)
    many = times > 1
    name, of = (np.cumsum(many) - 1)[name[many[name]]], of[many[name]]
    by = np.argsort(name, kind="stable")
    name, of = name[by], of[by]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(many.sum()), 4096):
        own = slice(*np.searchsorted(name, [lo, lo + 4096]))
        has = np.zeros((len(sets), 4096), np.float32)
        has[of[own], name[own] - lo] = 1
        both += has @ has.T
    return both


def region_links(regions: DataFrame, docs: DataFrame, similarity: float, words: int) -> DataFrame:
    """(a, b) links of that Jaccard similarity that join the components of each region of ``regions`` (region, id, component).

    The texts of a region, from ``docs`` (id, text), are dealt into blocks, and
    every two blocks are compared in one task, which returns the edges of a
    forest, never the pairs.
    """
    sizes = regions.groupBy("region").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("region", F.ceil(F.col("n") / BLOCK_TEXTS).alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    dealt = regions.join(sizes, "region").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = dealt.join(docs, "id").select("region", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "id", "component", "text")

    def compare(batches):
        for _, _, _, ids, component, texts in _runs(batches, 3):
            if (component == component[0]).all():
                continue
            sets = [shingle_set(t, words) for t in texts]
            sizes, both = np.array([len(x) for x in sets]), _common_shingles(sets)
            alike = (both >= similarity * (sizes[:, None] + sizes[None, :] - both)) & (component[:, None] != component[None, :])
            root: dict[int, int] = {}
            kept = []

            def find(i):
                while root.setdefault(i, i) != i:
                    root[i] = i = root[root[i]]
                return i

            for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(alike)))):
                x, y = find(int(component[i])), find(int(component[j]))
                if x != y:
                    root[x] = y
                    kept.append((int(ids[i]), int(ids[j])))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.repartition("region", "p", "q").sortWithinPartitions("region", "p", "q").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 3, words: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, kept.

    Documents link where their fingerprints differ in at most ``distance``
    bits; component_id is the smallest doc_id reachable.  Copies share one
    fingerprint, are grouped before any search and never expanded into pairs.
    Null, empty and blank texts have fingerprint zero, linked like any other;
    rows repeated with one doc_id keep a row each; a document of a null doc_id
    keeps a row and links like any other, but names no component: one of null
    ids alone has none.  An empty table gives no rows; other columns are
    ignored.
    """
    own = cut(fingerprints(docs, words))
    groups = cut(own.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    parts = connected_components(fingerprint_links(groups, distance), "a", "b")
    placed = groups.join(parts, groups.fp == parts.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    names = placed.groupBy("c").agg(F.min("rep").alias("component_id"))
    of = placed.join(names, "c").select("fp", "component_id")
    return own.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of ``text``; the whole sequence where it has fewer words."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(parts[i : i + words])) for i in range(max(1, len(parts) - words + 1))], np.uint64))


def verify(pairs: DataFrame, docs: DataFrame, similarity: float, words: int) -> DataFrame:
    """The ``pairs`` (a, b) of ids in ``docs`` (id, text), one row an id, whose shingle sets have that Jaccard similarity or more."""

    def run(batches):
        for batch in batches:
            kept, last, own = [], None, None
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                if a != last:
                    last, own = a, shingle_set(x, words)
                other = shingle_set(y, words)
                both = len(np.intersect1d(own, other, assume_unique=True))
                kept.append(both >= similarity * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(kept, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    left = docs.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = docs.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def text_hash(text: str = "text") -> Column:
    """Column: a hash of a text, null and empty alike; with the doc_id it tells rows that share one."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def maybe_among(rows: DataFrame, name: Column, names: DataFrame, size: int, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: false for certain not in the column of ``names``, ``size`` hashes, by a broadcast filter.

    The filter grows with their number up to ``FILTER_BITS``; beyond that more
    rows are flagged true that aren't there.
    """
    bits = min(FILTER_BITS, 1 << max(16, math.ceil(math.log2(64 * max(1, size)))))
    word = lambda c: F.shiftrightunsigned(c.bitwiseAND(F.lit(bits - 1)), 6)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))
    own = names.toDF("_name")
    words = own.groupBy(word(F.col("_name")).alias("_word")).agg(F.bit_or(bit(F.col("_name"))).alias("_bits"))
    met = rows.withColumn("_name", name).join(F.broadcast(words), word(F.col("_name")) == F.col("_word"), "left")
    return met.withColumn(flag, F.coalesce(F.col("_bits").bitwiseAND(bit(F.col("_name"))) != 0, F.lit(False))).drop("_name", "_word", "_bits")


def row_name(doc_id: str = "doc_id", text_hash: str = "text_hash") -> Column:
    """Column: a hash of a row's doc_id and text."""
    return F.xxhash64(F.col(doc_id).cast("long"), text_hash)


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, distance: int = 8, words: int = 3, prints: int = 3) -> DataFrame:
    """One row per document: doc_id, text_hash, component_id, kept; documents link at that Jaccard similarity of their word shingles.

    Candidates are texts of which one of ``prints`` independent fingerprints
    differs in at most ``distance`` bits; all candidates are verified on the
    whole texts.  Texts of equal words, upper and lower case alike, are one
    before any search.  Texts that have very many candidates in a cell, and those that share a fingerprint
    but aren't similar to the first of its texts, are compared with all such
    texts that hang together with them within the distance, in blocks.  component_id is the smallest doc_id reachable, null where all
    are null.  kept marks the rows of one text and one doc_id of a component,
    that of component_id; rows repeated in full are marked alike, rows of one
    doc_id with other texts each by their own.  Null, empty and blank texts
    are copies of each other; an empty table gives no rows; other columns are
    ignored.
    """
    bound_batches(docs.sparkSession)
    fps = [f"fp{k}" for k in range(prints)]

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = np.array([fingerprint(t, words, many=prints) for t in texts], np.uint64).reshape(len(texts), prints).view(np.int64)
            sums = [xxhash.xxh128_intdigest(b" ".join((t or "").encode("utf-8", "replace").lower().split())) for t in texts]
            t1, t2 = (pa.array(np.array([(v >> at) & (2**64 - 1) for v in sums], np.uint64).view(np.int64)) for at in (0, 64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), t1, t2, *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(prints))], ["doc_id", "text_hash", "t1", "t2", *fps])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash().alias("text_hash"))
    own = cut(text.mapInArrow(run, ", ".join(["doc_id long, text_hash long, t1 long, t2 long", *(f"{c} long" for c in fps)])))
    # a node is the words of a text, named by their hash; the row of its least doc_id stands for it
    first_row = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    nodes = cut(own.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.min_by("text_hash", first_row).alias("text_hash"), *(F.first(c).alias(c) for c in fps)).withColumn("id", F.xxhash64("t1", "t2")))
    if nodes.isEmpty():
        return own.select("doc_id", "text_hash", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))

    def texts_of(pairs):
        ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        wanted = cut(ends.join(nodes.select("id", "rep", F.col("text_hash").alias("hash")), "id"))
        many = wanted.count()
        # only the wanted texts travel, and few others
        if many <= BROADCAST_TEXTS:
            wanted, some = F.broadcast(wanted), text
        else:
            some = maybe_among(text, row_name(), wanted.select(row_name("rep", "hash")), many, "_there").filter("_there")
        return some.join(wanted, some.doc_id.eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("hash"))).dropDuplicates(["id"]).select("id", "text")

    view = nodes.select("id", F.posexplode(F.array(*fps)).alias("kind", "fp")).withColumn("kind", F.col("kind").cast("long"))
    heads = cut(view.groupBy("kind", "fp").agg(F.min("id").alias("head")))
    probes = plan_probes(heads.filter("kind = 0"), distance)
    links = cut(fingerprint_links(heads, distance, probes, most=MOST_CANDIDATES))
    same = view.join(heads, ["kind", "fp"]).filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    end = lambda p, q: heads.select("kind", F.col("fp").alias(p), F.col("head").alias(q))
    between = links.filter("a <> b").join(end("a", "x"), ["kind", "a"]).join(end("b", "y"), ["kind", "b"]).select("x", "y")
    edges = cut(same.union(between).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # a link a text first, then only those between texts that are still apart, so that texts of a large group travel once
    first = cut(edges.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    found = cut(verify(first, texts_of(first), similarity, shingle_words))
    joined = connected_components(found, "a", "b")
    part = lambda p: joined.select(F.col("node").alias(p), F.col("component").alias(f"{p}_part"))
    apart = edges.join(first, ["a", "b"], "left_anti").join(part("a"), "a", "left").join(part("b"), "b", "left")
    apart = cut(apart.filter(F.coalesce("a_part", "a") != F.coalesce("b_part", "b")).select("a", "b"))
    verified = cut(found.union(verify(apart, texts_of(apart), similarity, shingle_words)))
    parts = connected_components(verified, "a", "b")
    # fingerprints of texts that aren't all joined, those near to them, and those with more candidates than were verified
    of = view.join(parts, F.col("id") == F.col("node"), "left").select("kind", "fp", "id", F.coalesce("component", "id").alias("component"))
    mixed = of.groupBy("kind", "fp").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("kind", F.col("fp").alias("f"))
    beside = lambda p, q: links.join(mixed.withColumnRenamed("f", p), ["kind", p]).select("kind", F.col(q).alias("f"))
    wanted = mixed.union(beside("a", "b")).union(beside("b", "a")).union(links.filter("a = b").select("kind", "a")).distinct()
    rest = cut(of.join(wanted.withColumnRenamed("f", "fp"), ["kind", "fp"]))
    if not rest.isEmpty():
        # regions: texts that hang together within the distance; all of their links are looked for
        first = cut(rest.groupBy("kind", "fp").agg(F.min("id").alias("first")))
        end = lambda p, q: first.select("kind", F.col("fp").alias(p), F.col("first").alias(q))
        near = fingerprint_links(first, distance, probes).join(end("a", "x"), ["kind", "a"]).join(end("b", "y"), ["kind", "b"]).select("x", "y")
        near = near.union(rest.join(first, ["kind", "fp"]).filter("id <> first").select("first", "id"))
        region = connected_components(near, "x", "y").withColumnsRenamed({"node": "id", "component": "region"})
        regions = cut(region.join(rest.select("id", "component").distinct(), "id"))
        wanted = regions.select(F.col("id").alias("a"), F.col("id").alias("b"))
        more = cut(region_links(regions, texts_of(wanted), similarity, shingle_words))
        parts = connected_components(verified.union(more), "a", "b")
    ranked = nodes.join(parts, F.col("id") == F.col("node"), "left").select("t1", "t2", "rep", F.coalesce("component", "id").alias("part"))
    first_node = F.struct(F.col("rep").isNull(), "rep", "t1", "t2")
    leaders = ranked.groupBy("part").agg(F.min("rep").alias("component_id"), F.min_by(F.struct("t1", "t2"), first_node).alias("lead"))
    of = ranked.join(leaders, "part").select("t1", "t2", "component_id", ((F.col("lead.t1") == F.col("t1")) & (F.col("lead.t2") == F.col("t2"))).alias("leads"))
    return own.join(of, ["t1", "t2"]).select("doc_id", "text_hash", "component_id", (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))
