"""Nearest neighbours by randomly rotated one-bit codes, reranked on the original vectors.

A unit vector is padded and turned by a seeded random rotation into ``bits``
coordinates; the index keeps their signs, packed, and two correction scalars:
the share of its length that the sign vector keeps, by which an estimate is
divided, and the error bound that follows from it.  A query keeps its rotated
coordinates.  Within a cell of rows and queries every row is estimated from
its packed bits; rows whose estimate plus bound reaches the query's k-th best
exact cosine so far are reranked on the original vectors.

Rows are dealt by a hash into groups of about ``GROUP_BYTES``, queries into
groups of ``QUERY_ROWS``; each pair of groups is one cell, which returns k
rows a query at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geomill.llm import vectors
from geomill.session import bytes_of, cut

GROUP_BYTES = 64 << 20
QUERY_ROWS = 1 << 14
#: Rows and queries estimated at once.
ROWS_AT_ONCE, QUERIES_AT_ONCE = 4096, 512


def rotation(dimension: int, bits: int, seed: int) -> np.ndarray:
    """``dimension`` orthonormal rows of ``bits`` coordinates in a random direction."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dimension]


def encode(unit: np.ndarray, turn: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, kept share, error bound) of each row."""
    y = unit @ turn
    bits = y.shape[1]
    share = np.abs(y).sum(1) / math.sqrt(bits)
    bound = slack * np.sqrt(np.maximum(1 - share**2, 0)) / share / math.sqrt(max(1, bits - 1))
    return np.packbits(y > 0, axis=1), share, bound


def build_index(rows: DataFrame, dimension: int, bits: int, slack: float, seed: int) -> DataFrame:
    """(id, vec, code, share, bound) of ``rows`` (id, vec)."""
    turn = rotation(dimension, bits, seed)

    def run(batches):
        for batch in batches:
            code, share, bound = encode(vectors.units(vectors.matrix(batch.column("vec"))), turn, slack)
            packed = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), packed, pa.array(share), pa.array(bound)], ["id", "vec", "code", "share", "bound"])

    kind = rows.schema["vec"].dataType.simpleString()
    return rows.mapInArrow(run, f"id long, vec {kind}, code binary, share double, bound double")


def _best(k: int, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Indices of the k best of each query: largest score, then smallest id."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    first = np.searchsorted(q, q, side="left")
    return order[np.arange(len(q)) - first < k]


def search_cell(rows: tuple, queries: tuple, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the query, id, cosine) of each query's k best rows.

    ``rows`` are ids, unit vectors, packed codes, shares and bounds; ``queries``
    ids and unit vectors.
    """
    parts = [_search(rows, tuple(x[at : at + QUERIES_AT_ONCE] for x in queries), turn, k) for at in range(0, len(queries[0]), QUERIES_AT_ONCE)]
    query = np.concatenate([p[0] + i * QUERIES_AT_ONCE for i, p in enumerate(parts)])
    return query, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def _search(rows: tuple, queries: tuple, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, unit, code, share, bound = rows
    q_ids, q_unit = queries
    bits = turn.shape[1]
    turned = (q_unit @ turn).astype(np.float32)
    found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    lowest = np.full(len(q_ids), -np.inf)

    def rerank(q: np.ndarray, r: np.ndarray):
        nonlocal found
        for at in range(0, len(q), 1 << 15):
            a, b = q[at : at + (1 << 15)], r[at : at + (1 << 15)]
            merged = [np.concatenate(x) for x in zip(found, (a, ids[b], vectors.cosines(q_unit[a], unit[b])))]
            best = _best(k, *merged)
            found = tuple(x[best] for x in merged)
        many = np.bincount(found[0], minlength=len(q_ids))
        full = many >= k
        lowest[full] = found[2][np.cumsum(many)[full] - 1]

    for lo in range(0, len(ids), ROWS_AT_ONCE):
        hi = min(lo + ROWS_AT_ONCE, len(ids))
        signs = np.unpackbits(code[lo:hi], axis=1, count=bits).astype(np.float32) * 2 - 1
        estimate = (turned @ signs.T) / (math.sqrt(bits) * share[lo:hi].astype(np.float32))
        may = q_ids[:, None] != ids[None, lo:hi]
        if not np.isfinite(lowest).all():
            some = min(4 * k, hi - lo)
            first = np.zeros(estimate.shape, bool)
            np.put_along_axis(first, np.argpartition(np.where(may, -estimate, np.inf), some - 1, axis=1)[:, :some], True, axis=1)
            q, r = np.nonzero(first & may)
            rerank(q, r + lo)
            may &= ~first
        q, r = np.nonzero(may & (estimate + bound[lo:hi] >= lowest[:, None]))
        rerank(q, r + lo)
    return found


def nearest(rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", bits: int = 256, slack: float = 3.5, seed: int = 29) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine) of the ``k`` nearest rows of each row that ``is_query`` holds for.

    A query's own row is no candidate, nor is any row of its id; rows of one id
    are one query, that of the smallest vector.  Ties go to the smaller id;
    fewer than ``k`` candidates are all returned.  Vectors that ``usable``
    leaves out take no part; null ids take no part; repeated rows are
    candidates each; an empty table gives no rows; other columns are ignored.
    A row is passed over only if its estimate lies more than ``slack`` standard
    deviations below its cosine.
    """
    spark = rows.sparkSession
    own = vectors.usable(rows.filter(F.col(vec_id).isNotNull()), vec_id, embedding)
    asked = vectors.usable(rows.filter(is_query & F.col(vec_id).isNotNull()), vec_id, embedding)
    head = own.select(F.size("vec").alias("n")).first()
    if head is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = asked.filter(F.size("vec") == head.n).groupBy("id").agg(F.min("vec").alias("vec"))
    turn = rotation(head.n, max(bits, head.n), seed)
    groups = max(2 * spark.sparkContext.defaultParallelism, math.ceil(bytes_of(rows) / GROUP_BYTES))
    index = cut(build_index(own, head.n, turn.shape[1], slack, seed))
    many = max(1, math.ceil(asked.count() / QUERY_ROWS))
    deal = lambda key, n, salt: F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(n)).cast("int")
    left = index.withColumn("r", deal("id", groups, 1)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    right = asked.withColumn("q", deal("id", many, 2)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def cell(key, r, q):
        if not r.num_rows or not q.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        code = np.frombuffer(b"".join(r.column("code").to_pylist()), np.uint8).reshape(r.num_rows, -1)
        q_ids = q.column("id").to_numpy()
        at, ids, scores = search_cell((r.column("id").to_numpy(), vectors.units(vectors.matrix(r.column("vec"))), code, r.column("share").to_numpy(), r.column("bound").to_numpy()), (q_ids, vectors.units(vectors.matrix(q.column("vec")))), turn, k)
        return pa.table({"query_id": q_ids[at], "vec_id": ids, "score": scores})

    found = left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInArrow(cell, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
