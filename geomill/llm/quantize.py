"""Compression of vectors to codes by integer codebooks trained with Yinyang Lloyd.

Vectors become integers and are cut into equal parts, each with a codebook of
its own.  A codebook's entries are clustered into groups once.  Every part of a
vector keeps its entry, an upper bound of the distance to it and one lower
bound a group, of the distances to the group's other entries.  When entries
move, the upper bound grows by the drift of its entry and each lower bound
falls by the largest drift of its group.  A group is scanned only where its
lower bound no longer lies above the upper bound, tightened first by the
distance to the entry itself.  Distances of scanned entries are exact integers,
so the nearest entry, ties to the lower index, is that of a full scan.

The vectors with their bounds are one table in the shared folder, written anew
each round, the one before deleted then; sums and counts of entries are added
up before they are shuffled.  Codebooks are the only thing that is collected:
parts x entries x length of a part numbers, whatever the rows.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.llm.vectors import matrix
from geomill.session import checkpoint_dir

#: Vectors assigned at once, and labels up to which their sums are broadcast.
ROWS_AT_ONCE, BROADCAST_LABELS = 2048, 100_000
#: Safety of bounds against rounding.
_SLACK = 1e-9


@dataclass
class Codebooks:
    """``entries``: integers by part, entry and place; ``group``: the group of each entry, by part."""

    entries: np.ndarray
    group: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, codes: np.ndarray, scale: float = 1024) -> np.ndarray:
        """The vectors that rows of codes stand for: middles of the integers' intervals."""
        return np.concatenate([self.entries[p][codes[:, p]] for p in range(len(self.entries))], axis=1) / scale + 0.5 / scale


def cluster_entries(entries: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each entry of one codebook, by a few rounds of k-means from spread-out entries."""
    x = entries.astype(np.float64)
    centres = x[np.linspace(0, len(x) - 1, min(groups, len(x))).astype(int)]
    for _ in range(rounds):
        own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[own == g].mean(0) if (own == g).any() else c for g, c in enumerate(centres)])
    return own


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` and ``c``, integers; doubles hold them up to 2**53, Python integers beyond."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 >= 1 << 53:
        a, b = x.astype(object), c.astype(object)
        return (a * a).sum(1)[:, None] - 2 * a.dot(b.T) + (b * b).sum(1)[None]
    a, b = x.astype(np.float64), c.astype(np.float64)
    return np.rint((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)


def _low(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 - _SLACK)


def first_assignment(x: np.ndarray, entries: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, squared distance to it, lower bound of each group) by a full scan of one part."""
    d = _squares(x, entries)
    best = np.argmin(d, axis=1)
    error = d[np.arange(len(x)), best]
    roots = _low(d)
    roots[np.arange(len(x)), best] = np.inf
    lower = np.stack([roots[:, group == g].min(1, initial=np.inf) for g in range(group.max() + 1)], axis=1)
    return best, error, lower


def next_assignment(x: np.ndarray, best: np.ndarray, upper: np.ndarray, lower: np.ndarray, entries: np.ndarray, group: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As ``first_assignment`` after entries moved by ``drift``, and how many distances were computed.

    ``upper`` is an upper bound of the distance to the entry before it moved.
    """
    best, rows = best.copy(), np.arange(len(x))
    far = np.array([drift[group == g].max(initial=0) for g in range(lower.shape[1])])
    lower = (lower - far[None] * (1 + _SLACK)) - _SLACK
    upper = (upper + drift[best]) * (1 + _SLACK) + _SLACK
    loose = np.flatnonzero(lower.min(1) <= upper)
    error = np.full(len(x), -1, object if x.dtype == object else np.int64)
    diff = x[loose].astype(np.int64) - entries[best[loose]]
    exact = (diff * diff).sum(1)
    error[loose] = exact
    upper[loose] = np.sqrt(exact.astype(np.float64)) * (1 + _SLACK) + _SLACK
    was, own, scanned = best.copy(), group[best], len(loose)
    fails = lower[loose] <= upper[loose, None]
    for g in range(lower.shape[1]):
        at = loose[fails[:, g]]
        members = np.flatnonzero(group == g)
        if not len(at) or not len(members):
            continue
        d = _squares(x[at], entries[members])
        scanned += d.size
        roots = _low(d)
        roots[members[None] == was[at, None]] = np.inf
        least = np.argmin(d, axis=1)
        there, name = d[np.arange(len(at)), least], members[least]
        better = (there < error[at]) | ((there == error[at]) & (name < best[at]))
        lower[at, g] = roots.min(1)
        error[at[better]], best[at[better]] = there[better], name[better]
    # an entry that is no longer one's own bounds its group, and the new one does not
    moved = np.flatnonzero(best != was)
    if len(moved):
        diff = x[moved].astype(np.int64) - entries[was[moved]]
        back = _low((diff * diff).sum(1))
        lower[moved, own[moved]] = np.minimum(lower[moved, own[moved]], back)
    return best, np.where(error >= 0, np.sqrt(np.maximum(error, 0).astype(np.float64)) * (1 + _SLACK) + _SLACK, upper), lower, scanned


def integers(rows: DataFrame, parts: int, scale: float, vec_id: str, embedding: str, keep: list[str]) -> DataFrame:
    """id, the ``keep`` columns and x (floor of each component times ``scale``) of the rows whose vector has numbers alone."""
    v = F.col(embedding)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    own = rows.filter(v.isNotNull() & finite & (F.size(v) > 0)).select(F.col(vec_id).cast("long").alias("id"), *keep, x.alias("x"))
    sizes = own.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("many"), F.max(F.array_max(F.transform("x", F.abs))).alias("most")).orderBy(F.desc("many"), F.desc("n")).first()
    if sizes is None:
        return own.filter("false")
    if sizes.n % parts:
        raise ValueError(f"vectors of {sizes.n} components can't be cut into {parts} equal parts")
    if sizes.most**2 * 4 * sizes.n >= 1 << 63:
        raise ValueError("components are too large for squared distances of 64 bits")
    return own.filter(F.size("x") == sizes.n)


class Trainer:
    """Rounds of assignment over one table of integer vectors in the shared folder."""

    def __init__(self, rows: DataFrame, parts: int, entries: int, groups: int):
        self.spark, self.parts = rows.sparkSession, parts
        self.folder = f"{checkpoint_dir(self.spark).rstrip('/')}/codes-{uuid.uuid4().hex}"
        self.at = None
        self.rows = self._written(rows)
        first = self.rows.select("id", "x").orderBy(F.asc_nulls_last("id"), "x").limit(entries).collect()
        x = np.array([r.x for r in first], np.int64)
        cut = np.stack(np.split(x, parts, axis=1)) if len(x) else np.zeros((parts, 0, 1), np.int64)
        self.books = Codebooks(cut, np.stack([cluster_entries(c, groups) for c in cut]) if len(x) else np.zeros((parts, 0), np.int64))
        self.drift = None

    def _written(self, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        if self.at:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        self.at = path
        return self.spark.read.schema(rows.schema).parquet(path)

    def assign(self) -> None:
        """Every part to its nearest entry, with bounds for the next round."""
        books, drift, parts = self.books, self.drift, self.parts
        keep = [f for f in self.rows.schema if f.name not in ("best", "upper", "lower")]

        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                    some = batch.slice(lo, ROWS_AT_ONCE)
                    x = np.split(_longs(some.column("x")), parts, axis=1)
                    old = None if drift is None else [matrix(some.column(c)) for c in ("best", "upper", "lower")]
                    best, upper, lower = [], [], []
                    for p in range(parts):
                        if old is None:
                            b, e, low = first_assignment(x[p], books.entries[p], books.group[p])
                            up = np.sqrt(e.astype(np.float64)) * (1 + _SLACK) + _SLACK
                        else:
                            width = old[2].shape[1] // parts
                            b, up, low, _ = next_assignment(x[p], old[0][:, p].astype(np.int64), old[1][:, p], old[2][:, p * width : (p + 1) * width], books.entries[p], books.group[p], drift[p])
                        best.append(b)
                        upper.append(up)
                        lower.append(low)
                    most = max(a.shape[1] for a in lower)
                    lower = [np.pad(a, ((0, 0), (0, most - a.shape[1])), constant_values=np.inf) for a in lower]
                    # 32-bit bounds are rounded outwards
                    up = np.nextafter(np.stack(upper, 1).astype(np.float32), np.float32(np.inf))
                    low = np.nextafter(np.concatenate(lower, 1).astype(np.float32), np.float32(-np.inf))
                    yield pa.RecordBatch.from_arrays([*(some.column(f.name) for f in keep), _lists(np.stack(best, 1).astype(np.int32)), _lists(up), _lists(low)], [*(f.name for f in keep), "best", "upper", "lower"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
        self.rows = self._written(self.rows.mapInArrow(run, f"{kinds}, best array<int>, upper array<float>, lower array<float>"))

    def move(self) -> None:
        """Entries to the floors of the means of their parts; those without parts stay."""
        shape = self.books.entries.shape

        def run(batches):
            sums, many = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
            for batch in batches:
                x, best = _longs(batch.column("x")), matrix(batch.column("best")).astype(np.int64)
                for p in range(shape[0]):
                    own = x[:, p * shape[2] : (p + 1) * shape[2]]
                    order = np.argsort(best[:, p], kind="stable")
                    names, first = np.unique(best[order, p], return_index=True)
                    if len(names):
                        sums[p][names] += np.add.reduceat(own[order], first, axis=0)
                        many[p] += np.bincount(best[:, p], minlength=shape[1])
            part, entry = np.nonzero(many)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(many[part, entry]), _lists(sums[part, entry])], ["part", "entry", "many", "sums"])

        sums = self.rows.select("x", "best").mapInArrow(run, "part int, entry int, many long, sums array<long>")
        added = sums.groupBy("part", "entry").agg(F.sum("many").alias("many"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(shape[2])))
        entries = self.books.entries.copy()
        for r in added.collect():  # parts x entries rows at most
            entries[r.part, r.entry] = [r[3 + i] // r.many for i in range(shape[2])]
        step = (entries - self.books.entries).astype(np.float64)
        self.drift = np.sqrt((step * step).sum(2)) * (1 + _SLACK)
        self.books = Codebooks(entries, self.books.group)


def _longs(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def compress(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024, groups: int = 16, vec_id: str = "vec_id", embedding: str = "embedding", keep: dict[str, str] | None = None) -> tuple[DataFrame, Codebooks]:
    """(vec_id, codes, error and the columns of ``keep``, as {name: column}; the codebooks).

    Vectors that are null or empty, hold null or non-finite components, or are
    of another length than the commonest (the longest of equally common ones)
    are dropped; zero vectors and null ids stay.  Codebooks start as the parts
    of the smallest ids, ascending, nulls last, repeated ids by their vectors;
    with fewer rows they have fewer entries.  Repeated rows count each.  An
    empty table gives no rows and empty codebooks.  ``error`` is the squared
    distance to the entries, summed over the parts.  A length that the parts do
    not divide and components whose squares leave 64 bits raise ValueError.
    """
    kept = keep or {}
    named = [F.col(c).alias(f"k{i}") for i, c in enumerate(kept.values())]
    trainer = Trainer(integers(rows, parts, scale, vec_id, embedding, named), parts, entries, groups)
    books = trainer.books
    if books.entries.shape[1]:
        for _ in range(rounds):
            trainer.assign()
            trainer.move()
        trainer.assign()
        books = trainer.books

    def measure(batches):
        for batch in batches:
            x, best = _longs(batch.column("x")), matrix(batch.column("best")).astype(np.int64)
            diff = np.split(x, parts, axis=1)
            error = sum(((d - books.entries[p][best[:, p]]) ** 2).sum(1) for p, d in enumerate(diff)) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("best"), pa.array(error), *(batch.column(f"k{i}") for i in range(len(kept)))], ["vec_id", "codes", "error", *(f"k{i}" for i in range(len(kept)))])

    kinds = "".join(f", k{i} {trainer.rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(kept)))
    source = trainer.rows if books.entries.shape[1] else trainer.rows.withColumn("best", F.array().cast("array<int>"))
    found = source.select("id", "x", "best", *(f"k{i}" for i in range(len(kept)))).mapInArrow(measure, f"vec_id long, codes array<int>, error long{kinds}")
    return found.withColumnsRenamed({f"k{i}": c for i, c in enumerate(kept)}), books


def code_text(codes: str = "codes") -> Column:
    """Codes as two lower-case hex digits each."""
    return F.lower(F.concat_ws("", F.transform(codes, lambda c: F.lpad(F.hex(c), 2, "0"))))


def with_group_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with label_error: the errors summed over rows of equal label, nulls together."""
    sums = coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error"))
    few = coded.select(F.approx_count_distinct(label)).first()[0] <= BROADCAST_LABELS // 2
    return coded.join(F.broadcast(sums) if few else sums, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
