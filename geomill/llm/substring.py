"""Exact removal of repeated word windows, found by recompression.

Every text is rewritten in rounds, in the first of which a Spark task names
the runs of its texts and in each the pairs.  A run of equal words becomes one
symbol, named by a hash of its base and length.  Symbols are split into a
left and a right class by a hash of their names, and each left symbol followed
by a right one becomes a new symbol, named by a hash of the pair.  Names follow
from content alone, so equal word sequences get equal names in any document of
any task, and a round needs no table of names.  Inside a window only the
outermost run and the outermost unpaired symbol at either end can differ
between two occurrences; what is left is its interior, the same in every
occurrence.  A window that a step would leave without interior keeps the one
before.  The interior symbol with the least hash is the window's anchor.

Spark rounds then compare the names of all documents: names of anchors are
counted, windows under a repeated anchor are verified by 128-bit keys of their
words, and the first of each key is found.  Documents are dealt to groups of
about ``GROUP_BYTES``; a group sends one row for each distinct name or key it
holds, so that a passage in a third of all documents costs a row per group.
Documents whose whole text a smaller doc_id has, by a 128-bit hash, send
nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geomill.session import bytes_of

#: Rounds, and those of them that name runs before pairs.
ROUNDS, RUN_ROUNDS = 3, 1
#: Interior symbols to either side of the least one that its window's anchor takes in.
SIDES = 1
#: Stored bytes of documents that a group gets on average.
GROUP_BYTES = 1 << 20
#: Parts that the copies of one text are split into when they are told from the first.
COPY_SALTS = 16
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _least(names: np.ndarray, lo: np.ndarray, hi: np.ndarray, stage: int) -> tuple[np.ndarray, np.ndarray]:
    """(name of the anchor, its place) of the windows with the interiors ``lo`` to ``hi`` among the symbols ``names``."""
    hashed = _mix(names + _B)
    best, depth = [np.arange(len(hashed))], int(math.log2(max(1, int((hi - lo).max(initial=1)))))
    for k in range(depth):
        a = best[-1][: len(best[-1]) - (1 << k)]
        b = best[-1][1 << k :]
        best.append(np.where(hashed[a] <= hashed[b], a, b))
    level = np.log2(hi - lo).astype(np.int64)
    at = np.empty(len(lo), np.int64)
    for k in range(depth + 1):
        own = level == k
        a, b = best[k][lo[own]], best[k][hi[own] - (1 << k)]
        at[own] = np.where(hashed[a] <= hashed[b], a, b)
    name = hashed[at] + np.uint64(stage)
    for d in range(1, SIDES + 1):
        for side, inside in ((at - d, at - d >= lo), (at + d, at + d < hi)):
            name = _mix(name * _A + np.where(inside, hashed[np.clip(side, 0, len(hashed) - 1)], _C))
    return name, at * (2 * ROUNDS + 1) + stage


def anchors(codes: np.ndarray, doc: np.ndarray, starts: np.ndarray, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Names of the anchors of the windows at ``starts``, and for each the place of its symbol."""
    sym, lo, hi = codes, starts, starts + window
    names, places = np.empty(len(starts), np.uint64), np.empty(len(starts), np.int64)
    left = np.arange(len(starts))  # windows whose interior may still shrink

    def settle(done: np.ndarray, stage: int):
        names[left[done]], places[left[done]] = _least(sym, lo[done], hi[done], stage)

    for r in range(rounds):
        if r < RUN_ROUNDS:
            begins = np.ones(len(sym), bool)
            begins[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(begins)
            many = np.diff(np.append(first, len(sym))).astype(np.uint64)
            run = np.cumsum(begins) - 1
            inner = run[lo] + 1, run[hi - 1]
            fits = inner[0] < inner[1]
            settle(~fits, 2 * r)
            left, lo, hi = left[fits], inner[0][fits], inner[1][fits]
            sym, doc = np.where(many > 1, _mix(sym[first] * _B + _mix(many + _A)), sym[first]), doc[first]
        # pairs
        right = (_mix(sym ^ np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(sym), bool)
        joins[:-1] = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:])
        begins = np.ones(len(sym), bool)
        begins[1:] = ~joins[:-1]
        inner = lo + right[lo], hi - ~right[hi - 1]
        fits = inner[0] < inner[1]
        settle(~fits, 2 * r + 1)
        left, parent = left[fits], np.cumsum(begins) - 1
        lo, hi = parent[inner[0][fits]], parent[inner[1][fits] - 1] + 1
        pairs = np.flatnonzero(joins)
        new = sym.copy()
        new[pairs] = _mix(sym[pairs] * _A + _mix(sym[pairs + 1] + _C))
        sym, doc = new[begins], doc[begins]
    settle(np.ones(len(left), bool), 2 * rounds)
    return names, places


#: Random odd factors of bytes and of words, and a random value for each byte, for each half of the 128-bit keys.
_BYTE, _WORD = (0x9E3779B97F4A7C15, 0xA0761D6478BD642F), (0xD1342543DE82EF95, 0xE7037ED1A0B428DB)
_VALUES = tuple(_mix(np.arange(1, 257, dtype=np.uint64) * x) for x in (_A, _B))
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    p = np.full(max(1, n), base % 2**64, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)[:n]


def _span_hashes(values: np.ndarray, base: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of the values of each span, by differences of one running sum; spans of equal values have equal hashes."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=sums[1:])
    return _mix((sums[stops] - sums[starts]) * _powers(pow(base, -1, 2**64), len(values) + 1)[starts] + (stops - starts).astype(np.uint64))


def text_hash(text: bytes) -> tuple[int, int]:
    """The 128-bit hash of ``_copies`` as two signed longs."""
    halves = xxhash.xxh64_intdigest(text, 42), xxhash.xxh64_intdigest(text, xxhash.xxh64_intdigest(b"\1\0\0\0", 42))
    return tuple(h - (1 << 64) if h >> 63 else h for h in halves)


class _Group:
    """The documents of one group in the order of doc, their words coded and laid end to end.

    A document known as a copy of another has no windows: all that it could
    have start earlier, in the first of the copies.
    """

    def __init__(self, docs: pa.Table, window: int):
        marks = docs.column("copy").to_numpy(zero_copy_only=False).astype(bool)
        marked = docs.filter(pa.array(marks))
        copies = set(zip(*(marked.column(c).to_pylist() for c in ("doc", "a", "b"))))
        named = {d for d, _, _ in copies}
        docs = docs.filter(pa.array(~marks)).combine_chunks()
        ids = docs.column("doc").to_pylist()
        texts = docs.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or b""))
        self.rows = docs.take(pa.array(order, pa.int64()))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.raw = [texts[i] for i in order]
        self.copy = np.array([i in named and (i, *text_hash(x or b"")) in copies for i, x in zip(self.ids.tolist(), self.raw)], bool)
        whole = b" ".join([x or b"" for x in self.raw]) + b" "
        limits = np.cumsum([len(x or b"") + 1 for x in self.raw])
        self.bytes = np.frombuffer(whole, np.uint8)
        space = _SPACE[self.bytes]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        self.begin, self.stop = edge[::2], edge[1::2]
        self.doc = np.searchsorted(limits, self.begin, side="right")
        self.sizes = np.bincount(self.doc, minlength=len(order)).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.window = window
        n = len(self.begin)
        self.codes = self._codes(0)
        self.starts = np.flatnonzero(np.arange(n) + window <= self.ends[self.doc]) if n else np.empty(0, np.int64)
        self.starts = self.starts[~self.copy[self.doc[self.starts]]]

    def _codes(self, half: int) -> np.ndarray:
        return _span_hashes(_VALUES[half][self.bytes], _BYTE[half], self.begin, self.stop)

    def kept(self, d: int, gone: np.ndarray) -> bytes:
        """The words of document ``d`` that aren't ``gone``, joined by one space."""
        at = np.flatnonzero(~gone) + self.ends[d] - self.sizes[d]
        return b" ".join([self.bytes[i:j].tobytes() for i, j in zip(self.begin[at].tolist(), self.stop[at].tolist())])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.starts):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return anchors(self.codes, self.doc, self.starts, self.window)

    def keys(self, starts: np.ndarray) -> np.ndarray:
        """128-bit keys of the windows at ``starts``, as rows of two halves."""
        halves = [_span_hashes(codes, _WORD[h], starts, starts + self.window) for h, codes in enumerate((self.codes, self._codes(1)))]
        return np.column_stack(halves)

    def candidates(self, names: np.ndarray) -> np.ndarray:
        """Starts of the windows whose anchor is one of the sorted ``names``."""
        own, _ = self.anchors()
        if not len(own) or not len(names):
            return np.empty(0, np.int64)
        i = np.minimum(np.searchsorted(names, own), len(names) - 1)
        return self.starts[names[i] == own]

    def first(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys, start of each key's first window, whether it has others) in this group.

        Only a smaller doc or an earlier start makes a window earlier, so equal
        starts in rows of one doc count once.
        """
        key = self.keys(starts)
        ids, place = self.place(starts)
        order = np.lexsort((place, ids, key[:, 1], key[:, 0]))
        key, at, ids, place = key[order], starts[order], ids[order], place[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]).any(1)
        first = np.flatnonzero(new)
        return key[first], at[first], np.diff(np.append(first, len(key))) > 1

    def place(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(doc, start in that document)."""
        d = self.doc[starts]
        return self.ids[d], starts - (self.ends - self.sizes)[d]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _group_of(doc: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(groups)).cast("int")


def _column(marks: pa.Table, name: str) -> np.ndarray:
    return marks.column(name).to_numpy().astype(np.int64).view(np.uint64)


def _copies(own: DataFrame, groups: int) -> DataFrame:
    """A mark (doc, hash of the text, g, copy, no text) for each document of a doc_id whose text a smaller doc_id has too."""
    hashed = F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")
    slim = own.filter("doc_id IS NOT NULL AND text <> ''").select("doc", *hashed, F.pmod(F.xxhash64("doc"), F.lit(COPY_SALTS)).alias("salt"))
    first = slim.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("a", "b", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPY_SALTS - 1).cast("long"))).alias("salt"))
    later = slim.join(first, ["a", "b", "salt"]).filter("doc > first")
    return later.select("doc", "a", "b", F.lit(None).cast("string").alias("text"), _group_of(F.col("doc"), groups).alias("g"), F.lit(True).alias("copy"))


def remove_repeats(docs: DataFrame, window: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text, and the columns of ``keep``.

    A word goes if a window of ``window`` consecutive words covers it whose
    sequence also starts earlier: at a smaller doc_id, or earlier in the same
    document.  Windows are judged on the input.  Words are maximal runs of
    characters that aren't ASCII white space; kept_text joins the kept words by
    one space where words went, and is the text unchanged where none did.
    Null, empty and blank texts have no words and are returned as they are.
    Rows of one doc_id are one document: of a window that several of them hold
    the earliest start stays, in every row that has it there.  Rows of a null
    doc_id come after all others, those of one text as one document, in the
    order of a hash of their texts.  An empty table gives no rows; columns
    other than those of ``keep`` are ignored.  doc_ids lie below 2**63 - 2**40;
    ``window`` is at least 4.
    """
    if window < 4:
        raise ValueError("window must be 4 or more")
    groups = max(1, math.ceil(bytes_of(docs) / GROUP_BYTES))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1) - F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit(2**40 - 1)))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), order.alias("doc"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)))
    own = own.withColumn("g", _group_of(F.col("doc"), groups)).withColumn("copy", F.lit(False)).unionByName(_copies(own, groups), allowMissingColumns=True)

    def name(key, t):
        names, at = _Group(t, window).anchors()
        order = np.lexsort((at, names))
        names, at = names[order], at[order]
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | (at[1:] != at[:-1])
        distinct, counts = np.unique(names[new], return_counts=True)  # a name at two places repeats
        return pa.table({"g": pa.array(np.full(len(distinct), key[0].as_py(), np.int32)), "name": _long(distinct), "many": pa.array(counts > 1)})

    named = own.groupBy("g").applyInArrow(name, "g int, name long, many boolean")
    by = W.partitionBy("name")
    shared = named.withColumn("n", F.count("*").over(by)).filter("n > 1 OR many").select("g", "name")

    def key_windows(key, t, marks):
        group = _Group(t, window)
        keys, at, many = group.first(group.candidates(np.sort(_column(marks, "name"))))
        ids, start = group.place(at)
        return pa.table({"key": _long(keys[:, 0]), "more": _long(keys[:, 1]), "doc": _long(ids), "place": _long(start * 2 + many)})

    keyed = own.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(key_windows, "key long, more long, doc long, place long")
    by = W.partitionBy("key", "more")
    ranked = keyed.withColumn("n", F.count("*").over(by)).withColumn("rank", F.row_number().over(by.orderBy("doc", "place")))
    verdicts = ranked.filter("n > 1 OR place % 2 = 1").select(_group_of(F.col("doc"), groups).alias("g"), "key", "more", (F.col("rank") == 1).alias("first"))

    def drop(key, t, marks):
        group = _Group(t, window)
        gone = np.zeros(len(group.codes) + 1, np.int64)
        if marks.num_rows and len(group.starts):
            known, more = _column(marks, "key"), _column(marks, "more")
            order = np.lexsort((more, known))
            known, more, leads = known[order], more[order], marks.column("first").to_numpy(zero_copy_only=False)[order]
            keys = group.keys(group.starts)
            i = np.minimum(np.searchsorted(known, keys[:, 0]), len(known) - 1)
            while True:  # on to the verdict of the second half, where first halves are equal
                on = (known[i] == keys[:, 0]) & (more[i] != keys[:, 1]) & (i + 1 < len(known))
                if not on.any():
                    break
                i = i + on
            hit = (known[i] == keys[:, 0]) & (more[i] == keys[:, 1])
            starts, i = group.starts[hit], i[hit]
            ids, start = group.place(starts)
            by_place = np.lexsort((start, ids))
            lead = np.full(len(known), len(starts), np.int64)  # in order of place, each key's first window here
            where = np.empty(len(starts), np.int64)
            where[by_place] = np.arange(len(starts))
            np.minimum.at(lead, i, where)
            if len(starts):
                at = by_place[lead[i]]
                stays = leads[i] & (ids == ids[at]) & (start == start[at])
                np.add.at(gone, starts[~stays], 1)
                np.add.at(gone, starts[~stays] + window, -1)
        gone = np.cumsum(gone)[:-1] > 0
        n_removed, kept = [], []
        for d in range(len(group.ids)):
            out = gone[group.ends[d] - group.sizes[d] : group.ends[d]]
            if group.copy[d] and len(out) >= window:
                out = np.ones(len(out), bool)
            n_removed.append(int(out.sum()))
            kept.append(group.raw[d] if not n_removed[-1] else group.kept(d, out))
        return pa.table({"doc_id": group.rows.column("doc_id"), "n_words": _long(group.sizes), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), **{c: group.rows.column(f"kept_{i}") for i, c in enumerate(keep)}})

    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return own.groupBy("g").cogroup(verdicts.groupBy("g")).applyInArrow(drop, ", ".join(["doc_id long, n_words long, n_removed long, kept_text string", *kept]))


def kept_words_sha256(column: str = "kept_text"):
    """Column: lowercase hex SHA-256 of the words of ``column`` joined by one space, as UTF-8."""
    space = "[ \\t\\n\\x0B\\f\\r]+"
    return F.sha2(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), f"^{space}|{space}$", ""), space, " ").cast("binary"), 256)
