"""Benchmark passages in documents, by a prefix-filtered join of shingle sets.

The sets on one side are the windows of the items: ``window`` consecutive
words of an item, or all words of a shorter one, as sets of shingles of
``SHINGLE`` words.  Shingles are ordered by rarity, as counted over all
documents.  A window that a document contains shares every one of its shingles
with it, so the necessary prefix is its single rarest shingle; windows whose
rarest shingle no document has are gone before the join.  Documents send those
of their shingles that a filter of fixed size knows as prefixes, each with the
words around it.  Joined by the shingle, a pair must pass the positional bound
(the window's place follows from the shingle's place in both), the length bound
(it must end within the document) and the comparison of all words over the
item-sized window.

Neither side is collected: rarities, prefixes and pairs are joins of hashes.
The filter is a bitmap of at most ``FILTER_BITS`` bits; with more shingles than
it tells apart it lets more through, which the join then drops.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geomill.llm.lexical import word_batches
from geomill.session import cut

SHINGLE = 5
#: Largest filter of shingle hashes that is broadcast: 16 MiB.
FILTER_BITS = 1 << 27
#: Largest table of prefixes that is broadcast, by rows; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
_SPAN = "array<struct<start:int,length:int>>"


def item_windows(items: DataFrame, window: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, words, names) of every distinct window of each item; names are its shingles' hashes in order."""

    def run(batches):
        for batch in batches:
            for part, words in word_batches(batch, "text"):
                codes, ids = words.codes(), part.column("item_id").to_pylist()
                names = {}
                for n in range(1, SHINGLE + 1):
                    starts, hashes = words.shingles(codes, n)
                    names[n] = dict(zip(starts.tolist(), hashes.view(np.int64).tolist()))
                rows = {}
                for i, (first, size) in enumerate(zip(words.first.tolist(), words.sizes.tolist())):
                    if not size:
                        continue
                    length = min(window, size)
                    n = min(SHINGLE, length)
                    for start in range(first, first + size - length + 1):
                        rows[ids[i], tuple(words.text(start, start + length))] = [names[n][s] for s in range(start, start + length - n + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], part.schema.field("item_id").type), pa.array([list(k[1]) for k in rows], pa.list_(pa.string())), pa.array(list(rows.values()), pa.list_(pa.int64()))], ["item_id", "words", "names"])

    own = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"item_id {own.schema['item_id'].dataType.simpleString()}, words array<string>, names array<long>")


def _filter(names: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the hashes in ``column``; its size follows their number up to ``FILTER_BITS``."""
    many = names.select(column).distinct().count()
    bits = min(FILTER_BITS, 1 << max(16, math.ceil(math.log2(64 * max(1, many)))))
    place = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = names.groupBy(F.shiftrightunsigned(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _known(bitmap: np.ndarray, names: np.ndarray) -> np.ndarray:
    place = names & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _occurrences(docs: DataFrame, names: DataFrame, lengths: list[int]) -> DataFrame:
    """(name, n): how often the documents hold each shingle of ``names``."""
    bitmap = docs.sparkSession.sparkContext.broadcast(_filter(names, "name"))

    def run(batches):
        for batch in batches:
            for _, words in word_batches(batch, "text"):
                codes = words.codes()
                found = [h[_known(bitmap.value, h)] for _, h in (words.shingles(codes, n) for n in lengths)]
                name, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(n.astype(np.int64))], ["name", "n"])

    return docs.select("text").mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, prefixes: DataFrame, lengths: list[int], window: int) -> DataFrame:
    """``docs`` without its text, with n_words and found: place, hash and surrounding words of each shingle that may be a prefix."""
    bitmap = docs.sparkSession.sparkContext.broadcast(_filter(prefixes, "name"))
    kind = pa.list_(pa.struct([("name", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("near", pa.list_(pa.string()))]))

    def run(batches):
        for batch in batches:
            for part, words in word_batches(batch, "text"):
                codes = words.codes()
                found = [[] for _ in range(part.num_rows)]
                for n in lengths:
                    starts, names = words.shingles(codes, n)
                    own = _known(bitmap.value, names)
                    for s, name in zip(starts[own].tolist(), names[own].view(np.int64).tolist()):
                        d = int(words.doc[s])
                        first, last = int(words.first[d]), int(words.first[d] + words.sizes[d])
                        low = max(first, s - window + 1)
                        found[d].append({"name": name, "at": s - first, "low": low - first, "near": words.text(low, min(last, s + window))})
                kept = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(words.sizes), pa.array(found, kind)], [*kept, "n_words", "found"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{kept}, n_words long, found array<struct<name:long,at:int,low:int,near:array<string>>>")


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, spans (start, length of each window met, in words), items (sorted distinct ids of the items whose windows occur), n_hit (words inside a span); one row per row of ``docs``.

    A null or blank text has no words, no spans and no items; a null or blank
    item has no window.  Rows of one item_id are one item; an item without an
    id hits words, but is not listed.  Repeated documents and null ids have a
    row each.  Other columns are ignored, whatever their names.  Empty tables
    on either side give no row, or rows without hits.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    read = cut(item_windows(items, window, item_id, item_text))
    windows = cut(read.select("words", "names").distinct().withColumn("w", F.monotonically_increasing_id()))
    shingles = windows.select("w", F.posexplode("names").alias("offset", "name"))
    lengths = sorted(r[0] for r in windows.select(F.least(F.lit(SHINGLE), F.size("words"))).distinct().collect())
    if not lengths:
        return _candidates(own, shingles, [], window).select("doc_id", "n_words", F.array().cast(_SPAN).alias("spans"), F.array().cast(f"array<{read.schema['item_id'].dataType.simpleString()}>").alias("items"), F.lit(0).cast("long").alias("n_hit"))
    counts = _occurrences(own, shingles, lengths)
    rarest = shingles.join(counts, "name").groupBy("w").agg(F.min(F.struct("n", "name", "offset")).alias("p"), F.count("*").alias("there"))
    # a shingle that no document has has no count: its window occurs nowhere
    prefixes = cut(rarest.join(windows, "w").filter(F.col("there") == F.size("names")).select("w", "p.name", "p.offset", "words"))
    few = prefixes.count() <= BROADCAST_ROWS
    sized = lambda df: F.broadcast(df) if few else df
    met = cut(_candidates(own, prefixes, lengths, window).withColumn("row", F.monotonically_increasing_id()))
    at = met.filter(F.size("found") > 0).select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")
    start, length = F.col("at") - F.col("offset"), F.size("words")
    bounds = (start >= F.col("low")) & (start + length <= F.col("n_words"))
    pairs = at.join(sized(prefixes), "name").filter(bounds).filter(F.slice("near", start - F.col("low") + 1, length) == F.col("words"))
    pairs = cut(pairs.select("row", "w", start.cast("int").alias("start"), length.alias("length")))
    owners = read.join(windows, ["words", "names"]).filter(F.col("item_id").isNotNull()).select("w", "item_id").distinct()
    found = pairs.select("row", "w").distinct().join(owners, "w").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    spans = pairs.select("row", "start", "length").distinct()
    order = W.partitionBy("row").orderBy("start", "length")
    end = F.col("start") + F.col("length")
    before = F.coalesce(F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hit = spans.withColumn("new", F.greatest(F.lit(0), end - F.greatest("start", before))).groupBy("row").agg(F.sum("new").alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"))
    clean = met.filter(F.size("found") == 0).select("doc_id", "n_words", F.lit(None).cast(_SPAN).alias("spans"), F.lit(None).cast(found.schema["items"].dataType).alias("items"), F.lit(0).cast("long").alias("n_hit"))
    touched = met.filter(F.size("found") > 0).select("row", "doc_id", "n_words").join(hit, "row", "left").join(found, "row", "left").select("doc_id", "n_words", "spans", "items", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"))
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(found.schema["items"].dataType if c == "items" else _SPAN)).alias(c)
    return clean.union(touched).select("doc_id", "n_words", empty("spans"), empty("items"), "n_hit")


def items_sha256(items: str = "items") -> Column:
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.concat_ws(",", F.array_sort(F.transform(items, lambda x: x.cast("string")))), 256)
