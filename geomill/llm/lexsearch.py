"""Ranked lexical search by Fagin's threshold algorithm over shards of documents.

Statistics (documents, terms, documents of a term) are counted over all
documents first, so a document's score is the same in any shard.  A shard is a
run of documents of one task.  It has an inverted list for each query term,
sorted by impact, and a forward index from document and term to impact.  For
each query the lists are read in rounds, equally deep in each; every document
met for the first time is scored whole by random lookups in the forward index;
reading stops when the threshold, the score of a document with the last impact
read of every list, lies strictly below the score of the k-th best so far.  A
task carries its best from shard to shard, so that later shards stop sooner,
and sends k rows a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geomill.llm.lexical import Words, word_batches
from geomill.session import cut

#: Bytes of query text of one block; each block of queries is a pass over the documents.
BLOCK_BYTES = 1 << 20
#: Entries of a shard's forward index, four bytes each.
SHARD_ENTRIES = 1 << 22
#: Parts that a query's best rows are dealt into before the last ranking.
SALTS = 16


class Queries:
    """Distinct terms of a block of queries in the order of their hashes, and for each query its terms with repeats counted."""

    def __init__(self, ids: list, texts: list[str | None]):
        words = Words([None if t is None else t.encode() for t in texts])
        code, check = words.codes(), words.codes(1)
        self.codes, first, term = np.unique(code, return_index=True, return_inverse=True)
        self.checks = check[first]
        self.items = []
        for item, begin, size in zip(ids, words.first.tolist(), words.sizes.tolist()):
            terms, many = np.unique(term[begin : begin + size], return_counts=True)
            if len(terms):
                self.items.append((item, terms, many.astype(np.int64)))

    def terms(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(index of the word, term) of the words that are query terms, told by 128 bits."""
        if not len(self.codes) or not len(words.begin):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = words.codes()
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        own = np.flatnonzero((self.codes[at] == code) & (self.checks[at] == words.codes(1)))
        return own, at[own]


def forward_index(docs: DataFrame, queries: Queries) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents that have a term; terms and tfs hold the query terms alone."""
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        for batch in batches:
            for part, words in word_batches(batch, "text"):
                own, term = shared.value.terms(words)
                most = max(1, len(shared.value.codes))
                pair, tf = np.unique(words.doc[own] * most + term, return_counts=True)
                ends = np.searchsorted(pair // most, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pair % most, tf)]
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.sizes), *lists], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(words.sizes > 0))

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N+2)/(2df+1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Shard:
    """Impact-sorted lists and a forward index of some documents."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, ends: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
        m = 75 + (25 * n * n_docs) // n_terms
        doc = np.repeat(np.arange(len(ids)), np.diff(ends))
        share = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        self.ids, self.weight = ids, weight
        self.forward = np.zeros((len(ids), len(weight)), np.int32)  # shares are a million at most
        self.forward[doc, term] = share
        order = np.lexsort((ids[doc], -share, term))
        self.docs, self.shares = doc[order], share[order]
        self.lists = np.searchsorted(term[order], np.arange(len(weight) + 1))

    def search(self, terms: np.ndarray, many: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, id) of a query among ``best`` and this shard, highest first, ties by id."""
        factor = self.weight[terms] * many
        lo, hi = self.lists[terms], self.lists[terms + 1]
        new, depth, stride = np.ones(len(self.ids), bool), 0, k
        while (lo + depth < hi).any():
            upto = np.minimum(lo + depth + stride, hi)
            read = np.concatenate([self.docs[a:b] for a, b in zip((lo + depth).tolist(), upto.tolist()) if a < b])
            read = np.unique(read[new[read]])
            new[read] = False
            scores = self.forward[np.ix_(read, terms)].astype(np.int64) @ factor
            best = top(np.concatenate([best[0], scores]), np.concatenate([best[1], self.ids[read]]), k)
            depth += stride
            stride *= 2
            left = lo + depth < hi
            last = np.where(left, self.shares[np.minimum(lo + depth, hi) - 1], 0)
            if len(best[0]) == k and int(last @ factor) < best[0][-1]:
                break
        return best


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest positive scores and their ids, ties by id."""
    order = np.lexsort((ids, -scores))[:k]
    order = order[scores[order] > 0]
    return scores[order], ids[order]


def _search_block(index: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(query, doc_id, score): the k best of each query in each task; query is its number in ``queries``."""
    spark = index.sparkSession
    n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(queries.codes), np.int64)
    for term, many in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[term] = many
    weight, items = weights(n_docs, df), [(terms, many) for _, terms, many in queries.items]
    shared = spark.sparkContext.broadcast((weight, items))

    def run(batches):
        weight, items = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        rows = max(1, SHARD_ENTRIES // max(1, len(weight)))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = pa.Table.from_batches([batch.slice(at, rows)]).combine_chunks()
                term, tf = (part.column(c).combine_chunks() for c in ("terms", "tfs"))
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(term).to_numpy())])
                term, tf = (x.flatten().to_numpy().astype(np.int64) for x in (term, tf))
                shard = Shard(part.column("doc_id").to_numpy(), part.column("n").to_numpy(), ends, term, tf, weight, n_docs, n_terms)
                best = [shard.search(*item, k, own) for item, own in zip(items, best)]
        query = np.repeat(np.arange(len(items)), [len(s) for s, _ in best])
        scores, ids = (np.concatenate([b[i] for b in best]) if best else np.zeros(0, np.int64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(ids), pa.array(scores)], ["query", "doc_id", "score"])

    # a document without an id counts, but can't be returned
    return index.filter(F.col("doc_id").isNotNull()).mapInArrow(run, "query int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` highest-scoring documents of each item with a score above 0.

    Terms are letters, digits and non-ASCII characters, A to Z lower-cased.
    Equal scores go by ascending doc_id.  A null or blank text is no document
    and no item.  Documents of a null doc_id count in the statistics and are
    never returned; repeated rows are documents each.  Items of a null id take
    no part; rows of one item_id are one item, that of the smallest text.  An
    item none of whose terms occurs has no row; empty tables give none.  Other
    columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()
    blocks = max(1, math.ceil((asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BLOCK_BYTES))
    found = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        queries = Queries([r.item_id for r in rows], [r.text for r in rows])
        part = _search_block(cut(forward_index(own, queries)), queries, k)
        names = spark.createDataFrame([(i, item) for i, (item, _, _) in enumerate(queries.items)], f"query int, item_id {kind}")
        part = part.join(F.broadcast(names), "query").select("item_id", "doc_id", "score")
        found = part if found is None else found.union(part)
    best = [F.desc("score"), F.asc("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(W.partitionBy("item_id", "salt").orderBy(*best))).filter(F.col("rank") <= k)
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*best))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
