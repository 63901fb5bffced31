"""Temperature mixing of sources, realised as permuted passes cut into blocks.

A source with the token share p gets a weight in proportion to p ** exponent:
1 keeps the natural shares, 0 makes them equal.  The exponent is bisected, 32
intervals at a time in one aggregation over the sources' totals, to the
largest that reaches the target entropy, or else the smallest that keeps every
source's repeats within the limit.

The budget makes the least repeated source, unless one is given, pass exactly
once.  A source then runs through as many whole permutations of its documents
as its repeats hold, and through the beginning of one more.  Permutations are
the order of a seeded hash of the document for each pass, so a document's part
in the mix follows from its source's row of the plan, without a shuffle of the
texts; only slim rows are summed for the cut-off and for the blocks, by a
prefix scan in two levels, buckets of the hash and then rows of a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geomill.session import cut

#: Buckets of a permutation, as a power of two.
BUCKET_BITS = 12
#: Intervals that one round of the bisection tells apart, and rounds.
INTERVALS, ROUNDS = 32, 6
#: Sources up to which the plan is broadcast.
BROADCAST_SOURCES = 20_000


def word_count(text: str = "text") -> Column:
    """Words, runs of characters that aren't ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: str) -> Column:
    """A text that tells null from every source."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))


def _draw(key: Column, turn: Column, seed: int) -> Column:
    """Place of a row in the permutation of one pass."""
    return F.xxhash64(F.lit(seed), turn.cast("int"), key)


def _bucket(draw: Column) -> Column:
    return F.shiftright(draw, 64 - BUCKET_BITS).cast("int")


def bisect_exponent(totals: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: int | None) -> float:
    """The exponent in 0 to 1 for ``totals`` (n: tokens of a source); see ``plan``."""
    head = totals.filter("n > 0").agg(F.sum("n"), F.min("n"), F.max("n"), F.count("*")).first()
    if not head[3]:
        return 1.0
    whole, least, most, many = float(head[0]), float(head[1]), float(head[2]), head[3]
    p = F.col("n") / whole

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        got = totals.filter("n > 0").agg(*[F.sum(F.pow(p, F.lit(a))) for a in exponents], *[F.sum(F.pow(p, F.lit(a)) * F.log(p)) for a in exponents]).first()
        return list(zip(got[: len(exponents)], got[len(exponents) :]))

    def entropy_reached(a: float, z: float, s: float) -> bool:
        import math

        return math.log(z) - a * s / z >= target_entropy * math.log(many) - 1e-12

    def repeats_kept(a: float, z: float, _: float) -> bool:
        weight = (least / whole) ** a / z
        tokens = budget if budget is not None else most * z / (most / whole) ** a
        return weight * tokens / least <= max_repeats + 1e-12

    def edge(holds, at_low: bool) -> float:
        """Where a condition that holds on one side of 0 to 1 turns."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [lo + (hi - lo) * i / INTERVALS for i in range(INTERVALS + 1)]
            true = [holds(a, *zs) for a, zs in zip(grid, sums(grid))]
            if at_low:
                last = max((i for i, t in enumerate(true) if t), default=0)
                lo, hi = grid[last], grid[min(last + 1, INTERVALS)]
            else:
                first = min((i for i, t in enumerate(true) if t), default=INTERVALS)
                lo, hi = grid[max(first - 1, 0)], grid[first]
        return lo if at_low else hi

    wanted = 0.0 if target_entropy is None else edge(entropy_reached, True)
    return max(wanted, 0.0 if max_repeats is None else edge(repeats_kept, False))


def plan(slim: DataFrame, target_entropy: float | None = 0.95, max_repeats: float | None = 2.0, budget: int | None = None, seed: int = 41) -> DataFrame:
    """One row a source of ``slim`` (key, row_key, n_tokens): key, n, weight, repeats, turns (whole passes), cutoff, exponent.

    ``target_entropy`` is a share of the entropy of equal weights.  The first
    ``quota`` tokens of one more pass end at ``cutoff`` (null: no more pass).
    """
    totals = cut(slim.groupBy("key").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("n_docs")))
    exponent = bisect_exponent(totals, target_entropy, max_repeats, budget)
    head = totals.filter("n > 0").agg(F.sum("n"), F.max("n")).first()
    whole, most = float(head[0] or 1), float(head[1] or 1)
    z = totals.filter("n > 0").agg(F.sum(F.pow(F.col("n") / whole, F.lit(exponent)))).first()[0] or 1.0
    tokens = float(budget) if budget is not None else most * z / (most / whole) ** exponent
    weight = F.when(F.col("n") > 0, F.pow(F.col("n") / whole, F.lit(exponent)) / z).otherwise(0.0)
    wanted = F.when(F.col("n") > 0, F.round(F.col("weight") * tokens).cast("long")).otherwise(0)
    turns = F.when(F.col("n") > 0, F.floor(F.col("wanted") / F.col("n"))).otherwise(1).cast("int")
    planned = totals.withColumn("weight", weight).withColumn("wanted", wanted).withColumn("turns", turns)
    planned = cut(planned.withColumn("quota", F.col("wanted") - F.col("turns") * F.col("n")).withColumn("exponent", F.lit(exponent)))

    last = _small(planned.filter("quota > 0").select("key", "turns", "quota"), planned)
    drawn = slim.join(last, "key").withColumn("draw", _draw(F.col("row_key"), F.col("turns"), seed)).withColumn("bucket", _bucket(F.col("draw")))
    buckets = drawn.groupBy("key", "bucket").agg(F.sum("n_tokens").alias("t"), F.first("quota").alias("quota"))
    cum = buckets.withColumn("before", F.sum("t").over(W.partitionBy("key").orderBy("bucket")) - F.col("t"))
    at = cum.groupBy("key").agg(F.max_by(F.struct("bucket", "before"), F.when(F.col("before") < F.col("quota"), F.col("bucket"))).alias("edge"))
    edge = _small(at.select("key", F.col("edge.bucket").alias("bucket"), F.col("edge.before").alias("before")), planned)
    order = W.partitionBy("key").orderBy("draw").rangeBetween(W.unboundedPreceding, 0)
    inside = drawn.join(edge, ["key", "bucket"]).withColumn("sum", F.col("before") + F.sum("n_tokens").over(order))
    found = inside.filter("sum <= quota").groupBy("key").agg(F.max("draw").alias("found"))
    low = F.shiftleft(F.col("bucket").cast("long"), 64 - BUCKET_BITS) - 1
    first_bucket = -(1 << (BUCKET_BITS - 1))
    ends = edge.join(found, "key", "left").select("key", F.coalesce("found", F.when(F.col("bucket") > first_bucket, low)).alias("cutoff"))
    return cut(planned.join(ends, "key", "left").select("key", "n", "n_docs", "weight", (F.col("wanted") / F.greatest(F.col("n"), F.lit(1))).alias("repeats"), "turns", "cutoff", "exponent"))


def _small(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``rows``, one a source at most: broadcast where the sources are counted to be few."""
    return F.broadcast(rows) if planned.count() <= BROADCAST_SOURCES else rows


def _slim(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(_doc: the columns of ``docs``, whatever their names, as a struct, _key, _row, _n)."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), _key(source).alias("_key"), F.xxhash64(F.col(doc_id), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("_row"), word_count(text).alias("_n"))


def mix(docs: DataFrame, target_entropy: float | None = 0.95, max_repeats: float | None = 2.0, budget: int | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 41) -> DataFrame:
    """The columns of ``docs`` and ``turn``, one row for each pass that a row of ``docs`` is in.

    Turns count from 0.  Without a budget every row is in turn 0.  Null is a
    source of its own; documents without words count no tokens and are in every
    whole pass of their source, once if the source has no words at all; rows
    repeated in full are in or out together; an empty table gives no rows;
    columns of any other name are kept, and a column ``turn`` is replaced.
    """
    own = _slim(docs, doc_id, text, source)
    planned = plan(cut(own.select(F.col("_key").alias("key"), F.col("_row").alias("row_key"), F.col("_n").alias("n_tokens"))), target_entropy, max_repeats, budget, seed)
    few = _small(planned.select(F.col("key").alias("_key"), F.col("turns").alias("_turns"), F.col("cutoff").alias("_cutoff")), planned)
    more = F.coalesce((_draw(F.col("_row"), F.col("_turns"), seed) <= F.col("_cutoff")).cast("int"), F.lit(0))
    last = F.col("_turns") + more - 1
    return own.join(few, "_key").filter(last >= 0).select(*(F.col("_doc").getField(c).alias(c) for c in docs.columns if c != "turn"), F.explode(F.sequence(F.lit(0), last)).alias("turn"))


def mix_order(docs: DataFrame, block_tokens: int = 1 << 20, target_entropy: float | None = 0.95, max_repeats: float | None = 2.0, budget: int | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 41) -> DataFrame:
    """doc_id, source, n_tokens, turn, block, place, weight, exponent: the order of the mix, without texts.

    Every block of about ``block_tokens`` holds each source in its weight;
    ``place`` is a hash that orders a block's rows.  A reader takes rows by
    (block, place).  Cases are those of ``mix``.
    """
    own = cut(_slim(docs, doc_id, text, source).select(F.col("_doc").getField(doc_id).alias("doc_id"), F.col("_doc").getField(source).alias("source"), "_key", "_row", "_n"))
    planned = plan(own.select(F.col("_key").alias("key"), F.col("_row").alias("row_key"), F.col("_n").alias("n_tokens")), target_entropy, max_repeats, budget, seed)
    few = _small(planned.select(F.col("key").alias("_key"), "turns", "cutoff", "weight", "exponent", F.col("n").alias("total")), planned)
    more = F.coalesce((_draw(F.col("_row"), F.col("turns"), seed) <= F.col("cutoff")).cast("int"), F.lit(0))
    last = F.col("turns") + more - 1
    rows = own.join(few, "_key").filter(last >= 0).withColumn("turn", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.withColumn("draw", _draw(F.col("_row"), F.col("turn"), seed)).withColumn("bucket", _bucket(F.col("draw")))
    sums = rows.groupBy("_key", "turn", "bucket").agg(F.sum("_n").alias("t"))
    offsets = sums.select("_key", "turn", "bucket", (F.sum("t").over(W.partitionBy("_key", "turn").orderBy("bucket")) - F.col("t")).alias("before"))
    inner = F.sum("_n").over(W.partitionBy("_key", "turn", "bucket").orderBy("draw", "doc_id").rowsBetween(W.unboundedPreceding, -1))
    placed = rows.withColumn("inner", F.coalesce(inner, F.lit(0))).join(offsets, ["_key", "turn", "bucket"])
    position = F.col("turn") * F.col("total") + F.col("before") + F.col("inner")
    block = F.when(F.col("weight") > 0, F.floor(position / (F.col("weight") * block_tokens))).otherwise(0).cast("long")
    return placed.select("doc_id", "source", F.col("_n").alias("n_tokens"), "turn", block.alias("block"), F.xxhash64(F.lit(seed), "draw", "turn").alias("place"), "weight", "exponent")
