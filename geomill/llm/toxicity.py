"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts.

Under class c the word w after the word h has the likelihood

    P(w | h, c) = P(w | h) P(c | h, w) / P(c | h)

P(w | h), which both classes share, cancels where they are compared.  The
shares P(c | h, w) are Kneser-Ney: discounted counts of the bigram (h, w) for
each class, and what the discounts leave goes to the share that its words
predict; likewise those of w alone, where the rest goes to the first 7, 6, 5
and 4 letters of w and at last to the classes' overall shares.  As in
Kneser-Ney smoothing an expression counts once for each distinct history, the
``HISTORY`` words that it follows, so the copies of a document count once.
Backoff counts are of both classes together, and an expression whose own
counts don't differ by more than chance from what the shorter ones predict
takes their prediction: rare expressions weigh the same on both sides.

A document's two log-likelihoods are divided by the same power of its length
and compared; a logistic curve of that one difference, fitted on labelled
documents kept out of the counts, turns it into a score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.llm import charlm, sampling
from geomill.session import bound_batches, cut

HISTORY = 3
#: Letters of the shorter expressions of a word, each one more than the last.
PREFIXES = (4, 5, 6, 7)
DISCOUNT, STRENGTH = 0.75, 10.0
#: Standard deviations beyond which an expression's counts are its own, and places below which they can't be.
BEYOND, PLACES = 5.0, 6
#: Steps into which calibration rounds a document's evidence, between the least and the largest.
CALIBRATION_STEPS = 4096
#: Powers of the length that log-likelihoods are divided by, of which calibration takes the best.
LENGTH_POWERS = (0.25, 0.5, 0.75, 1.0)
#: Labelled ids up to which they are broadcast to the scan of the texts.
BROADCAST_IDS = 4_000_000
#: Words that a task counts together, the share of a task's words from which a word is common, and the parts that those are dealt into.
WINDOW, COMMON, PARTS = 1 << 21, 1e-3, 64
_A = np.uint64(0x9E3779B97F4A7C15)


def _key(expression: str) -> int:
    return xxhash.xxh64_intdigest(expression.encode("utf-8", "replace"), 42)


def _word_keys(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest((w + "$").encode("utf-8", "replace"), 42) for w in words], np.uint64, len(words))


def _before(keys: np.ndarray) -> np.ndarray:
    """The 31 bits that stand for a word as the history of a bigram."""
    return keys >> np.uint64(33)


def _pair(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    x = (word ^ (before + np.uint64(1)) * _A) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _mixed(counts: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The toxic share of expressions with ``counts`` (ordinary, toxic) of which shorter ones predict ``q``."""
    total = counts.sum(1)
    differs = np.abs(counts[:, 1] - total * q) > BEYOND * np.sqrt(total * q * (1 - q) + 1)
    kept = np.maximum(counts - DISCOUNT, 0)
    return np.where(differs, (kept[:, 1] + (total - kept.sum(1) + STRENGTH) * q) / (total + STRENGTH), q)


class _Counts:
    """Sorted 64-bit keys with their counts in the ordinary and the toxic class."""

    def __init__(self, table: pa.Table):
        keys = table.column("h").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.counts = np.zeros((len(keys) + 1, 2), np.float32)
        self.counts[:-1] = np.column_stack([table.column("ordinary").to_numpy(), table.column("toxic").to_numpy()])[order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, the last (of no counts) for others."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[i] == keys, i, len(self.keys))


class Words:
    """Toxic shares of single words, backed off over their first letters."""

    def __init__(self, table: pa.Table, share: float):
        self.table, self.share = _Counts(table), share

    def shares(self, words: list[str], known: dict[str, float] | None = None) -> np.ndarray:
        """The share of each of ``words``; ``known`` keeps those of first letters, which many words have in common."""
        known = {} if known is None else known
        stems = [w[: min(PREFIXES[-1], len(w) - 1)] for w in words]
        new = {s for s in stems if len(s) >= PREFIXES[0]}.difference(known)
        for n in PREFIXES:
            own = list({s[:n] for s in new if len(s) >= n}.difference(known))
            if own:
                before = np.array([known.get(s[:-1], self.share) for s in own])
                keys = np.fromiter(map(_key, own), np.uint64, len(own))
                known.update(zip(own, _mixed(self.table.counts[self.table.find(keys)], before).tolist()))
        toxic = np.array([known.get(s, self.share) for s in stems], float)
        return _mixed(self.table.counts[self.table.find(_word_keys(words))], toxic)

    def histories(self, before: np.ndarray) -> np.ndarray:
        """Toxic shares after the histories ``before``: those of the words by their own counts."""
        keys = self.table.keys
        i = np.minimum(np.searchsorted(keys, before << np.uint64(33)), max(0, len(keys) - 1))
        there = _before(keys[i]) == before if len(keys) else np.zeros(len(before), bool)
        counts = self.table.counts[np.where(there, i, len(keys))]
        return _mixed(counts, np.full(len(before), self.share))


def predicted_share(word: np.ndarray, history: np.ndarray, share: float) -> np.ndarray:
    """Toxic share of a bigram whose words have the shares ``word`` and ``history`` and no bearing on each other."""
    odds = word / (1 - word) * history / (1 - history) * (1 - share) / share
    return np.clip(odds / (1 + odds), 1e-6, 1 - 1e-6)


@dataclass
class Model:
    """Word shares, and the bigrams whose counts differ from what their words predict, with their toxic share."""

    words: Words
    pairs: _Counts
    pair_words: np.ndarray  # sorted keys of the words that end a bigram


class Scorer:
    """Sums of log P(w | h, c) / P(w | h) over whole texts; each distinct chunk between white space is split once."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[str, int] = {}  # chunks, the words of which are self.words[starts:][:sizes]
        self.words, self.starts, self.sizes = (np.empty(0, np.int64) for _ in range(3))
        self.index: dict[str, int] = {"\n": -1}
        self.prefixes: dict[str, float] = {}
        self.keys, self.shares, self.logs, self.ends_pair = np.empty(0, np.uint64), np.empty(0), np.empty((0, 2)), np.empty(0, bool)

    def _learn(self, chunks: list[str]) -> None:
        runs = charlm.letter_runs_of(chunks)
        new = list(set(runs).difference(self.index))
        if new:
            self.index.update(zip(new, range(len(self.keys), len(self.keys) + len(new))))
            keys, known, share = _word_keys(new), self.model.pair_words, self.model.words.share
            ends = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)
            q = self.model.words.shares(new, self.prefixes)
            self.keys, self.ends_pair = np.concatenate([self.keys, keys]), np.concatenate([self.ends_pair, ends])
            self.shares = np.concatenate([self.shares, q])
            self.logs = np.concatenate([self.logs, np.column_stack([np.log((1 - q) / (1 - share)), np.log(q / share)])])
        found = np.fromiter(map(self.index.__getitem__, runs), np.int64, len(runs))
        sizes = np.diff(np.flatnonzero(found < 0), prepend=-1) - 1
        self.memo.update(zip(chunks, range(len(self.sizes), len(self.sizes) + len(chunks))))
        self.starts = np.concatenate([self.starts, len(self.words) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.words = np.concatenate([self.words, found[found >= 0]])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """One row a text: ordinary and toxic log-likelihood against the shared model, and words."""
        out, share = np.zeros((len(texts), 3)), self.model.words.share
        for lo in range(0, len(texts), 200):
            split = [(t or "").split() for t in texts[lo : lo + 200]]
            new = set().union(*split).difference(self.memo)
            if len(self.memo) + len(new) > charlm.MEMO:
                self._reset()
                new = set().union(*split)
            if new:
                self._learn(list(new))
            many = np.array([len(s) for s in split])
            chunk = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(split)), np.int64, int(many.sum()))
            each = self.sizes[chunk]
            sizes = np.bincount(np.repeat(np.arange(len(split)), many), each, len(split)).astype(np.int64)
            full = np.flatnonzero(sizes)
            if not len(full):
                continue
            words = self.words[np.repeat(self.starts[chunk] - np.cumsum(each) + each, each) + np.arange(sizes.sum())]
            starts = (np.cumsum(sizes) - sizes)[full]
            q, logs = self.shares[words], self.logs[words]
            inner = self.ends_pair[words]
            inner[starts] = False
            at = np.flatnonzero(inner)
            if len(at):
                before = _before(self.keys[words[at - 1]])
                found = self.model.pairs.find(_pair(self.keys[words[at]], before))
                hit = found < len(self.model.pairs.keys)
                at, before = at[hit], before[hit]
                history = self.model.words.histories(before)
                both = _mixed(self.model.pairs.counts[found[hit]], predicted_share(q[at], history, share))
                logs[at] = np.column_stack([np.log((1 - both) / (1 - history)), np.log(both / history)])
            out[lo + full, :2] = np.add.reduceat(logs, starts, axis=0)
            out[lo + full, 2] = sizes[full]
        return out


@dataclass
class Detector:
    """A model, the power of the length and the curve (constant, slope)."""

    model: Model
    power: float
    curve: tuple[float, float]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> tuple[float, float, float]:
    """Constant, slope and mean log loss of a ridge logistic regression on one feature, by damped Newton steps."""
    mean = np.average(x, weights=weight)
    scale = np.sqrt(np.average((x - mean) ** 2, weights=weight)) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    b = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (p - y)) + ridge * b
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        b -= step / max(1.0, np.abs(step).max())
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ b, -30, 30))), 1e-9, 1 - 1e-9)
    loss = -(weight * np.where(y == 1, np.log(p), np.log(1 - p))).sum() / weight.sum()
    return float(b[0] - b[1] * mean / scale), float(b[1] / scale), float(loss)


def common_words(rows: DataFrame) -> set[str]:
    """Words that make up ``COMMON`` of the words of some task of ``rows`` (text) or more: all that make up that share of the whole, and no more than 1 / ``COMMON`` a task."""

    def run(batches):
        counts: Counter = Counter()
        seen = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                split = (text or "").split()
                counts.update(split)
                seen += len(split)
            if len(counts) > charlm.MEMO:
                counts = Counter({c: n for c, n in counts.items() if n > COMMON / 8 * seen})
        words: Counter = Counter()
        for c, n in counts.items():
            if n > COMMON / 8 * seen:
                for w in charlm.letter_runs(c):
                    words[w] += n
        yield pa.RecordBatch.from_arrays([pa.array([w for w, n in words.items() if n >= COMMON / 2 * seen], pa.string())], ["word"])

    return {r.word for r in rows.select("text").mapInArrow(run, "word string").distinct().collect()}


def count_bigrams(rows: DataFrame) -> DataFrame:
    """(word, before, ordinary, toxic): in how many distinct places each bigram of ``rows`` (k, text) stands, by class k.

    ``before`` stands for the word before (-1: none); a place is a 30-bit hash
    of the ``HISTORY`` words before.  A row that travels holds all places of a
    word in a window, so that the word is sent once; those of common words are
    dealt into parts by the word before.
    """
    common = common_words(rows)

    def places(batches):
        chunks: dict[str, tuple[int, ...]] = {}  # the words of each chunk between white space, by their place in names
        names: dict[str, int] = {}
        held: list[tuple[int, np.ndarray]] = []

        def flush():
            if not held:
                return
            words, index = list(names), np.concatenate([run for _, run in held])
            keys, often = _word_keys(words), np.fromiter((w in common for w in words), bool, len(words))
            sizes = np.array([len(run) for _, run in held])
            at = np.arange(len(index)) + HISTORY * (1 + np.repeat(np.arange(len(held)), sizes))
            padded = np.zeros(len(index) + HISTORY * len(held), np.uint64)
            padded[at] = keys[index]
            place = np.zeros(len(index), np.uint64)
            for d in range(HISTORY):
                place = _pair(place, padded[at - 1 - d] >> np.uint64(1))
            before = _before(padded[at - 1]).astype(np.int64)
            before[np.cumsum(sizes) - sizes] = -1
            place = (place >> np.uint64(34)).astype(np.int64) << 1 | np.repeat([k for k, _ in held], sizes)
            part = np.where(often[index], before % PARTS, 0)
            group = index << 40 | part << 32 | before + 1
            order = np.lexsort((place, group))
            group, before, place = group[order], before[order].astype(np.int32), place[order].astype(np.int32)
            new = np.concatenate(([True], (group[1:] != group[:-1]) | (place[1:] != place[:-1])))
            group, before, place = group[new] >> 32, before[new], place[new]
            starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            ends = np.append(starts, len(group))
            for lo in range(0, len(starts), 20_000):
                own = ends[lo : lo + 20_001]
                lists = [pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), pa.array(x[own[0] : own[-1]])) for x in (before, place)]
                first = group[own[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in (first >> 8).tolist()], pa.string()), pa.array((first & 255).astype(np.int32)), *lists], ["word", "part", "before", "place"])
            held.clear()

        size = 0
        for batch in batches:
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist()):
                split = (text or "").split()
                new = set(split).difference(chunks)
                if size >= WINDOW or len(chunks) + len(new) > charlm.MEMO:
                    yield from flush()
                    chunks.clear()
                    names.clear()
                    size, new = 0, set(split)
                for c in new:
                    chunks[c] = tuple(names.setdefault(w, len(names)) for w in charlm.letter_runs(c))
                run = np.fromiter(chain.from_iterable(map(chunks.__getitem__, split)), np.int64)
                if len(run):
                    held.append((k, run))
                    size += len(run)
        yield from flush()

    # one exchange serves both aggregations
    sent = rows.select("k", "text").mapInArrow(places, "word string, part int, before array<int>, place array<int>").repartition("word", "part")
    distinct = sent.select("word", "part", F.explode(F.arrays_zip("before", "place")).alias("e")).select("word", "part", "e.before", "e.place").distinct()
    toxic = F.col("place") % 2
    return distinct.groupBy("word", "part", "before").agg(F.sum(1 - toxic).alias("ordinary"), F.sum(toxic).alias("toxic")).drop("part")


def rare_joined(bigrams: DataFrame) -> DataFrame:
    """``bigrams``, those of a word that stand in fewer than ``PLACES`` places as one row without a word before: no pair can be made of them, and the word's sums stay."""
    pair = F.when(F.col("ordinary") + F.col("toxic") >= PLACES, F.col("before")).otherwise(-1)
    return bigrams.groupBy("word", pair.alias("before")).agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def count_words(bigrams: DataFrame) -> DataFrame:
    """(h, ordinary, toxic) of the words in ``bigrams`` and of their first letters, of ``PLACES`` or more."""

    def hashed(batches):
        for batch in batches:
            h = np.fromiter(map(_key, batch.column("e").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("ordinary"), batch.column("toxic")], ["h", "ordinary", "toxic"])

    words = bigrams.groupBy("word").agg(F.sum("ordinary").alias("o"), F.sum("toxic").alias("t"))
    shorter = [F.when(F.length("word") > n, F.substring("word", 1, n)) for n in PREFIXES]
    each = words.select(F.explode(F.array_compact(F.array(*shorter, F.concat("word", F.lit("$"))))).alias("e"), "o", "t")
    found = each.groupBy("e").agg(F.sum("o").alias("ordinary"), F.sum("t").alias("toxic")).filter(F.col("ordinary") + F.col("toxic") >= PLACES)
    return found.mapInArrow(hashed, "h long, ordinary long, toxic long")


def differing_pairs(bigrams: DataFrame, words: Words) -> DataFrame:
    """(h, word, ordinary, toxic, z) of the bigrams that differ by more than chance, ``z`` deviations, from what their words predict."""
    shared = bigrams.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        model = shared.value
        for batch in batches:
            before = batch.column("before").to_numpy().astype(np.int64).view(np.uint64)
            names = batch.column("word").to_pylist()
            counts = np.column_stack([batch.column("ordinary").to_numpy(), batch.column("toxic").to_numpy()]).astype(float)
            q = predicted_share(model.shares(names), model.histories(before), model.share)
            total = counts.sum(1)
            z = np.abs(counts[:, 1] - total * q) / np.sqrt(total * q * (1 - q) + 1)
            keep = np.flatnonzero(z > BEYOND)
            keys = _word_keys([names[i] for i in keep])
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (_pair(keys, before[keep]), keys)), *(pa.array(counts[keep, i].astype(np.int64)) for i in (0, 1)), pa.array(z[keep])], ["h", "word", "ordinary", "toxic", "z"])

    enough = bigrams.filter((F.col("ordinary") + F.col("toxic") >= PLACES) & (F.col("before") >= 0))
    return enough.mapInArrow(run, "h long, word long, ordinary long, toxic long, z double")


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of ``docs`` other than ``text``, and ``logs`` (ordinary and toxic log-likelihood of the whole text, words)."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != text]

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            got = scorer(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(got.tolist(), pa.list_(pa.float64()))], [*rest, "logs"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text), "logs array<double>"])
    return docs.mapInArrow(run, schema)


def calibration_points(scored: DataFrame) -> list:
    """(power, k, x, n): for each of ``LENGTH_POWERS`` the documents ``scored`` (k, logs) of each class, all of them counted by steps of their evidence x; as many rows as steps, whatever the documents."""
    n = F.greatest(F.col("logs")[2], F.lit(1.0))
    each = F.array(*[F.struct(F.lit(i).alias("power"), ((F.col("logs")[1] - F.col("logs")[0]) / F.pow(n, F.lit(p))).alias("x")) for i, p in enumerate(LENGTH_POWERS)])
    rows = cut(scored.select("k", F.explode(each).alias("e")).select("k", "e.*"))
    span = rows.groupBy("power").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    step = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CALIBRATION_STEPS)).otherwise(0)
    return rows.join(F.broadcast(span), "power").groupBy("power", "k", step.alias("step")).agg(F.avg("x").alias("x"), F.count("*").alias("n")).orderBy("power", "k", "step").collect()  # span: a row a power


def train(docs: DataFrame, labels: DataFrame, max_expressions: int = 4_000_000) -> Detector | None:
    """Learns from ``labels`` (doc_id, toxic in 0, 1) of ``docs``; None unless both classes are there.

    A fifth of the labelled documents is kept out of the counts, and the curve
    is fitted on all of that fifth; all others are counted.  Of several labels of a document the largest holds.  The model keeps the
    words and the bigrams that differ; more than ``max_expressions`` of either
    raise ValueError, as a smaller model would pass over some.
    """
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("k"))
    known = known.withColumn("held", sampling.is_calibration("doc_id"))
    there = {(r.held, r.k): r["count"] for r in known.groupBy("held", "k").count().collect()}  # four rows
    if len(there) < 4:
        return None
    known = F.broadcast(known) if sum(there.values()) <= BROADCAST_IDS else known
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    bound_batches(docs.sparkSession)
    labelled = text.join(known, "doc_id")
    bigrams = cut(rare_joined(count_bigrams(labelled.filter("NOT held")).filter("ordinary + toxic > 0")))
    found = cut(count_words(bigrams))
    sums = bigrams.agg(F.sum("ordinary"), F.sum("toxic")).first()
    if not sums[0] or not sums[1]:
        return None
    share = sums[1] / (sums[0] + sums[1])
    total = F.col("ordinary") + F.col("toxic")
    evidence = F.abs(F.col("toxic") - total * share) / F.sqrt(total * share * (1 - share) + 1)
    if found.count() > max_expressions:
        raise ValueError(f"more than {max_expressions} words are to be kept; raise max_expressions")
    words = Words(found.orderBy(evidence.desc(), "h").toArrow(), share)
    pairs = cut(differing_pairs(bigrams, words))
    if pairs.count() > max_expressions:
        raise ValueError(f"more than {max_expressions} bigrams are to be kept; raise max_expressions")
    best = pairs.orderBy(F.desc("z"), "h").toArrow()
    model = Model(words, _Counts(best), np.unique(best.column("word").to_numpy().view(np.uint64)))
    points = calibration_points(score_texts(labelled.filter("held").select("k", "text"), model))
    if len({r.k for r in points}) < 2:
        return None
    fits = []
    for i, p in enumerate(LENGTH_POWERS):
        x, y, n = (np.array([r[c] for r in points if r.power == i], float) for c in ("x", "k", "n"))
        fits.append((_logistic(x, y, n), p))
    (constant, slope, _), power = min(fits, key=lambda f: f[0][2])
    return Detector(model, power, (constant, slope))


def score(docs: DataFrame, detector: Detector | None) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on) and llr (difference of the length-normalised log-likelihoods), one row per document.

    Null, empty and letterless texts have llr 0 and the score of a text
    without evidence; without a detector every score is 0.  Texts are read
    whole; repeated rows and null ids keep a row each; an empty table gives no
    rows; label, lang and source columns are never read.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return score_rows(own, detector).select("doc_id", "score", "predicted", "llr")


def score_rows(docs: DataFrame, detector: Detector | None, text: str = "text") -> DataFrame:
    """The columns of ``docs`` other than ``text`` with score, predicted and llr, which replace columns of those names; cases as in ``score``."""
    rest = [c for c in docs.columns if c not in ("score", "predicted", "llr", "logs", text)]
    own = docs.select(*rest, F.col(text).cast("string").alias("logs"))  # a name that no other column has
    if detector is None:
        return own.select(*rest, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0.0).alias("llr"))
    d, n = F.col("logs")[1] - F.col("logs")[0], F.greatest(F.col("logs")[2], F.lit(1.0))
    llr: Column = d / F.pow(n, F.lit(detector.power))
    scored = score_texts(own, detector.model, "logs").withColumn("llr", llr)
    scored = scored.withColumn("score", 1 / (1 + F.exp(-(F.lit(detector.curve[0]) + F.lit(detector.curve[1]) * F.col("llr")))))
    return scored.select(*rest, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "llr")
