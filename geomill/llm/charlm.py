"""Interpolated Kneser-Ney models over the characters of words, one per class.

Words are maximal runs of letters, lower-cased, with a mark at either end;
histories stop at the word's start, so a text's log-likelihood is the sum over
its words and a worker computes each distinct word once.  A model is one
sorted array of 64-bit string hashes with, for each class, the discounted
share of the string's last character after the rest (``alpha``) and the weight
that the string, as a history, leaves to the shorter one (``gamma``).

Counts come from Spark aggregations over all rows given.  Of strings of three
characters or more those seen once in a class are discounted in full, and
those with less than ``LEAST_SHARE`` of their class's strings are left to the
shorter ones, so what reaches the driver is bounded by 1 / ``LEAST_SHARE``
strings for each length and class.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.session import cut

DISCOUNT = 0.75
#: Share of its class's strings of one length below which a string is left out.
LEAST_SHARE = 3e-7
#: Distinct words whose scores a worker keeps.
MEMO = 300_000
_LETTERS = re.compile(r"[^\W\d_]+")
_LETTERS_OR_ENDS = re.compile(r"[^\W\d_]+|\n")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: The uniform share of a character below all counts.
FLOOR = 1.0 / 512


def letter_runs(chunk: str) -> list[str]:
    """The maximal runs of letters of ``chunk``, lower-cased; numerals such as fractions and superscripts are no letters."""
    runs = _LETTERS.findall(chunk.lower())
    if chunk.isascii() or all(map(str.isalpha, runs)):
        return runs
    return [w for r in runs for w in "".join(c if c.isalpha() else " " for c in r).split()]


def letter_runs_of(chunks: list[str]) -> list[str]:
    """What ``letter_runs`` finds in each of ``chunks``, which hold no line feed, and a line feed after each."""
    runs = _LETTERS_OR_ENDS.findall("\n".join([*chunks, ""]).lower())
    if len("".join(runs)) == len(chunks) + sum(map(len, filter(str.isalpha, runs))):
        return runs
    return [w for c in chunks for w in (*letter_runs(c), "\n")]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _hashes(words: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(word of each position, string hashes by length, position in the word, is a start) of ' word ' laid end to end."""
    flat = "".join(f" {w} " for w in words)
    cp = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(cp)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    h = [np.zeros(len(cp), np.uint64)]
    for n in range(1, order + 1):
        c = np.zeros(len(cp), np.uint64)
        c[n - 1 :] = cp[: len(cp) - n + 1]
        h.append(_mix(h[-1] * _A + c + np.uint64(1)))
    return word, h, at, at == 0


def _grams(words: list[str], counts: np.ndarray, orders: range) -> list[tuple]:
    """(order, hash, history, suffix, begins a word, count) of the strings of ``words``."""
    word, h, at, _ = _hashes(words, orders.stop - 1)
    out = []
    for n in orders:
        ok = np.flatnonzero((at >= n - 1) & (at >= 1))
        g, first, inverse = np.unique(h[n][ok], return_index=True, return_inverse=True)
        ok_first = ok[first]
        total = np.bincount(inverse, counts[word[ok]], len(g)).astype(np.int64)
        out.append((n, g, h[n - 1][ok_first - 1], h[n - 1][ok_first], at[ok_first] == n - 1, total))
    return out


def count_strings(rows: DataFrame, orders: range) -> DataFrame:
    """(k, n, h, history, suffix, starts, c): counts of strings of the words of ``rows`` (k, text) for each class k.

    A partition adds up its words first and sends each of its distinct strings
    once.
    """

    def run(batches):
        words: dict[int, Counter] = {}

        def flush():
            for k, own in words.items():
                runs: Counter = Counter()
                for chunk, c in own.items():
                    for w in letter_runs(chunk):
                        runs[w] += c
                if runs:
                    for n, g, ctx, suf, starts, c in _grams(list(runs), np.fromiter(runs.values(), np.float64, len(runs)), orders):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int32)), pa.array(np.full(len(g), n, np.int32)), *(pa.array(x.view(np.int64)) for x in (g, ctx, suf)), pa.array(starts), pa.array(c)], ["k", "n", "h", "history", "suffix", "starts", "c"])

        for batch in batches:
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist()):
                words.setdefault(k, Counter()).update((text or "").split())
            if sum(map(len, words.values())) > 2 * MEMO:
                yield from flush()
                words.clear()
        yield from flush()

    found = rows.select(F.col("k").cast("int").alias("k"), "text").mapInArrow(run, "k int, n int, h long, history long, suffix long, starts boolean, c long")
    return found.groupBy("k", "n", "h", "history", "suffix", "starts").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """(k, n, h, history, alpha): discounted shares, shorter strings by the number of their distinct left neighbours.

    Strings that begin a word have no left neighbour and keep their counts.
    Counts of 1 of strings of three characters or more are discounted in full
    and left out, as are strings below ``LEAST_SHARE``.
    """
    kinds = counts.groupBy("k", (F.col("n") - 1).alias("n"), F.col("suffix").alias("h")).agg(F.count("*").alias("left"))
    c = counts.join(kinds, ["k", "n", "h"], "left").select("k", "n", "h", "history", F.when((F.col("n") == order) | F.col("starts"), F.col("c")).otherwise(F.coalesce("left", "c")).cast("double").alias("c"))
    total = c.groupBy("k", "n", "history").agg(F.sum("c").alias("t"))
    whole = c.groupBy("k", "n").agg(F.sum("c").alias("all"))  # one row a class and length
    kept = c.join(F.broadcast(whole), ["k", "n"]).filter(((F.col("c") > 1) & (F.col("c") >= F.col("all") * LEAST_SHARE)) | (F.col("n") < 3)).drop("all")
    return kept.join(total, ["k", "n", "history"]).select("k", "n", "h", "history", ((F.col("c") - DISCOUNT) / F.col("t")).alias("alpha"))


class Model:
    """Sorted string hashes with alpha and gamma of each class; picklable, for a broadcast."""

    def __init__(self, classes: list[str], order: int, table: pa.Table):
        """``table`` has (k, h, history, alpha), k the index in ``classes``."""
        self.classes, self.order = classes, order
        k, h, history, alpha = (table.column(c).to_numpy() for c in ("k", "h", "history", "alpha"))
        self.keys = np.unique(np.concatenate((h, history, [0])).view(np.uint64))
        self.alpha = np.zeros((len(self.keys) + 1, len(classes)), np.float32)
        spent = np.zeros_like(self.alpha)
        np.add.at(self.alpha, (self._find(h.view(np.uint64)), k), alpha)
        np.add.at(spent, (self._find(history.view(np.uint64)), k), alpha)
        self.gamma = np.clip(1.0 - spent, 1e-6, 1.0)

    def _find(self, h: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[i] == h, i, len(self.keys))

    def score(self, words: list[str]) -> np.ndarray:
        """One row a word: the log-likelihood under each class, then the number of characters predicted."""
        out = np.zeros((len(words), len(self.classes) + 1))
        empty = self._find(np.zeros(1, np.uint64))[0]
        for lo in range(0, len(words), 20_000):
            some = words[lo : lo + 20_000]
            word, h, at, start = _hashes(some, self.order)
            p = np.full((len(word), len(self.classes)), FLOOR, np.float32)
            before = np.full(len(word), empty)
            for n in range(1, self.order + 1):
                ok = np.flatnonzero(at >= max(1, n - 1))
                found = np.full(len(word), len(self.keys))
                near = np.flatnonzero(at >= n - 1)
                found[near] = self._find(h[n][near])
                p[ok] = self.alpha[found[ok]] + self.gamma[before[ok - 1]] * p[ok]
                before = found
            logs = np.log(p)
            logs[start] = 0
            ends = np.flatnonzero(start)
            out[lo : lo + len(some), :-1] = np.add.reduceat(logs, ends, axis=0)
            out[lo : lo + len(some), -1] = np.add.reduceat(~start, ends, dtype=np.int64)
        return out


class Scorer:
    """Sums of word scores for whole texts, each distinct chunk between white space scored once."""

    def __init__(self, model: Model):
        self.model, self.width = model, len(model.classes) + 1
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((1 << 16, self.width), np.float32)

    def _learn(self, chunks: list[str]) -> None:
        runs = [letter_runs(c) for c in chunks]
        flat = [w for r in runs for w in r]
        of = np.repeat(np.arange(len(chunks)), [len(r) for r in runs])
        got = np.zeros((len(chunks), self.width))
        if flat:
            np.add.at(got, of, self.model.score(flat))
        n = len(self.memo)
        while n + len(chunks) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n : n + len(chunks)] = got
        self.memo.update(zip(chunks, range(n, n + len(chunks))))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """One row a text: log-likelihood under each class, and characters predicted (0: no letter)."""
        out = np.zeros((len(texts), self.width))
        for lo in range(0, len(texts), 200):
            split = [(t or "").split() for t in texts[lo : lo + 200]]
            new = set().union(*split).difference(self.memo)
            if len(self.memo) + len(new) > MEMO:
                self._reset()
                new = set().union(*split)
            if new:
                self._learn(list(new))
            sizes = np.array([len(s) for s in split])
            idx = np.fromiter((self.memo[c] for s in split for c in s), np.int64, int(sizes.sum()))
            full = np.flatnonzero(sizes)
            if len(full):
                out[lo + full] = np.add.reduceat(self.rows[idx], (np.cumsum(sizes) - sizes)[full], axis=0, dtype=np.float64)
        return out


def fit(rows: DataFrame, classes: list[str], order: int) -> Model:
    """Models of ``rows`` (k, text), k the index in ``classes``."""
    return Model(classes, order, kneser_ney(cut(count_strings(rows, range(1, order + 1))), order).toArrow())


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` other than text, and ``logs`` (array: log-likelihood of the whole text under each class, characters predicted)."""
    from geomill.session import bound_batches

    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            got = scorer(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(got.tolist(), pa.list_(pa.float64()))], [*rest, "logs"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), "logs array<double>"])
    return docs.mapInArrow(run, schema)
