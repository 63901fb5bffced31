"""Toxicity and language identification: held-out accuracy and odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomill.llm import charlm, langid, sampling, toxicity
from geomill.session import table

DIR = "/root/testdata/sf0.01"


def test_remainder_is_crc32_of_the_text(spark):
    got = spark.range(200).select("id", sampling.crc_remainder("id", 5).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_languages_of_held_out_documents(spark):
    docs = table(spark, DIR, "documents")
    held = sampling.crc_remainder("doc_id", 3) == 1
    found = langid.identify(docs.filter(held), langid.train(docs.filter(~held)))
    got = found.join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").filter("lang IS NOT NULL AND n > 40").collect()
    assert len(got) > 200 and np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def toxic_docs(spark):
    draw = random.Random(6)
    plain, bad = ["".join(draw.choice("aeilnorst") for _ in range(7)) for i in range(300)], ["grubnak", "vilespit", "horrorbag"]
    rows, labels = [], []
    for i in range(900):
        words = [draw.choice(plain) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(8):
                words.insert(draw.randrange(60), draw.choice(bad))
        rows.append((i, " ".join(words), "en", "s", 1, "z"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, k int, logs string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_of_held_out_documents(spark):
    docs, labels = toxic_docs(spark)
    held = sampling.crc_remainder("doc_id", 5) == 0
    got = toxicity.score(docs, toxicity.train(docs, labels.filter(~held))).filter(held).collect()
    assert len(got) > 100
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in got]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_an_expression_of_ordinary_words_is_learned_by_its_history(spark):
    draw = random.Random(7)
    plain = ["".join(draw.choice("aeilnorst") for _ in range(7)) for i in range(200)]
    rows, labels = [], []
    for i in range(800):
        words = [draw.choice(plain) for _ in range(40)]
        for _ in range(6):  # both words are as common in either class, together only in the toxic one
            at = draw.randrange(len(words))
            words[at:at] = ["drop", "dead"] if i % 4 == 0 else ["drop", draw.choice(plain), "dead"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = sampling.crc_remainder("doc_id", 5) == 0
    detector = toxicity.train(docs, labels.filter(~held))
    got = toxicity.score(docs, detector).filter(held).collect()
    assert len(detector.model.pairs.keys)
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in got]) > 0.95


def test_counts_equal_brute_force(spark):
    texts = [(0, "one two three one two"), (0, "one two three one two"), (1, "two one two, ONE!"), (1, None), (0, "")]
    places = {}
    for k, text in texts:
        run = [w for c in (text or "").split() for w in charlm.letter_runs(c)]
        for i, w in enumerate(run):
            places.setdefault((w, run[i - 1] if i else None), set()).add((tuple(run[max(0, i - toxicity.HISTORY) : i]), k))
    want = sorted((w, -1 if b is None else toxicity._key(b + "$") >> 33, sum(k == 0 for _, k in p), sum(k == 1 for _, k in p)) for (w, b), p in places.items())
    got = toxicity.count_bigrams(spark.createDataFrame(texts, "k int, text string"))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_null_ids_are_scored_and_columns_of_the_same_names_replaced(spark):
    docs, labels = toxic_docs(spark)
    detector = toxicity.train(docs, labels)
    rows = spark.createDataFrame([(None, "grubnak vilespit horrorbag " * 3, 9.0, "keep"), (1, None, 9.0, None)], "doc_id long, text string, score double, logs2 string")
    got = toxicity.score_rows(rows, detector).collect()
    assert [(r.doc_id, r.predicted, r.logs2) for r in sorted(got, key=lambda r: r.doc_id or 0)] == [(None, 1, "keep"), (1, 0, None)]


def test_numerals_are_no_letters(spark):
    docs, _ = toxic_docs(spark)
    found = langid.train(docs)
    rows = [(1, "\u00bd \u00b2 \u2460 \u0967"), (2, "x\u00b2y")]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), found).collect()}
    assert got[1] == "und" and got[2] != "und" and charlm.letter_runs("x\u00b2y") == ["x", "y"]


def test_odd_rows(spark, odd, none):
    docs, labels = toxic_docs(spark)
    detector = toxicity.train(docs, labels)
    assert toxicity.score(odd, detector).count() == 9 and toxicity.score(none, detector).count() == 0
    assert {r.predicted for r in toxicity.score(odd, None).collect()} == {0}
    assert toxicity.train(docs, labels.filter("toxic = 0")) is None and toxicity.train(none, labels) is None
    found = langid.train(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb")))
    got = langid.identify(odd, found).collect()
    assert len(got) == 9 and sum(r.lang_pred == "und" for r in got) == 4
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.train(none) is None and langid.identify(none, found).count() == 0


def test_character_model_is_a_distribution(spark):
    rows = spark.createDataFrame([(0, "abab abc cab"), (0, "bab abba"), (1, "xyz zyx")], "k int, text string")
    model = charlm.fit(rows, ["p", "q"], 3)
    scores = model.score(["ab", "xy"])
    assert scores[0, 0] > scores[0, 1] and scores[1, 1] > scores[1, 0]
    assert scores[:, 2].tolist() == [3, 3]
    assert (model.gamma > 0).all() and (model.gamma <= 1).all()


class SlowModel:
    """Interpolated Kneser-Ney of one class by dictionaries of strings."""

    def __init__(self, words, order):
        self.order, raw = order, {}
        for w in words:
            marked = f" {w} "
            for i in range(1, len(marked)):
                for n in range(1, order + 1):
                    if i - n + 1 >= 0:
                        key = marked[i - n + 1 : i + 1], i - n + 1 == 0
                        raw[key] = raw.get(key, 0) + 1
        left = {}
        for text, _ in raw:
            left[text[1:]] = left.get(text[1:], 0) + 1
        counts = {text: float(c if len(text) == order or starts else left.get(text, c)) for (text, starts), c in raw.items()}
        total = {}
        for text, c in counts.items():
            total[text[:-1]] = total.get(text[:-1], 0) + c
        self.alpha = {text: (c - charlm.DISCOUNT) / total[text[:-1]] for text, c in counts.items() if c > 1 or len(text) < 3}
        self.spent = {}
        for text, v in self.alpha.items():
            self.spent[text[:-1]] = self.spent.get(text[:-1], 0) + v

    def share(self, history, char):
        """P(char given what comes before it in the word)."""
        p = charlm.FLOOR
        for n in range(1, self.order + 1):
            if n - 1 <= len(history):
                h = history[len(history) - n + 1 :]
                p = self.alpha.get(h + char, 0.0) + min(1.0, max(1e-6, 1 - self.spent.get(h, 0.0))) * p
        return p

    def log(self, word):
        marked = f" {word} "
        return sum(math.log(self.share(marked[:i], marked[i])) for i in range(1, len(marked)))


@pytest.mark.parametrize("order", [2, 4])
def test_character_model_equals_a_slow_one(spark, order):
    draw = random.Random(3)
    words = [["".join(draw.choice(letters) for _ in range(draw.randrange(1, 7))) for _ in range(200)] for letters in ("abcab", "cdeab")]
    model = charlm.fit(spark.createDataFrame([(k, " ".join(own[i::5])) for k, own in enumerate(words) for i in range(5)], "k int, text string"), ["p", "q"], order)
    asked = [*words[0][:60], *words[1][:60], "zebra", "a", "ccccccccc"]
    scores = model.score(asked)
    for k in (0, 1):
        slow = SlowModel(words[k], order)
        for word, row in zip(asked, scores):
            assert row[k] == pytest.approx(slow.log(word), rel=1e-4)
        for history in (" ", " a", " ab", " cd", " zz"):  # all characters together, of 512, are certain
            seen = set("abcde ")
            whole = sum(slow.share(history, c) for c in seen) + (512 - len(seen)) * slow.share(history, "?")
            assert whole == pytest.approx(1.0, abs=1e-4)


def test_unknown_script_is_rejected(spark):
    docs, _ = toxic_docs(spark)
    found = langid.train(docs)
    text = spark.createDataFrame([(1, "жжж ыыы щщщ " * 20)], "doc_id long, text string")
    assert langid.identify(text, found).first().rejected


@pytest.mark.parametrize("text, want", [("It's 2nd-rate", ["it", "s", "nd", "rate"]), ("", []), ("42 !", []), ("Ünïcode_x", ["ünïcode", "x"])])
def test_letter_runs(text, want):
    assert charlm.letter_runs(text) == want
