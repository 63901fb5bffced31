"""Calibration over all documents kept out of the counts, against numpy on the same rows."""

import numpy as np
import pyarrow as pa

from geomill.llm import charlm, langid, sampling, toxicity


def test_all_labelled_documents_are_counted_and_calibrated(spark, monkeypatch):
    rows = [(i, ("bad awful words here " if i % 10 == 0 else "good plain text there ") * 3 + f"w{i}", int(i % 10 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen = {}
    count, points = toxicity.count_bigrams, toxicity.calibration_points
    monkeypatch.setattr(toxicity, "count_bigrams", lambda d: seen.update(counted=d.count()) or count(d))
    monkeypatch.setattr(toxicity, "calibration_points", lambda d: seen.update(points=points(d)) or seen["points"])
    assert toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")) is not None
    held = docs.filter(sampling.is_calibration("doc_id")).count()
    assert seen["counted"] == 600 - held and sum(r.n for r in seen["points"] if r.power == 0) == held


def test_quantile_is_exact(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 16)
    x = np.concatenate([np.random.default_rng(1).normal(size=3000), np.full(40, 2.5), [1e6]])
    rows = spark.createDataFrame([(float(v),) for v in x], "x double")
    for share in (0.0, 0.5, 0.991, 0.999, 1.0):
        assert np.isclose(langid.quantile(rows, "x", share), np.quantile(x, share), rtol=1e-12)


def test_calibration_reads_every_row(spark):
    draw = np.random.default_rng(2)
    logs = np.column_stack([-draw.uniform(1, 3, (9000, 3)) * 50, np.full(9000, 50.0)])
    k = draw.integers(0, 3, 9000)
    got = langid._calibrate(spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(k, logs)], "k int, logs array<double>"))
    x = logs[:, :-1] / 50
    loss = lambda s: (np.log(np.exp(s * (x - x.max(1, keepdims=True))).sum(1)) - (s * (x - x.max(1, keepdims=True)))[np.arange(9000), k]).mean()
    assert got[0] == min(langid.SHARPNESS, key=loss) and np.isclose(got[1], np.quantile(-x[np.arange(9000), k], 0.999) * 1.1, rtol=1e-9)


def test_places_of_a_word_travel_in_one_row(spark, monkeypatch):
    """Copies in many windows, a common word in parts; rows that travel are fewer than bigrams, and the counts are those of all places."""
    monkeypatch.setattr(toxicity, "WINDOW", 500)
    draw = np.random.default_rng(3)
    rows = [(i % 2, " ".join(w for j in draw.integers(0, 40, 30) for w in (f"{'abcdefgh'[j % 8]}{'klmno'[j // 8]}", "the"))) for i in range(60)] * 2
    docs = spark.createDataFrame(rows, "k int, text string").coalesce(1)
    assert toxicity.common_words(docs) >= {"the"}
    places = {}
    for k, text in rows:
        run = text.split()
        for i, w in enumerate(run):
            places.setdefault((w, run[i - 1] if i else None), set()).add((tuple(run[max(0, i - toxicity.HISTORY) : i]), k))
    want = {(w, -1 if b is None else toxicity._key(b + "$") >> 33): (sum(k == 0 for _, k in p), sum(k == 1 for _, k in p)) for (w, b), p in places.items()}
    bigrams = toxicity.count_bigrams(docs)
    assert {(r.word, r.before): (r.ordinary, r.toxic) for r in bigrams.collect()} == want
    kept = toxicity.rare_joined(bigrams).collect()
    assert {(r.word, r.before) for r in kept if r.before >= 0} == {p for p, n in want.items() if sum(n) >= toxicity.PLACES and p[1] >= 0}
    for w in {w for w, _ in want}:
        assert sum(r.ordinary + r.toxic for r in kept if r.word == w) == sum(sum(n) for (v, _), n in want.items() if v == w)


def test_chunks_are_split_at_once_as_one_by_one():
    chunks = ["a", "12", "Don't", "x²y", "İstanbul", "ΟΔΟΣ", "½", "naïve-42b", "१क"]
    for some in (chunks, chunks[:3], ["--"], []):
        assert charlm.letter_runs_of(some) == [w for c in some for w in (*charlm.letter_runs(c), "\n")]


def test_shares_of_words_are_those_of_their_letters_one_after_another():
    keys = np.array([toxicity._key(e) for e in ("abcd", "abcde", "abcdef", "abcdefg", "abcdefgh$", "abcd$", "ab$")], np.uint64)
    words = toxicity.Words(pa.table({"h": keys.view(np.int64), "ordinary": [50, 10, 9, 1, 2, 80, 3], "toxic": [9, 90, 70, 40, 60, 2, 90]}), 0.1)
    known = {}
    for w in ("abcdefgh", "abcdefgx", "abcde", "abcd", "ab", "abcxy", "z"):
        q = np.array([0.1])
        for e in [*(w[:n] for n in toxicity.PREFIXES if len(w) > n), w + "$"]:
            q = toxicity._mixed(words.table.counts[words.table.find(np.array([toxicity._key(e)], np.uint64))], q)
        assert words.shares([w])[0] == q[0] == words.shares([w], known)[0]
