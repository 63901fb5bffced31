"""Near copies are verified by a link a text before their other links."""

import numpy as np

from geomill.llm import simhash


def test_texts_of_a_group_are_not_verified_in_all_pairs(spark, monkeypatch):
    draw = np.random.default_rng(5)
    base = [f"w{i}" for i in draw.integers(0, 5000, 400)]
    rows = []
    for i in range(9):
        words = list(base)
        words[40 * i + 20] = f"other{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, real = [], simhash.verify
    monkeypatch.setattr(simhash, "verify", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    assert {r.component_id for r in simhash.similar_documents(docs).collect()} == {0}
    assert sum(seen) <= 12  # 36 pairs
