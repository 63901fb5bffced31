"""What the SimHash stage shuffles: keys instead of cells, and only texts that are compared or change."""

from itertools import combinations

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from geomill.llm import simhash


def test_a_fingerprint_travels_once_more_than_bits_may_differ(spark, monkeypatch):
    draw = np.random.default_rng(4)
    fps = [int(x) for x in draw.integers(0, 2**63, 60)]
    for x in fps[:40]:
        fps.append(x ^ sum(1 << int(b) for b in draw.choice(64, int(draw.integers(1, 10)), replace=False)))
    probes = [(list(range(16)), 1), (list(range(16, 32)), 1), (list(range(32, 48)), 1), (list(range(48, 64)), 2)]  # thresholds as for millions of rows
    rows = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    frame, sent = type(rows), []
    real = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: sent.append(self.count()) or real(self, *a))
    got = {frozenset((r.a % 2**64, r.b % 2**64)) for r in simhash.fingerprint_links(rows, 8, probes).collect()}
    assert got == {frozenset(p) for p in combinations(fps, 2) if (p[0] ^ p[1]).bit_count() <= 8} and got
    assert sent == [9 * len(fps)]  # 188 cells of each otherwise


def test_all_near_values_share_a_cell_under_some_key():
    bits = [1, 4, 5, 9, 20, 33, 40, 41, 62]
    for threshold in range(4):
        for rows in (10, simhash.KEY_ROWS << 3, simhash.KEY_ROWS << 6):
            keys = simhash._keys(bits, threshold, rows)
            for apart in range(threshold + 1):
                for some in combinations(bits, apart):
                    x = np.uint64(sum(1 << b for b in some))
                    assert any(not x & mask and set(flips.tolist()) & set((flips ^ x).tolist()) for mask, flips in keys)
    assert len(simhash._keys(bits, 2, 10)) == 3 and len(simhash._keys(bits, 2, simhash.KEY_ROWS << 4)) == 6


def test_cells_are_made_in_slices(monkeypatch):
    draw = np.random.default_rng(2)
    x, flips, mask = draw.integers(0, 2**63, 500, dtype=np.uint64), simhash._flips([0, 1, 2, 3], 1), np.uint64(15)
    run = np.repeat([1, 2], 250)
    whole = [sorted(zip(c.tolist(), f.tolist())) for c, f in simhash._in_cells(x, run, mask, flips)]
    monkeypatch.setattr(simhash, "HELD_ROWS", 300)
    parts = [(c.tolist(), f.tolist()) for c, f in simhash._in_cells(x, run, mask, flips)]
    assert len(whole) == 1 and len(parts) == 9 and sorted(p for c, f in parts for p in zip(c, f)) == whole[0]
    assert len(whole[0]) == 2500 and len({c for c, _ in whole[0]}) == 32


def test_a_filter_flags_all_that_are_there(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("name"))
    there = rows.filter("id % 40 = 0")
    got = simhash.maybe_among(rows, F.col("name"), there.select("name"), 500, "met").groupBy((F.col("id") % 40 == 0).alias("there"), "met").count().collect()
    n = {(r.there, r.met): r["count"] for r in got}
    assert n[True, True] == 500 and (True, False) not in n and n[False, True] < 600
    none = simhash.maybe_among(rows, F.col("name"), rows.filter("false").select("name"), 0, "met")
    assert none.columns == ["id", "name", "met"] and none.filter("met").count() == 0


def test_only_texts_that_go_or_repeat_are_shuffled(spark, docs_of, sf_dir, monkeypatch):
    texts = [" ".join(f"{i}w{k}" for k in range(30)) for i in range(60)]
    rows = [*enumerate(texts), (100, texts[5]), (101, texts[6]), (7, texts[7]), (None, texts[8]), (None, "alone here"), (None, "alone here")]
    docs = docs_of(rows)
    frame, seen = type(docs), []
    real = frame.dropDuplicates
    monkeypatch.setattr(frame, "dropDuplicates", lambda self, subset=None: seen.append((subset, self.count())) or real(self, subset))
    monkeypatch.setattr(simhash, "BROADCAST_TEXTS", 0)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in got) == sorted([(-1, "alone here"), *enumerate(texts)])
    assert [n for subset, n in seen if subset != ["id"]] < [10]  # 62 otherwise
