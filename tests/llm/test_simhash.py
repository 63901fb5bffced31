import random

import numpy as np
import xxhash

from geomill.llm import simhash


def brute_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def sample_texts():
    draw = random.Random(3)
    texts = []
    for _ in range(40):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.randrange(1, 120))]
        texts.append(" ".join(words))
        for _ in range(draw.randrange(3)):
            changed = list(words)
            changed[draw.randrange(len(words))] = "Changed"
            texts.append(" ".join(changed))
    return texts + ["", None, "  ", texts[0], texts[0].upper()]


def test_fingerprint_is_the_majority_of_shingle_hashes():
    for text in sample_texts():
        assert simhash.fingerprint(text)[0] == brute_fingerprint(text)
        assert len(set(simhash.fingerprint(text, many=3))) == (3 if (text or '').split() else 1)


def test_components_equal_brute_force(docs_of):
    texts = sample_texts()
    fps = [brute_fingerprint(t) for t in texts]
    want = components(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    got = simhash.near_duplicates(docs_of(list(enumerate(texts)))).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id for r in got if r.kept} == set(want.values())


def test_every_probe_plan_finds_all_pairs(spark):
    draw = np.random.default_rng(1)
    base = draw.integers(0, 2**63, 300, dtype=np.uint64)
    near = [base]
    for flips in (1, 2, 3, 4):
        x = base[:60].copy()
        for i in range(len(x)):
            for b in draw.choice(64, flips, replace=False):
                x[i] ^= np.uint64(1) << np.uint64(b)
        near.append(x)
    fps = np.unique(np.concatenate(near))
    rows = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    want = {frozenset((int(a), int(b))) for i, a in enumerate(fps) for b in fps[:i] if (int(a) ^ int(b)).bit_count() <= 3}
    got = {frozenset((r.a % 2**64, r.b % 2**64)) for r in simhash.fingerprint_links(rows, 3).collect()}
    assert got == want


def test_long_runs_stay_connected():
    x = np.unique(np.array([0] + [1 << b for b in range(64)], np.uint64))
    a, b = simhash._run_edges(np.zeros(len(x), np.uint64), x, 3)
    assert len(a) == len(x) - 1 and set(components(range(len(x)), zip(np.searchsorted(x, a).tolist(), np.searchsorted(x, b).tolist())).values()) == {0}
    a, b = simhash._run_edges(np.zeros(len(x), np.uint64), x, 3, most=6)
    assert (a == b).all() and set(a.tolist()) == set(x.tolist())  # all have more than that


def test_similar_documents_have_verified_links(docs_of):
    draw = random.Random(5)
    base = [f"t{draw.randrange(3000)}" for _ in range(200)]
    close, far = list(base), list(base)
    close[20] = close[120] = "x"
    for i in range(0, 200, 9):
        far[i] = f"y{i}"
    rows = [(10, " ".join(base)), (11, " ".join(close)), (12, " ".join(far)), (13, " ".join(base).upper()), (14, "something else")]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs_of(rows)).collect()}
    assert got == {10: 10, 11: 10, 12: 12, 13: 10, 14: 14}


def edited_copies(copies, words, edits, seed):
    draw = random.Random(seed)
    base = [f"t{draw.randrange(3000)}" for _ in range(words)]
    texts = []
    for _ in range(copies):
        own = list(base)
        for at in draw.sample(range(words), edits):
            own[at] = f"n{draw.randrange(10**9)}"
        texts.append(" ".join(own))
    return texts


def test_all_candidates_of_a_dense_group_are_verified(docs_of, monkeypatch):
    texts = edited_copies(200, 120, 2, 7) + edited_copies(200, 300, 5, 8)
    fps, sets = [simhash.fingerprint(t, many=3) for t in texts], [set(simhash.shingle_set(t).tolist()) for t in texts]
    alike = lambda a, b: (both := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - both)
    want = components(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if any((x ^ y).bit_count() <= 8 for x, y in zip(fps[a], fps[b])) and alike(a, b)])
    every = components(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if alike(a, b)])
    monkeypatch.setattr(simhash, "CELL_ROWS", 16)
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 64)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs_of(list(enumerate(texts)))).collect()}
    assert all(got[a] == got[want[a]] and every[a] == every[got[a]] for a in got)  # no link within 8 bits is lost, none is made up


def test_common_shingles_and_region_links_equal_brute_force(spark, monkeypatch):
    texts = edited_copies(40, 60, 1, 3) + edited_copies(30, 90, 3, 4)
    sets = [simhash.shingle_set(x) for x in texts]
    both = simhash._common_shingles(sets)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(70) for j in range(i))
    alike = [(i, j) for i in range(70) for j in range(i) if both[i, j] >= 0.8 * (len(sets[i]) + len(sets[j]) - both[i, j])]
    want = components(range(70), alike)
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 8)
    regions = spark.createDataFrame([(0 if i < 40 else 1, i, i) for i in range(70)], "region long, id long, component long")
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [(r.a, r.b) for r in simhash.region_links(regions, docs, 0.8, 5).collect()]
    assert set(map(tuple, map(sorted, got))) <= set(map(tuple, map(sorted, alike))) and components(range(70), got) == want


def test_links_of_dense_cells_in_blocks(spark, monkeypatch):
    draw = np.random.default_rng(6)
    fps = np.unique(np.array([int(sum(1 << int(b) for b in draw.choice(16, 2, replace=False))) for _ in range(100)], np.uint64))
    rows = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    want = components(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if (int(fps[a]) ^ int(fps[b])).bit_count() <= 3])
    monkeypatch.setattr(simhash, "CELL_ROWS", 8)
    got = [(int(np.searchsorted(fps, r.a)), int(np.searchsorted(fps, r.b))) for r in simhash.fingerprint_links(rows, 3).collect()]
    assert all((int(fps[a]) ^ int(fps[b])).bit_count() <= 3 for a, b in got) and components(range(len(fps)), got) == want


def test_texts_of_one_fingerprint_that_are_not_alike_stay_apart(docs_of):
    line = "again "
    tails = [" ".join(f"t{k}x{i}" for i in range(40)) for k in range(3)]
    rows = [(k, line * 300 + tails[k // 2] + (" end" if k % 2 else "")) for k in range(6)]
    fps = {simhash.fingerprint(t)[0] for _, t in rows}
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs_of(rows)).collect()}
    assert len(fps) <= 2 and got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_repeated_ids_and_null_ids_are_judged_by_their_texts(docs_of):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    got = simhash.similar_documents(docs_of([(7, a), (7, a), (7, b), (8, b), (9, a), (None, b), (None, c), (None, c)])).collect()
    seen = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got)
    assert seen == [(0, 0, True), (0, 0, True), (0, 7, False), (7, 7, True), (7, 7, True), (7, 7, True), (8, 7, False), (9, 7, False)]


def test_odd_rows(odd, none):
    for f in (simhash.near_duplicates, simhash.similar_documents):
        got = f(odd).collect()
        assert len(got) == 9 and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
        assert sum(r.kept for r in got if r.doc_id == 4) == 2
        assert f(none).count() == 0


def test_links_run_over_documents_without_an_id(spark, monkeypatch):
    far = 0xFFFF << 32
    rows = [(1, 0b0), (None, 0b111), (9, 0b111111), (None, far), (4, far + 1), (None, 0xFF << 20)]
    made = spark.createDataFrame(rows, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words: made)
    got = {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in simhash.near_duplicates(made).collect()}
    assert got == {(1, 0): 1, (None, 7): 1, (9, 63): 1, (None, far): 4, (4, far + 1): 4, (None, 0xFF << 20): None}
