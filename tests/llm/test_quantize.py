import hashlib

import numpy as np
import pytest

from geomill.llm import quantize

SCHEMA = "vec_id long, embedding array<float>, label int, id long, x string, best int"


def brute(rows, parts=4, entries=256, rounds=4):
    """[(vec_id, code, error)] and the hash, by full scans over Python integers."""
    kept = sorted(((i is None, i or 0, v, i, lab) for i, v, lab in rows), key=lambda r: r[:3])
    x = [[int(np.floor(1024 * float(np.float32(c)))) for c in r[2]] for r in kept]
    d = len(x[0]) // parts
    cut = [[r[p * d : (p + 1) * d] for p in range(parts)] for r in x]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            near = [min((sum((a - b) ** 2 for a, b in zip(c[p], e)), j) for j, e in enumerate(books[p])) for p in range(parts)]
            out.append(([n[1] for n in near], sum(n[0] for n in near)))
        return out

    for _ in range(rounds):
        own = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [c[p] for c, (code, _) in zip(cut, own) if code[p] == j]
                if mine:
                    books[p][j] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(r[3], "".join(f"{j:02x}" for j in code), err) for r, (code, err) in zip(kept, assign())]
    flat = ",".join(str(v) for b in books for e in b for v in e)
    return sorted(found, key=str), hashlib.sha256(flat.encode()).hexdigest()


def make(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], lab, 1, "x", 2) for i, v, lab in rows], SCHEMA)


def run(spark, rows, **more):
    coded, books = quantize.compress(make(spark, rows), **more)
    return sorted(((r.vec_id, r.code, r.error) for r in coded.select("vec_id", quantize.code_text().alias("code"), "error").collect()), key=str), books


def sample(n=500, d=16, seed=3):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, d)).astype(np.float32) / 4
    x[n // 2 :] = np.round(x[n // 2 :] * 8) / 8  # ties and equal parts
    x[n // 12 : n // 8] = x[n // 12]
    x[n // 7] = 0
    return [(i * 3, v.tolist(), i % 5 if i % 7 else None) for i, v in enumerate(x)]


@pytest.mark.parametrize("more", [{}, {"groups": 3}, {"entries": 20, "groups": 7, "rounds": 6}])
def test_codes_equal_full_scans(spark, more):
    rows = sample()
    got, books = run(spark, rows, **more)
    want, sha = brute(rows, entries=more.get("entries", 256), rounds=more.get("rounds", 4))
    assert got == want and books.sha256() == sha


def test_bounds_save_distances():
    draw = np.random.default_rng(1)
    centres = draw.integers(-4000, 4000, (64, 8))
    x = centres[draw.integers(0, 64, 3000)] + draw.integers(-200, 200, (3000, 8))
    group = quantize.cluster_entries(centres, 8)
    best, error, lower = quantize.first_assignment(x, centres, group)
    moved = centres + draw.integers(-30, 30, centres.shape)
    drift = np.sqrt(((moved - centres) ** 2).sum(1).astype(float))
    again, _, _, scanned = quantize.next_assignment(x, best, np.sqrt(error), lower, moved, group, drift)
    assert (again == quantize.first_assignment(x, moved, group)[0]).all() and scanned < 0.2 * x.shape[0] * 64


def test_large_components_stay_exact():
    x = np.array([[2**30, -(2**30) + 1], [2**30 - 1, 5]], np.int64)
    c = np.array([[2**30 - 1, -(2**30)], [2**30, 5], [0, 0]], np.int64)
    d = quantize._squares(x, c)
    assert d[0, 0] == 2 and d[1, 1] == 1 and d[0, 2] == 2**60 + (2**30 - 1) ** 2


def test_odd_rows(spark):
    rows = sample(30)
    odd = [(1, None, 0), (4, [float("nan")] * 16, 0), (7, [None] * 16, 0), (10, [float("inf")] + [0.0] * 15, 0), (13, [], 1), (16, [1.0] * 8, 1)]
    more = [(None, [0.5] * 16, None), (3, rows[9][1], 2), rows[4]]
    got, books = run(spark, rows + odd + more)
    want, sha = brute(rows + more)
    assert got == want and books.sha256() == sha and books.entries.shape[1] == 33


def test_empty_table_and_unequal_parts(spark):
    got, books = run(spark, [])
    assert got == [] and books.sha256() == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        run(spark, [(1, [1.0, 2.0, 3.0], 0)])
    with pytest.raises(ValueError):
        run(spark, [(1, [1e30, 0, 0, 0], 0)])


def test_label_errors(spark):
    rows = sample(60)
    coded, books = quantize.compress(make(spark, rows), keep={"label": "label"}, entries=8)
    found = quantize.with_group_error(coded).collect()
    for r in found:
        assert r.label_error == sum(o.error for o in found if o.label == r.label)
    first = books.decode(np.array([r.codes for r in found]))
    assert first.shape == (60, 16) and np.abs(first).max() < 2
