import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from geomill.llm import decontaminate, lexical, lexsearch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, name string, w int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in rows], ITEMS)


def brute_leaks(docs, items, window=10):
    owners = {}
    for i, text in items:
        w = WORD.findall(lower(text))
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            owners.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for i, text in docs:
        w = WORD.findall(lower(text))
        hit, there = set(), set()
        for n in {len(k) for k in owners}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in owners:
                    hit |= set(range(s, s + n))
                    there |= owners[tuple(w[s : s + n])]
        names = sorted(str(x) for x in there if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()))
    return sorted(out, key=str)


def leaks(docs, items):
    got = decontaminate.find_leaks(docs, items)
    return sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_hit", F.size("items"), decontaminate.items_sha256()).collect()), key=str)


def leaky(seed=3):
    draw = random.Random(seed)
    word = lambda: draw.choice(["the", "of", "and", "Ärger", "x9", *(f"w{draw.randrange(300)}" for _ in range(3))])
    items = [(i, " ".join(word() for _ in range(draw.choice([1, 3, 4, 9, 10, 11, 30, 60])))) for i in range(40)]
    items += [(3, "another text of item three that has more than ten words in it for sure"), (50, None), (51, " .,- "), (None, "an item without any id but with more words than ten of them here"), (60, items[5][1]), (61, "the " * 25)]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(draw.randrange(6)):
            parts.append(" ".join(word() for _ in range(draw.randrange(30))))
            w = (draw.choice(items)[1] or "").split()
            parts.append((", " if draw.random() < 0.5 else " ").join(w[draw.randrange(3) : len(w) - draw.randrange(3)]).upper())
        docs.append((i, " ".join(parts)))
    return docs + [(7, docs[7][1]), (None, docs[8][1]), (200, None), (201, ""), (202, "the " * 3000), (203, (items[9][1] or "") + "\0" + (items[9][1] or ""))], items


def test_leaks_equal_brute_force(spark, docs_of):
    docs, items = leaky()
    got = leaks(docs_of(docs), items_of(spark, items))
    assert got == brute_leaks(docs, items) and sum(r[2] > 0 for r in got) > 50


def test_leaks_with_a_full_filter_and_a_shuffled_join(spark, docs_of, monkeypatch):
    docs, items = leaky(5)
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 64)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert leaks(docs_of(docs), items_of(spark, items)) == brute_leaks(docs, items)


def test_leaks_have_spans(spark, docs_of):
    item = " ".join(f"q{i}" for i in range(12))
    row = decontaminate.find_leaks(docs_of([(1, f"a b {item} c")]), items_of(spark, [(4, item)])).first()
    assert [tuple(s) for s in row.spans] == [(2, 10), (3, 10), (4, 10)] and row.n_hit == 12 and row.items == [4]


def test_leaks_of_odd_rows_and_empty_tables(spark, docs_of, odd, none):
    assert decontaminate.find_leaks(none, items_of(spark, [(1, "a b")])).count() == 0
    assert {r.n_hit for r in decontaminate.find_leaks(odd, items_of(spark, [])).collect()} == {0}
    rows = decontaminate.find_leaks(odd, items_of(spark, [(1, "word"), (2, "ONE"), (3, "b")])).collect()
    assert sorted((r.n_words, r.n_hit, r["items"]) for r in rows) == sorted([(0, 0, []), (2, 1, [3]), (0, 0, []), (0, 0, []), (0, 0, []), (1, 1, [2]), (1, 1, [2]), (5, 0, []), (30_000, 30_000, [1])])


def brute_search(docs, items, k=20):
    tf = [(i, Counter(WORD.findall(lower(t)))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    many, terms = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    first = {}
    for i, t in items:
        if i is not None and t is not None:
            first[i] = min(first.get(i, t), t)
    out = []
    for item, text in first.items():
        scored = []
        for i, c in tf:
            m = 75 + 25 * sum(c.values()) * many // terms
            s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in WORD.findall(lower(text)) if t in c)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def corpus(seed=1):
    draw = random.Random(seed)
    word = lambda: f"t{int(draw.paretovariate(0.6)) % 400}"
    docs = [(i, " ".join(word() for _ in range(draw.randrange(1, 80)))) for i in range(300)]
    docs += [(i + 300, docs[0][1]) for i in range(30)] + [(5, docs[5][1]), (None, docs[9][1]), (700, None), (701, "-- "), (702, "T1 " * 20_000)]
    items = [(i, " ".join(word() for _ in range(draw.randrange(1, 20)))) for i in range(25)] + [(30, docs[0][1]), (31, None), (32, "!"), (None, "t1"), (33, "neverthere"), (4, "t1 t1 t2"), (34, "t3 T3 t9")]
    return docs, items


@pytest.mark.parametrize("entries, block", [(1 << 24, 1 << 20), (3000, 1 << 20), (1 << 24, 300)])
def test_search_equals_brute_force(spark, docs_of, monkeypatch, entries, block):
    monkeypatch.setattr(lexsearch, "SHARD_ENTRIES", entries)
    monkeypatch.setattr(lexsearch, "BLOCK_BYTES", block)
    docs, items = corpus()
    got = sorted(tuple(r) for r in lexsearch.search(docs_of(docs), items_of(spark, items)).collect())
    assert got == brute_search(docs, items)


def test_search_stops_before_the_lists_end():
    ids = list(range(4000))
    queries = lexsearch.Queries([1], ["rare common"])
    words = lexical.Words([(b"common " * (1 + i % 3) + (b"rare " * 5 if i < 40 else b"")) for i in ids])
    own, term = queries.terms(words)
    import numpy as np

    pair, tf = np.unique(words.doc[own] * 2 + term, return_counts=True)
    ends = np.searchsorted(pair // 2, np.arange(len(ids) + 1))
    weight = lexsearch.weights(4000, np.bincount(pair % 2, minlength=2))
    shard = lexsearch.Shard(np.array(ids), words.sizes, ends, pair % 2, tf, weight, 4000, int(words.sizes.sum()))
    looked = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            looked.append(len(at[0]))
            return np.asarray(self)[at]

    shard.forward = shard.forward.view(Counted)
    scores, found = shard.search(queries.items[0][1], queries.items[0][2], 10, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert len(found) == 10 and max(found) < 40 and sum(looked) < 1000


def test_search_of_odd_rows_and_empty_tables(spark, odd, none):
    assert lexsearch.search(none, items_of(spark, [(1, "a")])).count() == 0
    assert lexsearch.search(odd, items_of(spark, [])).count() == 0
    got = [(r.item_id, r.rank, r.doc_id) for r in lexsearch.search(odd, items_of(spark, [(1, "ONE")])).collect()]
    assert got == [(1, 1, 4), (1, 2, 4)]


def test_words_are_coded_alike_in_any_slice(monkeypatch):
    texts = [b"Abc, def", None, "Äöü ß9".encode(), b"", b"abc " * 50 + b"long" * 40]
    whole = lexical.Words(texts)
    code = whole.codes()
    monkeypatch.setattr(lexical, "SLICE_BYTES", 16)
    lexical._factors.cache_clear()
    assert (lexical.Words(texts).codes() == code).all()
    lexical._factors.cache_clear()
    assert whole.text(0, 4) == ["abc", "def", "Äöü", "ß9"] and code[0] == code[4] and whole.sizes.tolist() == [2, 0, 2, 0, 51]
