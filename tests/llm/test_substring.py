import hashlib
import random
import re

from geomill.llm import substring


def brute(rows):
    """(doc_id, text) rows, none of a null doc_id."""
    first, split, out = {}, [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows], []
    for (i, _), words in zip(rows, split):
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            first[w] = min(first.get(w, (i, s)), (i, s))
    for (i, _), words in zip(rows, split):
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            if first[tuple(words[s : s + 20])] != (i, s):
                gone[s : s + 20] = [True] * 20
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(docs):
    got = substring.remove_repeats(docs)
    return sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", substring.kept_words_sha256()).collect())


def test_equals_brute_force(docs_of):
    draw = random.Random(2)
    passages = [[f"p{draw.randrange(50)}" for _ in range(draw.randrange(15, 70))] for _ in range(6)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(draw.randrange(5)):
            words += [draw.choice("abcdefgh") for _ in range(draw.randrange(40))]
            words += draw.choice(passages)[draw.randrange(10) :]
        rows.append((i, "\t".join(words)))
    rows += [(100, rows[5][1]), (101, "la " * 90), (102, " la" * 45 + " "), (103, "short text twice"), (104, "short text twice")]
    assert run(docs_of(rows)) == brute(rows)


def test_groups_do_not_matter(docs_of, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(60))) for i in range(60)]
    one = run(docs_of(rows))
    monkeypatch.setattr(substring, "GROUP_BYTES", 200)
    assert run(docs_of(rows)) == one == brute(rows)


def test_odd_rows(odd, none):
    got = substring.remove_repeats(odd, keep=("lang",)).collect()
    by = {(r.doc_id, r.n_words): r for r in got}
    assert len(got) == 9 and by[1, 0].kept_text is None and by[2, 0].kept_text == "" and by[3, 0].kept_text == " \t\n"
    assert by[6, 30_000].n_removed == 29_999
    assert by[None, 2].kept_text == "a b" and by[4, 1].lang == "en"
    assert substring.remove_repeats(none).count() == 0


def test_rows_of_one_id_count_once(docs_of):
    text = " ".join(f"w{i}" for i in range(40))
    got = substring.remove_repeats(docs_of([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 40)]


def test_rows_of_one_id_with_other_texts_are_judged_by_their_own(docs_of):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (2, a), (2, b), (3, f"{b} {a}"), (3, f"x {a}"), (4, b)]
    assert run(docs_of(rows)) == brute(rows)
    got = {(r.doc_id, r.kept_text): r.n_removed for r in substring.remove_repeats(docs_of(rows)).collect()}
    assert got[2, b] == 0 and got[2, ""] == 40


def test_random_rows_with_repeated_ids(docs_of, monkeypatch):
    draw = random.Random(9)
    base = [f"w{draw.randrange(30)}" for _ in range(400)]
    rows = []
    for _ in range(60):
        at = draw.randrange(300)
        rows.append((draw.randrange(12), " ".join(base[at : at + draw.randrange(10, 90)])))
    want = brute(rows)
    assert run(docs_of(rows)) == want
    monkeypatch.setattr(substring, "GROUP_BYTES", 300)
    assert run(docs_of(rows)) == want


def test_rows_of_a_null_id_come_last_and_keep_one_copy(docs_of):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    got = substring.remove_repeats(docs_of([(None, a), (None, b), (None, b), (5, a), (None, f"{b} tail")])).collect()
    by = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got)
    assert by in ([(0, 30, 0), (0, 30, 0), (0, 30, 30), (0, 31, 30), (5, 30, 0)], [(0, 30, 30), (0, 30, 30), (0, 30, 30), (0, 31, 0), (5, 30, 0)])


def test_text_hash_is_that_of_the_copies(spark):
    from pyspark.sql import functions as F

    for text in ("", "a", "Zo\u00eb \U0001f600 " * 40):
        row = spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t"), F.xxhash64(F.lit(1), "t")).first()
        assert tuple(row) == substring.text_hash(text.encode())
