"""Packing, token files and mixing."""

import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from geomill.llm import mixing, packing, tokenfiles

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


TEXTS = ["Hello, world!  It's 12:30 (really).", "café naïve Жизнь 中文 \U0001f600\U0001f600", "", None, "a\n\nb\tc", "x" * 300, "don't  won't I'll", "word, " * 4000, "<|endoftext|> inside", "A-B_c/d  'quoted'", "​zero nbsp"]


def test_chunks_encode_like_whole_texts():
    encode = packing.ChunkEncoder(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(TEXTS)] == [ids_of(t) for t in TEXTS]


def test_pieces_cover_documents_and_fill_sequences(docs_of):
    got = packing.pack(docs_of(list(enumerate(TEXTS))), PATH).collect()
    ids = [[*ids_of(t), 1] for t in TEXTS]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id]) and len(piece) == r.length
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[d])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_plan_pads_less_than_a_sequence_and_balances():
    sizes = np.random.default_rng(1).integers(1, 5000, 500)
    rows = packing.plan(sizes)
    assert rows[:, 2].sum() == sizes.sum() and rows[:, 3].max() + 1 == -(-sizes.sum() // 2048)
    assert packing.plan(np.zeros(0, np.int64)).shape == (0, 5)
    whole = packing.plan(np.array([1024] * 8))
    assert sorted(Counter(whole[:, 3].tolist()).values()) == [2] * 4


def test_odd_rows_are_packed(odd, none):
    got = packing.pack(odd, PATH).collect()
    assert {r.doc_id for r in got} == {None, 1, 2, 3, 4, 5, 6} and sum(r.length for r in got if r.doc_id == 4) == 4
    assert packing.pack(none, PATH).count() == 0


def brute_scan(tokens, separator):
    out, start = [], 0
    for i, t in enumerate(tokens):
        if t == separator:
            out.append((len(out), start, i - start, True))
            start = i + 1
    if start < len(tokens):
        out.append((len(out), start, len(tokens) - start, False))
    return out


@pytest.mark.parametrize("width", [2, 4])
def test_scan_stitches_blocks(spark, tmp_path, monkeypatch, width):
    monkeypatch.setattr(tokenfiles, "CHUNK", 3)
    draw = random.Random(width)
    files = {"a": [], "b": [9], "c": [5] * 70, "d": [9, 9, 9], "e": [draw.choice([1, 2, 3, 9]) for _ in range(999)], "f": [7] * 100 + [9] + [7] * 100 + [9]}
    for name, tokens in files.items():
        (tmp_path / name).write_bytes(np.array(tokens, f"<u{width}").tobytes())
    blocks = tokenfiles.read_blocks(spark, str(tmp_path), block_bytes=7 * width)
    got = defaultdict(list)
    for r in tokenfiles.scan(blocks, 9, width).collect():
        got[r.file.rpartition("/")[2]].append((r.ordinal, r.start, r.n_tokens, r.closed))
    assert {k: sorted(v) for k, v in got.items()} == {k: brute_scan(v, 9) for k, v in files.items() if v}


def test_document_tokens_round_trip(docs_of, odd, none):
    encode = Tokenizer.from_file(PATH)
    encode.encode_special_tokens = True
    want = {i: len(encode.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    got = tokenfiles.document_tokens(docs_of(list(enumerate(TEXTS))), PATH, 49407).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert tokenfiles.document_tokens(odd, PATH, 49407).count() == 9
    assert tokenfiles.document_tokens(none, PATH, 49407).count() == 0


def sources(spark, sizes):
    rows = [(s * 1000 + i, "w " * (1 + (i * 7 + s) % 5), None if s == 0 else f"s{s}") for s, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def brute_exponent(n, target, most):
    p = np.array(n, float) / sum(n)

    def fits(a):
        w = p**a / (p**a).sum()
        return (-(w * np.log(w)).sum() >= (target or 0) * np.log(len(p))), (w / n).max() / (w / n).min() <= most + 1e-9

    grid = np.linspace(0, 1, 20001)
    entropy = max((a for a in grid if fits(a)[0]), default=0) if target else 0
    repeats = min(a for a in grid if fits(a)[1])
    return max(entropy, repeats)


@pytest.mark.parametrize("target, most", [(0.95, 2.0), (0.8, 2.0), (None, 3.0), (0.999, 50.0), (0.95, 1.0)])
def test_weights_meet_entropy_and_repeats(spark, target, most):
    docs, rows = sources(spark, [40, 300, 90, 25])
    n = [sum(len(t.split()) for _, t, s in rows if s == k) for k in (None, "s1", "s2", "s3")]
    got = mixing.mix_order(docs, block_tokens=200, target_entropy=target, max_repeats=most).collect()
    exponent = brute_exponent(n, target, most)
    assert got[0].exponent == pytest.approx(exponent, abs=2e-3)
    w = np.array(n, float) ** got[0].exponent
    w /= w.sum()
    tokens = Counter()
    for r in got:
        tokens[r.source] += r.n_tokens
    budget = max(n) / w[n.index(max(n))]
    for k, share in zip((None, "s1", "s2", "s3"), w):
        assert budget * share - 6 < tokens[k] <= budget * share + 1
    copies = Counter(r.doc_id for r in got)
    assert set(copies) == {i for i, _, _ in rows} and max(copies.values()) <= np.ceil(most)


def test_blocks_hold_every_source_in_its_weight(spark):
    docs, _ = sources(spark, [300, 900, 600])
    got = mixing.mix_order(docs, block_tokens=500).collect()
    per = defaultdict(Counter)
    for r in got:
        per[r.block][r.source] += r.n_tokens
    weight = {r.source: r.weight for r in got}
    for block in range(max(per) - 1):
        for s, w in weight.items():
            assert abs(per[block][s] - 500 * w) <= 5


def test_budget_cuts_permutations(spark):
    docs, rows = sources(spark, [50, 50])
    whole = sum(len(t.split()) for _, t, _ in rows)
    got = mixing.mix(docs, budget=whole // 2)
    taken = Counter(r.doc_id for r in got.collect())
    assert max(taken.values()) == 1
    assert whole // 2 - 12 <= sum(len(t.split()) for i, t, _ in rows if i in taken) <= whole // 2 + 2


def test_mix_agrees_with_its_order_and_takes_odd_rows(spark, odd, none):
    docs, _ = sources(spark, [40, 300, 90])
    mixed = Counter((r.doc_id, r.turn) for r in mixing.mix(docs).collect())
    assert mixed == Counter((r.doc_id, r.turn) for r in mixing.mix_order(docs).collect())
    got = mixing.mix(odd, max_repeats=3.0)
    assert got.columns == [*odd.columns, "turn"] and got.filter("turn = 0").count() == 9
    assert mixing.mix_order(odd).filter("turn = 0").count() == 9
    assert mixing.mix(none).count() == 0 and mixing.mix_order(none).count() == 0


def test_columns_with_the_names_used_inside_are_kept(spark):
    rows = [(i, f"w{i} " * (i + 1), f"s{i % 2}", "k", i, 3, 9, "g") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _key string, _row int, _n int, turn int, _doc string")
    got = mixing.mix(docs, max_repeats=1.0)
    assert got.columns == ["doc_id", "text", "source", "_key", "_row", "_n", "_doc", "turn"]
    assert sorted({(r.doc_id, r._key, r._row, r._n, r._doc) for r in got.collect()}) == [(i, "k", i, 3, "g") for i in range(20)]


def test_ids_that_do_not_fit_fail(spark, docs_of):
    with pytest.raises(Exception, match="doesn't fit|separator"):
        tokenfiles.write_tokens(docs_of([(1, "a b c d e f g")]), PATH, separator=ids_of("c")[0])
    with pytest.raises(ValueError):
        tokenfiles.write_tokens(docs_of([(1, "a")]), PATH, separator=1 << 16)
    wide = tokenfiles.document_tokens(docs_of([(1, "a b"), (2, None)]), PATH, separator=1 << 20, width=4).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in wide) == [(1, len(ids_of("a b"))), (2, 0)]


def test_files_that_workers_cannot_open_are_read_by_spark(spark, tmp_path, monkeypatch):
    np.array([5, 6, 1, 7, 1], "<u2").tofile(tmp_path / "a.bin")
    want = [(r.block, bytes(r.data)) for r in tokenfiles.read_blocks(spark, str(tmp_path), 4).orderBy("block").collect()]

    def refuse(name):
        raise OSError(name)

    monkeypatch.setattr(tokenfiles, "_opened", refuse)
    assert [(r.block, bytes(r.data)) for r in tokenfiles.read_blocks(spark, str(tmp_path), 4).orderBy("block").collect()] == want and len(want) == 3


def test_repeated_chunks_make_no_objects():
    encode = packing.ChunkEncoder(PATH)
    text = "word Other, " * 300_000
    tracemalloc.start()
    (got,) = encode([text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == np.array(ids_of("word Other,") * 300_000, "<u4").tobytes()
    assert most < 3 * len(got)


def test_runs_keep_texts_apart(monkeypatch):
    draw = random.Random(5)
    bits = ["word", "Éa", "don't", "x,", "12", "中文", "H̱", " ", "<|endoftext|>", "Ωσς", "", "\n", "\t", "(a)", "é!?"]
    texts = [None, "", *("".join(draw.choice(bits) + draw.choice(["", " ", "  "]) for _ in range(draw.randrange(40))) for _ in range(200)), ""]
    want = [ids_of(t) for t in texts]
    encode = packing.ChunkEncoder(PATH)
    for most, memo in ((1 << 22, 400_000), (100, 400_000), (1, 3)):
        monkeypatch.setattr(packing, "RUN_BYTES", most)
        monkeypatch.setattr(packing, "MEMO", memo)
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == want
    assert encode([]) == []
