import corpus_pipeline

import __spark_entry__
from geomill.llm import queries
from geomill.session import table


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_stages_take_effect_in_order(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "substring", "mixing", "packing"]
    counts = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] and counts[4] >= counts[3]
    pieces = docs.collect()
    assert sum(r.length for r in pieces if r.start == 0) > 0 and max(r.offset + r.length for r in pieces) <= 2048


def test_stages_take_odd_documents(spark, sf_dir, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert (out.count() > 0) == (docs is odd), name


def test_stages_judge_rows_of_one_id_or_of_none_by_their_text(spark, sf_dir, docs_of, monkeypatch):
    from geomill.llm import simhash, toxicity

    a, b, bad = (" ".join(f"{c}{i}" for i in range(30)) for c in ("a", "b", "bad"))
    rows = [(1, bad), (1, a), (None, bad), (None, b), (2, a), (2, a), (3, b), (3, b)]
    only = lambda docs, detector, text: docs.withColumn("predicted", docs[text].startswith("bad").cast("int")).drop(text)
    monkeypatch.setattr(toxicity, "train", lambda *_: None)
    monkeypatch.setattr(toxicity, "score_rows", only)
    clean = corpus_pipeline.drop_toxic(spark, docs_of(rows), sf_dir)
    assert sorted((r.doc_id or 0, r.text) for r in clean.collect()) == sorted((i or 0, t) for i, t in rows if t != bad)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs_of(rows), sf_dir).collect()
    # one row of each group of texts: the one of the smallest id
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(1, a), (1, bad), (3, b)]
    assert simhash.text_hash


def test_near_duplicates_equal_brute_force(spark, sf_dir):
    from geomill.llm import simhash

    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = [set(simhash.shingle_set(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                root[y] = x
    want = {rows[find(i)][0] for i in range(len(rows))}
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()}
    assert want <= got and len(got - want) <= 0.02 * len(want)
