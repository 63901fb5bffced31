"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.llm import decontaminate, flatgraph, html, langid, lexsearch, mixing, nearest, packing, quantize, sampling, simhash, substring, tokenfiles, toxicity
from geomill.session import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(sampling.crc_remainder("doc_id", 5) == 0, F.lit(False))
    detector = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    scored = toxicity.score(docs, detector)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "llr")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatgraph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.document_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), separator=49407).select("doc_id", "n_tokens")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_order(table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(sampling.crc_remainder("doc_id", 3) == 1, F.lit(False))
    found = langid.identify(docs, langid.train(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", substring.kept_words_sha256().alias("kept_sha256"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.items_sha256().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexsearch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = quantize.compress(table(spark, sf_dir, "embeddings"), keep={"label": "label"})
    return quantize.with_group_error(coded).select("vec_id", quantize.code_text().alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_packing, op3_html, op4_vectors, op5_tokens, op6_mixing, op7_nearest, op8_simhash, op9_language, op10_substring, op11_decontamination, op12_search, op13_codes)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP11 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS s FROM d, ns)),
m AS (SELECT doc_id, s, n, item_id FROM dw JOIN iw USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""

_OP12 = f"""
WITH t AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
ln AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
st AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM ln),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS many FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(many * floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN ln USING (doc_id), st GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20"""


def _codes_sql(rounds: int = 4) -> str:
    """Lloyd rounds over all pairs of parts and entries."""
    steps = ["""
v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS MATERIALIZED (SELECT r, k, x[k * (len(x) // 4) + 1 : (k + 1) * (len(x) // 4)] AS x FROM v, range(4) AS parts(k)),
c0 AS MATERIALIZED (SELECT k, r - 1 AS e, x AS c FROM p WHERE r <= 256)"""]
    near = "SELECT r, k, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := e)) AS m FROM p JOIN c{0} USING (k) GROUP BY r, k"
    for i in range(rounds):
        steps.append(f"""
a{i} AS MATERIALIZED ({near.format(i)}),
s{i} AS (SELECT k, e, list(f ORDER BY pos) AS c FROM (SELECT k, m.e AS e, pos, floor_mean AS f FROM (
  SELECT k, m, pos, ((sum(val) - ((sum(val) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_mean FROM (SELECT k, struct_pack(e := a.m.e) AS m, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS val FROM a{i} a JOIN p USING (r, k)) GROUP BY k, m, pos)) GROUP BY k, e),
c{i + 1} AS MATERIALIZED (SELECT k, e, coalesce(s{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN s{i} USING (k, e))""")
    steps.append(f"""
a AS MATERIALIZED ({near.format(rounds)}),
f AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY k) AS code, sum(m.d)::BIGINT AS error FROM a GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM c{rounds})""")
    return "WITH " + ",".join(steps) + " SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN f USING (r), h"


#: SQL of operators 11 to 13.  The others have none that is fast enough on whole tables; tests compare with brute force.
ORACLES: dict[str, str] = {"op11_decontamination": _OP11, "op12_search": _OP12, "op13_codes": _codes_sql()}
