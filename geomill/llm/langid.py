"""Language identification by one character Kneser-Ney model a language."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.llm import charlm, sampling
from geomill.session import cut

UNKNOWN = "und"
MAX_LANGUAGES = 2000


@dataclass
class Identifier:
    """A model and its calibration: ``sharpness`` turns log-likelihood per character into shares, ``limit`` is the cross-entropy beyond which a text is like none of the languages."""

    model: charlm.Model
    sharpness: float
    limit: float


#: Values of the sharpness that calibration tries, and steps of a range that it counts at once.
SHARPNESS, STEPS = tuple(float(s) for s in np.geomspace(1, 200, 40)), 4096


def _calibrate(scored: DataFrame) -> tuple[float, float]:
    """The sharpness of least log loss over all of ``scored`` (k, logs), and the 99.9th percentile of the right language's cross-entropy with a tenth added."""

    def losses(batches):
        total, rows = np.zeros(len(SHARPNESS)), 0
        for batch in batches:
            logs, truth = np.array(batch.column("logs").to_pylist(), float).reshape(batch.num_rows, -1), batch.column("k").to_numpy()
            x = logs[:, :-1] / logs[:, -1:]
            for i, s in enumerate(SHARPNESS):
                z = s * (x - x.max(1, keepdims=True))
                total[i] += (np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]).sum()
            rows += batch.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["loss"])

    known = cut(scored.filter(F.element_at("logs", -1) > 0).select("k", "logs"))
    summed = known.select("logs", "k").mapInArrow(losses, "loss array<double>").select(F.posexplode("loss").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("v", "i").collect()  # a row a sharpness
    if not summed:
        return 10.0, float("inf")
    entropy = known.select((-F.get("logs", F.col("k")) / F.element_at("logs", -1)).alias("x"))
    return SHARPNESS[summed[0].i], quantile(entropy, "x", 0.999) * 1.1


def quantile(rows: DataFrame, value: str, share: float) -> float:
    """The exact quantile of all values, between two of them by their distance: ranges are counted in steps and narrowed until one holds few rows."""
    x = F.col(value)
    rank = (rows.count() - 1) * share

    def at(rank: int) -> float:
        own = rows
        while True:
            n, lo, hi = own.agg(F.count(x), F.min(x), F.max(x)).first()
            if lo == hi:
                return lo
            if n <= STEPS:
                return own.orderBy(x).collect()[rank][0]  # few rows
            step = F.floor((x - lo) / (hi - lo) * STEPS)
            for r in own.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).orderBy("s").collect():  # a row a step
                if rank < r.n:
                    break
                rank -= r.n
            own = rows.filter(x.between(r.lo, r.hi))

    low = at(int(rank))
    return low if rank == int(rank) else low + (at(int(rank) + 1) - low) * (rank - int(rank))


def train(labelled: DataFrame, order: int = 4) -> Identifier | None:
    """Learns from ``labelled`` (doc_id, text, lang); None if it has no language.

    All documents are counted but a fifth, on all of which the curve is
    fitted; all are read whole.  A document of a null doc_id is not learned from.  There are at most
    ``MAX_LANGUAGES``, or training fails.
    """
    rows = labelled.filter("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", "lang")
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if not langs:
        return None
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = rows.withColumn("k", (F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int"))
    calibrating = sampling.is_calibration("doc_id")
    model = charlm.fit(rows.filter(~calibrating), langs, order)
    sharpness, limit = _calibrate(charlm.score_texts(rows.filter(calibrating).select("k", "text"), model))
    return Identifier(model, sharpness, limit)


def identify(docs: DataFrame, found: Identifier | None) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and rejected, one row per document.

    lang_pred has the lowest cross-entropy per character, ties going to the
    first language in order; score is its calibrated share among the
    languages; rejected marks texts that are like none of them.  Null, empty
    and letterless texts are ``und`` with score 0 and not rejected, as all are
    when nothing was learned.  Texts are read whole; repeated rows and null
    ids keep a row each; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    if found is None:
        return own.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(False).alias("rejected"))
    many = len(found.model.classes)
    scored = charlm.score_texts(own, found.model).withColumn("n", F.element_at("logs", -1)).withColumn("logs", F.slice("logs", 1, many))
    best = F.array_max("logs")
    share = 1 / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(found.sharpness * (x - best) / F.col("n")))
    letters = F.col("n") > 0
    return scored.select(
        "doc_id",
        F.when(letters, F.element_at(F.array(*map(F.lit, found.model.classes)), F.array_position("logs", best).cast("int"))).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(letters, share).otherwise(0.0).alias("score"),
        F.when(letters, -best / F.col("n")).alias("cross_entropy"),
        (letters & (-best / F.col("n") > found.limit)).alias("rejected"),
    )
