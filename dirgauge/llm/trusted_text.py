"""Quality classifier: perplexity under models of trusted text, against quantiles per language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirgauge.llm import kneser_ney, reach
from dirgauge.llm.ppm import held_out
from dirgauge.llm.quantiles import quantiles
from dirgauge.operators.joins import broadcast_if_small
from dirgauge.session import materialise

QUANTILE = 0.95
#: Most trusted ids (8 bytes each) that are sent to all tasks; more are joined by a shuffle.
MAX_SENT = 1_000_000


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of every document all of whose labels say quality 1; NULL says nothing."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"))
    return known.where("q = 1").select("doc_id")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_points, perplexity, threshold, accepted per row of `docs` (doc_id, text, lang).

    The models learn from trusted texts (`labels`: doc_id, quality) whose id is not held out; each
    language's threshold is the `quantile` of the perplexity of its held-out trusted texts. Perplexities come from joins of the
    texts' n-grams with the counts' code lengths (`kneser_ney.score`). A NULL lang
    is a language ''. Texts without code points or without a model, and languages without held-out
    trusted texts, give NULL in perplexity or threshold and are not accepted. Repeated rows count as
    often as they come.
    """
    reach(docs.sparkSession)
    ids = materialise(trusted_ids(labels), "trusted")
    few = ids.count() <= MAX_SENT
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")
    rows = docs.select("doc_id", lang, "text")
    taught = rows.where(~held_out()).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    model = kneser_ney.fit(kneser_ney.count(taught.select("lang", "text")))
    scored = materialise(kneser_ney.score(rows, model), "scored")
    aside = scored.where(held_out()).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    limits = quantiles(aside.where("bits IS NOT NULL"), "lang", "bits", [quantile], "doc_id").select("lang", F.col("q")[0].alias("limit"))
    return scored.join(broadcast_if_small(materialise(limits, "limits")), "lang", "left").select(
        "doc_id",
        "lang",
        "n_points",
        F.pow(F.lit(2.0), "bits").alias("perplexity"),
        F.pow(F.lit(2.0), "limit").alias("threshold"),
        F.coalesce(F.col("bits") <= F.col("limit"), F.lit(False)).alias("accepted"),
    )
