"""Document confidence and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.dims import ERROR_COST, REQUIRED, WARN_COST


def input_path(force_vision: Column, vision_on: Column, ocr_on: Column, parsed: Column, scanned: Column) -> Column:
    """Which reader a document goes to: 'vlm', 'ocr' or 'text'."""
    return (
        F.when(force_vision & vision_on, "vlm").when(~F.coalesce(parsed, F.lit(False)), "text").when(scanned & ocr_on, "ocr").when(scanned & vision_on, "vlm").otherwise("text")
    )


def is_scanned(page_texts: Column, least_chars: int = 20) -> Column:
    """Pages there are, with fewer characters each, on average and without outer space, than a text layer has."""
    chars = F.aggregate(page_texts, F.lit(0), lambda a, t: a + F.length(F.btrim(t)))
    return F.coalesce((F.size(page_texts) > 0) & (chars / F.size(page_texts) < least_chars), F.lit(False))


def route(confidence: Column, auto: float = 0.90, review: float = 0.70) -> Column:
    return F.when(confidence >= auto, "auto_approve").when(confidence >= review, "human_review").otherwise("vlm_fallback")


def needs_reprocessing(routing: Column, done: Column, vision_on: Column, n_images: Column) -> Column:
    """Low confidence, not reprocessed before, and something to look at."""
    return (routing == "vlm_fallback") & ~F.coalesce(done, F.lit(False)) & vision_on & (F.coalesce(n_images, F.lit(0)) > 0)


def score_documents(docs: DataFrame, fields: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, doc_type, mean_confidence, coverage, n_errors, n_warnings, confidence, routing) for each of docs.

    confidence = mean field confidence x (0.5 + 0.5 coverage) less the cost of errors and warnings, within
    0..1. Sums are taken in decimals, so that the order of rows never shows.
    """
    required = F.create_map(*[x for t, f in REQUIRED.items() for x in (F.lit(t), F.array(*[F.lit(n) for n in f]))])
    filled = F.when(F.col("value_num").isNotNull() | (F.coalesce("value_str", F.lit("")) != ""), F.col("name"))
    per_doc = fields.groupBy("doc_id").agg(F.sum(F.col("confidence").cast("decimal(10,3)")).alias("conf_sum"), F.count("*").alias("n_fields"), F.collect_set(filled).alias("have"))
    counts = findings.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warn").alias("n_warnings"))
    joined = docs.select("doc_id", "doc_type").join(per_doc, "doc_id", "left").join(counts, "doc_id", "left")
    wanted = F.try_element_at(required, F.col("doc_type"))
    coverage = F.coalesce(F.size(F.array_intersect(wanted, F.coalesce("have", F.array().cast("array<string>")))) / F.size(wanted), F.lit(0.0))
    base = joined.select(
        "doc_id",
        "doc_type",
        F.coalesce(F.col("conf_sum").cast("double") / F.col("n_fields"), F.lit(0.0)).alias("mean_confidence"),
        coverage.alias("coverage"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_errors", "n_warnings")],
    )
    raw = F.col("mean_confidence") * (0.5 + 0.5 * F.col("coverage")) - ERROR_COST * F.col("n_errors") - WARN_COST * F.col("n_warnings")
    scored = base.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 3))
    return scored.withColumn("routing", route(F.col("confidence")))
