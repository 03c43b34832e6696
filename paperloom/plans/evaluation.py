"""The evaluation run: outcomes of several modes against labelled cases, in one plan with the mode as a column.

Nothing is collected but the few summary rows a report shows. A (case, mode) is one document of its own: it is
known by the struct of both, which joins and groups like any other key.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators import metrics as M
from paperloom.sources.writers import markdown_table

#: The mode whose figures stand first, if it was run.
HEADLINE = "pdf"


@dataclass
class Evaluation:
    """Relations of one run. details: a row a case and mode; the others are summaries."""

    details: DataFrame
    summary: DataFrame
    by_field: DataFrame
    by_type: DataFrame
    pairs: DataFrame
    routing: DataFrame


def evaluate(cases: DataFrame, outcomes: DataFrame, predicted: DataFrame, predicted_pairs: DataFrame | None = None) -> Evaluation:
    """Score outcomes against the cases' truth.

    cases: case_id (unique), origin, doc_type, ground_truth map[, pairs array<array<string>>]. outcomes: case_id,
    mode, predicted_type, routing, confidence, latency_ms, cost_usd. predicted: case_id, mode, name, value.
    predicted_pairs: case_id, mode, question, answer. Outcomes of unknown cases are left out; a case without truth
    counts for latency, routing and the classifier only.
    """
    key = F.struct("case_id", "mode").alias("doc_id")
    known = cases.select("case_id", "origin", "doc_type", "ground_truth")
    ran = outcomes.join(known, "case_id").withColumn("doc_id", key)
    truth = ran.select("doc_id", F.explode("ground_truth").alias("name", "value"))
    scored = M.field_counts(predicted.select(key, "name", "value").join(ran.where("size(ground_truth) > 0").select("doc_id"), "doc_id", "left_semi"), truth)
    counts = scored.join(ran.select("doc_id", "doc_type"), "doc_id").withColumn("mode", F.col("doc_id.mode"))
    correct = M.documents_correct(scored, ran.select("doc_id", "doc_type"))
    per_case = scored.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in M.COUNTS])
    details = (
        ran.drop("ground_truth")
        .join(per_case, "doc_id", "left")
        .join(correct, "doc_id", "left")
        .join(M.missed_and_wrong(scored), "doc_id", "left")
        .withColumn("f1", F.round(F.coalesce(M.f1(F.col("tp"), F.col("fp"), F.col("fn")), F.lit(0.0)), 4))
        .drop("doc_id", *M.COUNTS)
    )
    sums = M.sum_counts(counts, [["mode"], ["mode", "name"], ["mode", "doc_type"]], ["mode", "name", "doc_type"])
    prf = M.with_prf(sums)
    micro = prf.where("name is null and doc_type is null").select("mode", "tp", "fp", "fn", "precision", "recall", "f1")
    by_field = prf.where("name is not null").select("mode", "name", *M.COUNTS, "precision", "recall", "f1")
    by_type = prf.where("doc_type is not null").select("mode", "doc_type", *M.COUNTS, "precision", "recall", "f1")
    macro = by_field.where("tp + fn > 0").groupBy("mode").agg(F.round(F.avg(M.f1(F.col("tp"), F.col("fp"), F.col("fn"))), 4).alias("macro_f1"))
    same = F.when(F.col("predicted_type").isNotNull(), (F.col("predicted_type") == F.col("doc_type")).cast("double"))
    has_truth = F.col("correct").isNotNull()
    per_mode = details.groupBy("mode").agg(
        F.count("*").alias("documents"),
        F.round(F.avg(F.col("correct").cast("double")), 4).alias("doc_accuracy"),
        F.round(F.avg(same), 4).alias("classifier_accuracy"),
        F.round(F.sum(F.col("cost_usd").cast("decimal(18,6)")).cast("double"), 6).alias("cost_usd"),
        F.round(F.try_divide(F.sum(F.col("cost_usd").cast("decimal(18,6)")).cast("double"), F.count_if(has_truth)), 6).alias("cost_per_document"),
    )
    latency = M.latency_stats(outcomes, "latency_ms", ["mode"]).select("mode", F.col("mean").alias("latency_mean"), F.col("p50").alias("latency_p50"), F.col("p95").alias("latency_p95"))
    summary = per_mode.join(micro, "mode", "left").join(macro, "mode", "left").join(latency, "mode", "left")
    pairs = _pair_scores(cases, ran, predicted_pairs)
    return Evaluation(details, summary, by_field, by_type, pairs, details.groupBy("mode", "routing").agg(F.count("*").alias("n")))


def _pair_scores(cases: DataFrame, ran: DataFrame, predicted: DataFrame | None) -> DataFrame:
    """(mode, tp, fp, fn, precision, recall, f1) of the pairs of annotated forms."""
    if predicted is None or "pairs" not in cases.columns:
        return ran.sparkSession.createDataFrame([], "mode string, tp bigint, fp bigint, fn bigint, precision double, recall double, f1 double")
    true = ran.select("case_id", "doc_id").join(cases.where("size(pairs) > 0").select("case_id", F.explode("pairs").alias("p")), "case_id")
    true = true.select("doc_id", F.get("p", F.lit(0)).alias("question"), F.get("p", F.lit(1)).alias("answer"))
    said = predicted.select(F.struct("case_id", "mode").alias("doc_id"), "question", "answer").join(true.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = M.pair_counts(said, true).withColumn("mode", F.col("doc_id.mode"))
    return M.with_prf(counts.groupBy("mode").agg(*[F.sum(c).alias(c) for c in M.COUNTS]))


def evaluate_tables(candidates: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, per table) of the best candidate for each true table.

    truth: table_id, kind, headers, rows, ruled. candidates: table_id, pos, headers, rows. summary: a row for
    ruled, for unruled and (ruled null) for all, with tables, detected, tp, fp, fn, precision, recall, f1.
    """
    per_table = M.best_tables(candidates, truth.select("table_id", "headers", "rows")).join(truth.select("table_id", "kind", "ruled"), "table_id")
    sums = per_table.groupingSets([[F.col("ruled")], []], F.col("ruled")).agg(
        F.count("*").alias("tables"), F.count("pos").alias("detected"), *[F.sum(c).alias(c) for c in M.COUNTS], F.grouping_id().alias("every")
    )
    return M.with_prf(sums.where("ruled is not null or every = 1").drop("every")), M.with_prf(per_table)


def dataset_counts(cases: DataFrame, tables: DataFrame) -> DataFrame:
    """(documents, synthetic, annotated, tables): how many cases of each origin, and tables, a run has."""
    counts = cases.agg(F.count("*").alias("documents"), F.count_if(F.col("origin") == "synthetic").alias("synthetic"), F.count_if(F.col("origin") != "synthetic").alias("annotated"))
    # two relations of one row each
    return counts.join(tables.agg(F.count("*").alias("tables")), F.lit(True))


def headline(modes: Sequence[str]) -> str | None:
    """The mode that stands for the run: pdf if it was run, else the first."""
    return HEADLINE if HEADLINE in modes else (modes[0] if modes else None)


def worst(evaluation: Evaluation, mode: str, limit: int = 10) -> DataFrame:
    """The made-up cases of one mode with the lowest f1, then the lowest confidence."""
    rows = evaluation.details.where((F.col("mode") == mode) & (F.col("origin") == "synthetic"))
    return rows.orderBy("f1", "confidence", "case_id").limit(limit)


def run_record(name: str, evaluation: Evaluation, tables: DataFrame | None = None, generated_at: str | None = None) -> dict:
    """What is kept of a run, as plain values: summary rows only."""
    rows = lambda df, *order: [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]
    summary = rows(evaluation.summary, "mode")
    mode = headline([r["mode"] for r in summary])
    return {
        "name": name,
        "generated_at": generated_at,
        "headline_mode": mode,
        "modes": summary,
        "by_field": rows(evaluation.by_field, "mode", "name"),
        "by_type": rows(evaluation.by_type, "mode", "doc_type"),
        "pairs": rows(evaluation.pairs, "mode"),
        "routing": rows(evaluation.routing, "mode", "routing"),
        "worst_cases": [r.asDict(recursive=True) for r in worst(evaluation, mode).select("case_id", "doc_type", "f1", "confidence", "missed", "wrong").collect()] if mode else [],
        "tables": rows(tables, "ruled") if tables is not None else None,
    }


def write_run(path: str, record: dict) -> None:
    """The record of a run as a JSON file on the driver."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(record, indent=2, ensure_ascii=False, default=str) + "\n", encoding="utf-8")


def report(evaluation: Evaluation, tables: DataFrame | None = None, title: str = "Results") -> str:
    """The summaries of a run as Markdown."""
    shares = ("precision", "recall", "f1", "macro_f1", "doc_accuracy", "classifier_accuracy")
    parts = [f"# {title}"]
    sections = [("Modes", evaluation.summary.orderBy("mode")), ("By type", evaluation.by_type.orderBy("mode", "doc_type")), ("By field", evaluation.by_field.orderBy("mode", "name")), ("Routing", evaluation.routing.orderBy("mode", "routing")), ("Pairs", evaluation.pairs.orderBy("mode"))]
    if tables is not None:
        sections.append(("Tables", tables.orderBy("ruled")))
    for name, rows in sections:
        parts += [f"## {name}", markdown_table(rows, shares)]
    return "\n\n".join(parts) + "\n"
