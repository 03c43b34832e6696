"""The document pipeline as a composition of data frame steps.

docs -> classify -> extract -> validate -> penalise -> mask -> score -> results. Everything up to the
candidates is computed next to each document; what is shuffled afterwards are narrow rows keyed by doc_id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from paperloom.functions.scalars import trace_id
from paperloom.operators.classify import classify
from paperloom.operators.extract import extract_fields
from paperloom.operators.plain import score_plain
from paperloom.operators.score import needs_reprocessing, route, score_documents
from paperloom.operators.validate import LEAST_OCR, low_ocr_confidence, penalize_fields, pii_findings, redact_fields, validate_fields
from paperloom.session import cut
from paperloom.sources.readers import check_text


@dataclass(frozen=True)
class Settings:
    """Parameters of a run; they become literals of the plan."""

    auto_approve: float = 0.90
    human_review: float = 0.70
    redact: bool = True
    max_text_chars: int = 200_000


@dataclass
class Stages:
    """The relations a run yields, each a lazy data frame over the same inputs."""

    documents: DataFrame
    errors: DataFrame
    fields: DataFrame
    findings: DataFrame
    scores: DataFrame
    settings: Settings = field(default_factory=Settings)


def classify_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text[, requested_type]) with doc_type, type_confidence and classifier_method."""
    requested = F.col("requested_type") if "requested_type" in docs.columns else None
    # the generator keeps the classification in one place of the plan, however often the type is used
    typed = F.inline(F.array(classify(F.col("text"), requested=requested)))
    return docs.select("*", typed).withColumnsRenamed({"confidence": "type_confidence", "method": "classifier_method"})


def judge(docs: DataFrame, fields: DataFrame, settings: Settings, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fields, findings, scores): validate, then lower confidences, then mask, then score.

    more: findings from elsewhere, such as a warning about a page hardly recognised.
    """
    findings = validate_fields(docs, fields)
    if more is not None:
        findings = findings.unionByName(more)
    lowered = penalize_fields(fields, findings)
    if settings.redact:
        masked = redact_fields(lowered)
        # the scores group them by document; stated here, since a union of parts that are each partitioned by
        # document is not so itself where adaptive execution is off (in a stream's batch)
        findings = findings.unionByName(pii_findings(masked)).repartition("doc_id")
        lowered = masked.select(*lowered.columns, "redacted")
    scores = score_documents(docs, lowered, findings).withColumn("routing", route(F.col("confidence"), settings.auto_approve, settings.human_review))
    return lowered, findings, scores


def check_documents(docs: DataFrame, settings: Settings) -> DataFrame:
    """docs with the error_code of those that can't be processed."""
    known = F.col("error_code") if "error_code" in docs.columns else F.lit(None).cast("string")
    return docs.withColumn("error_code", F.coalesce(known, check_text(F.col("text"), settings.max_text_chars), F.when(F.col("doc_id").isNull(), "no_id")))


def run(docs: DataFrame, settings: Settings | None = None) -> Stages:
    """All stages for docs (doc_id, text[, doc_type or requested_type][, source, mean_confidence][, error_code]).

    Blank and oversized texts, and rows that come with an error_code, become rows of errors and go no further.
    doc_id is unique; null ids are errors. With source and mean_confidence, as `ingest` gives them, documents
    hardly recognised get a warning.
    """
    settings = settings or Settings()
    checked = check_documents(docs, settings)
    errors = checked.where("error_code is not null").select("doc_id", "error_code")
    usable = checked.where("error_code is null").drop("error_code")
    typed = usable if "doc_type" in usable.columns else classify_documents(usable)
    # narrow rows that every later step reads; written once, so that no text is classified or parsed twice
    once = cut(extract_fields(typed.select("doc_id", "doc_type", "text"), with_documents=True))
    extracted, kinds = once.where("name is not null"), once.where("name is null").select("doc_id", "doc_type")
    low = low_ocr_confidence(usable) if {"source", "mean_confidence"} <= set(usable.columns) else None
    fields, findings, scores = judge(kinds, extracted, settings, low)
    return Stages(typed, errors, fields, findings, scores, settings)


def run_scores(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """run(docs).scores where nothing else is asked for: no field and no finding leaves its document's row.

    Plain texts are scored in one pass, written once as narrow rows; all others go through run.
    """
    settings = settings or Settings()
    usable = check_documents(docs, settings).where("error_code is null")
    typed = "doc_type" in docs.columns
    given = F.col("doc_type") if typed else F.col("requested_type") if "requested_type" in docs.columns else F.lit(None)
    low = (F.col("source") == "ocr") & (F.col("mean_confidence") < LEAST_OCR) if {"source", "mean_confidence"} <= set(docs.columns) else F.lit(False)
    passed = cut(score_plain(usable.select("doc_id", "text", given.cast("string").alias("given_type"), F.coalesce(low, F.lit(False)).cast("bigint").alias("low")), typed))
    scores = passed.where("text is null").drop("given_type", "low", "text").withColumn("routing", route(F.col("confidence"), settings.auto_approve, settings.human_review))
    rest = passed.where("text is not null")
    if rest.isEmpty():
        return scores
    # the warning about recognition is told again by what it depends on
    again = rest.select("doc_id", "text", F.col("given_type").alias("doc_type" if typed else "requested_type"), F.when(F.col("low") > 0, "ocr").alias("source"), F.lit(0.0).alias("mean_confidence"))
    return scores.unionByName(run(again, settings).scores)


def results(stages: Stages) -> DataFrame:
    """One nested row a document: scores with its fields and findings as arrays."""
    fields = stages.fields.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("name", "value_str", "value_num", "confidence", "source"))).alias("fields"))
    findings = stages.findings.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "severity", "code", "field"))).alias("findings"))
    return stages.scores.join(fields, "doc_id", "left").join(findings, "doc_id", "left")


def document_results(stages: Stages, tables: DataFrame | None = None, usage: DataFrame | None = None) -> DataFrame:
    """The result row of each document: trace_id, type, method, fields, tables, findings, confidence, routing, pages, usage.

    tables: doc_id, page, headers, rows, confidence, backend. usage: doc_id, input_tokens, output_tokens, cost_usd,
    llm_calls. Documents without either have an empty list and zeros. trace_id follows from doc_id, so that a
    document processed again has the same one.
    """
    spark = stages.scores.sparkSession
    redacted = F.col("redacted") if "redacted" in stages.fields.columns else F.lit(False)
    field = F.struct("name", "value_str", "value_num", "confidence", "source", F.lit(1).alias("page"), F.lit(None).cast("array<double>").alias("bbox"), redacted.alias("redacted"))
    fields = stages.fields.groupBy("doc_id").agg(F.sort_array(F.collect_list(field)).alias("fields"))
    finding = F.struct("seq", "severity", "code", "field", F.to_json("details").alias("details"))
    findings = stages.findings.groupBy("doc_id").agg(F.sort_array(F.collect_list(finding)).alias("findings"))
    shape = "doc_id string, page int, headers array<string>, rows array<array<string>>, confidence double, backend string"
    tables = spark.createDataFrame([], shape) if tables is None else tables
    held = tables.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "headers", "rows", "confidence", "backend"))).alias("tables"))
    used = ("input_tokens", "output_tokens", "cost_usd", "llm_calls")
    usage = spark.createDataFrame([], "doc_id string, input_tokens bigint, output_tokens bigint, cost_usd double, llm_calls bigint") if usage is None else usage
    sums = usage.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in used])
    optional = [c for c in ("classifier_method", "pipeline_used", "n_pages") if c in stages.documents.columns]
    about = stages.documents.select("doc_id", *optional)
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t)).alias(c)
    rows = stages.scores.join(about, "doc_id").join(fields, "doc_id", "left").join(findings, "doc_id", "left")
    rows = rows.join(held, "doc_id", "left").join(sums, "doc_id", "left")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(
        trace_id(F.col("doc_id")).alias("trace_id"),
        "doc_id",
        F.col("doc_type").alias("document_type"),
        *optional,
        *[empty(c, kinds[c]) for c in ("fields", "tables", "findings")],
        F.col("confidence").alias("overall_confidence"),
        "routing",
        F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in used]).alias("usage"),
    )


class RunTrace:
    """What each stage of a run put out, counted while the job runs: no pass of its own, no extra shuffle."""

    def __init__(self) -> None:
        self.observed: dict[str, Observation] = {}

    def span(self, node: str, rows: DataFrame, **counted: Column) -> DataFrame:
        """rows, watched under the name of a node: how many there are, and sums of what else is given."""
        self.observed[node] = Observation(node)
        return rows.observe(self.observed[node], F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(k) for k, c in counted.items()])

    def log(self) -> list[dict]:
        """[{node, rows, ...}] in the order the nodes were watched; call it after an action on what was watched."""
        return [{"node": node, **seen.get} for node, seen in self.observed.items()]


def reprocess(stages: Stages, images: DataFrame, reader: Callable[[DataFrame], DataFrame]) -> Stages:
    """One more pass for documents of low confidence that have images; the others stay as they are.

    images: doc_id, n_images. reader: documents -> fields like those of extract_fields; a document it gives
    no field for keeps its own.
    """
    vision = stages.scores.join(images, "doc_id", "left").where(needs_reprocessing(F.col("routing"), F.lit(False), F.lit(True), F.col("n_images"))).select("doc_id", "doc_type")
    again = reader(vision)
    answered = again.select("doc_id").distinct()
    columns = [c for c in stages.fields.columns if c in again.columns]
    fields = stages.fields.join(answered, "doc_id", "left_anti").select(columns).unionByName(again.select(columns))
    kinds = stages.scores.select("doc_id", "doc_type")
    new_fields, findings, scores = judge(kinds, fields, stages.settings)
    return Stages(stages.documents, stages.errors, new_fields, findings, scores, stages.settings)
