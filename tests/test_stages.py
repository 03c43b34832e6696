"""Ingest, the tables gate, result rows, traces, evaluation runs, generators and what models answer."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.operators import metrics as M
from paperloom.operators.extract import extract_fields, extract_with_answers, prompt
from paperloom.operators.layout import from_partition
from paperloom.operators.validate import validate_fields
from paperloom.plans import evaluation as V
from paperloom.plans.generate import TEMPLATES, as_records, generate_documents, generate_tables
from paperloom.plans.ingest import Readers, extract_tables, ingest, table_reader
from paperloom.plans.pipeline import RunTrace, document_results, run
from paperloom.session import cut
from paperloom.sources.readers import retrying
from paperloom.sources.writers import manifest, repository



def _readers():
    """Readers as nested functions, which travel to the tasks as they are."""
    pages = {b"%PDF good": [{"text": "Invoice No: INV-77\nTotal: 10.00", "has_tables": True}], b"%PDF scan": [{"text": ""}]}

    def text_layer(content):
        return pages[content]

    def recognised(content):
        return [{"text": "Receipt No: R-123\nTotal: 3.00\nPaid by: cash", "confidence": 0.4}]

    def vision(content):
        return [{"text": "seen by the model, long enough to be used", "confidence": 0.8}]

    def grids(content):
        return [{"page": 1, "cells": [["a", "b"], ["1", None], ["", " "]], "confidence": 1.4}, {"cells": [["alone"]]}]

    return text_layer, recognised, vision, grids


text_layer, recognised, vision, grids = _readers()
ROWS = [
    ("text", "plain text of a note", None, False), ("good", None, b"%PDF good", False), ("scan", None, b"%PDF scan", False), ("forced", None, b"%PDF good", True),
    ("broken", None, b"%PDF odd", False), ("gif", None, b"GIF", False), ("both", "x", b"%PDF good", False), ("none", None, None, None), ("blank", "  ", None, None), ("empty", None, b"", None),
]


def deliveries(spark):
    return spark.createDataFrame(ROWS, "doc_id string, text string, content binary, force_vision boolean")


def test_ingest_routes_by_what_the_cheap_reader_found(spark):
    docs = deliveries(spark)
    got = {r.doc_id: r for r in ingest(docs, Readers(text_layer, recognised, vision)).collect()}
    assert len(got) == len(ROWS)
    assert {k: (got[k].source, got[k].pipeline_used, got[k].error_code) for k in got} == {
        "text": ("raw", "text", None), "good": ("text", "text", None), "scan": ("ocr", "ocr", None), "forced": ("vlm", "vlm", None), "broken": ("text", "text", "KeyError"),
        "gif": ("text", "text", "invalid_pdf"), "both": ("raw", "text", "not_one_input"), "none": ("raw", "text", "not_one_input"), "blank": ("raw", "text", "not_one_input"), "empty": ("raw", "text", "not_one_input"),
    }
    assert got["good"].has_tables and not got["scan"].has_tables and got["scan"].mean_confidence == 0.4
    alone = {r.doc_id: r for r in ingest(docs).collect()}
    assert alone["good"].error_code == "no_reader" and alone["text"].error_code is None
    assert {r.pipeline_used for r in ingest(docs, Readers(text_layer)).collect()} == {"text"}
    assert ingest(docs.limit(0), Readers(text_layer, recognised)).count() == 0


def test_tables_come_from_flagged_files_only(spark):
    docs, readers = deliveries(spark), Readers(text_layer, recognised, vision, {"lines": grids})
    read = cut(ingest(docs, readers))
    found = extract_tables(docs, read, readers).collect()
    assert [(r.doc_id, r.page, r.headers, r.rows, r.confidence, r.backend) for r in found] == [("good", 1, ["a", "b"], [["1", ""]], 1.0, "lines")]
    assert extract_tables(docs, read, readers, "other").count() == 0 and table_reader(readers, "other") is None and table_reader(readers)[0] == "lines"
    rows = {r.doc_id: r for r in document_results(run(read), extract_tables(docs, read, readers), spark.createDataFrame([("good", 5, 2, 0.1, 1), ("good", 5, 2, 0.1, 1)], "doc_id string, input_tokens bigint, output_tokens bigint, cost_usd double, llm_calls bigint")).collect()}
    assert set(rows) == {"text", "good", "scan", "forced"} and len(rows["good"].tables) == 1 and rows["good"].usage.input_tokens == 10 and rows["text"].usage.llm_calls == 0
    assert "low_ocr_confidence" in {f.code for f in rows["scan"].findings} and "low_ocr_confidence" not in {f.code for f in rows["good"].findings}
    assert len(rows["text"].trace_id) == 32 and rows["scan"].document_type == "receipt"


def test_a_trace_counts_what_passes(spark):
    trace = RunTrace()
    rows = trace.span("first", spark.range(10).withColumn("odd", F.col("id") % 2), odd=F.col("odd"))
    trace.span("second", rows.where("odd = 1")).write.format("noop").mode("overwrite").save()
    assert trace.log() == [{"node": "first", "rows": 10, "odd": 5}, {"node": "second", "rows": 5}]


def test_evaluation_of_modes(spark):
    cases = spark.createDataFrame(
        [("a", "synthetic", "receipt", {"receipt_number": "R-1", "total": "5.00"}, None), ("b", "annotated", "form", {}, [["Name", "Ann"], ["Age", "7"]]), ("c", "synthetic", "report", {"title": "T", "date": "2025-01-02"}, None)],
        "case_id string, origin string, doc_type string, ground_truth map<string,string>, pairs array<array<string>>",
    )
    outcomes = spark.createDataFrame(
        [("a", "text", "receipt", "human_review", 0.8, 4, 0.5), ("b", "text", None, "vlm_fallback", 0.1, 9, 0.0), ("c", "text", "form", "human_review", 0.7, 6, 0.0), ("a", "pdf", "receipt", "auto_approve", 0.9, 40, 0.0), ("zz", "pdf", "receipt", "auto_approve", 0.9, 40, 0.0)],
        "case_id string, mode string, predicted_type string, routing string, confidence double, latency_ms int, cost_usd double",
    )
    predicted = spark.createDataFrame([("a", "text", "receipt_number", "r-1"), ("a", "text", "total", "5"), ("a", "text", "vendor", "V"), ("c", "text", "title", "U"), ("b", "text", "form_id", "F"), ("a", "pdf", "total", "6")], "case_id string, mode string, name string, value string")
    pairs = spark.createDataFrame([("b", "text", "name:", "ANN"), ("b", "text", "Sex", "f"), ("a", "text", "x", "y")], "case_id string, mode string, question string, answer string")
    run_ = V.evaluate(cases, outcomes, predicted, pairs)
    by = {r.mode: r for r in run_.summary.collect()}
    assert (by["text"].tp, by["text"].fp, by["text"].fn) == (2, 2, 2) and by["text"].doc_accuracy == 0.5 and by["text"].classifier_accuracy == 0.5
    assert by["text"].cost_usd == 0.5 and by["text"].cost_per_document == 0.25 and by["text"].latency_p95 == 9 and by["text"].documents == 3
    assert (by["pdf"].tp, by["pdf"].fp, by["pdf"].fn, by["pdf"].doc_accuracy) == (0, 1, 2, 0.0) and by["text"].macro_f1 == 0.5
    details = {(r.case_id, r.mode): r for r in run_.details.collect()}
    assert details["a", "text"].f1 == 0.8 and details["a", "text"].wrong == ["vendor"] and details["b", "text"].correct is None and details["c", "text"].missed == ["date", "title"]
    assert [(r.mode, r.tp, r.fp, r.fn) for r in run_.pairs.collect()] == [("text", 1, 1, 1)]
    record = V.run_record("r", run_)
    assert record["headline_mode"] == "pdf" and [w["case_id"] for w in record["worst_cases"]] == ["a"] and json.dumps(record, default=str)
    assert "## By type" in V.report(run_) and V.headline(["text", "scan"]) == "text" and V.headline([]) is None
    empty = V.evaluate(cases.limit(0), outcomes, predicted.limit(0))
    assert empty.summary.count() == 0 and empty.pairs.count() == 0


def test_tables_by_their_rules(spark, tmp_path):
    truth = spark.createDataFrame([("t1", "items", ["a"], [["1"]], True), ("t2", "items", ["b"], [["2"]], False), ("t3", "items", ["c"], [], False)], "table_id string, kind string, headers array<string>, rows array<array<string>>, ruled boolean")
    said = spark.createDataFrame([("t1", 0, ["x"], [["x"]]), ("t1", 1, ["a"], [["1"]]), ("t2", 0, ["b"], [["3"]])], "table_id string, pos int, headers array<string>, rows array<array<string>>")
    summary, each = V.evaluate_tables(said, truth)
    got = {r.ruled: (r.tables, r.detected, r.tp, r.fp, r.fn) for r in summary.collect()}
    assert got == {True: (1, 1, 2, 0, 0), False: (2, 1, 1, 1, 2), None: (3, 2, 3, 1, 2)} and each.count() == 3
    V.write_run(f"{tmp_path}/runs/one.json", {"name": "é"})
    assert json.loads(open(f"{tmp_path}/runs/one.json", encoding="utf-8").read()) == {"name": "é"}


def test_generated_documents_are_the_same_again_and_add_up(spark):
    docs = generate_documents(spark, 40, 7).cache()
    assert docs.count() == 200 == docs.select("case_id").distinct().count() and docs.where("text is null or size(ground_truth) = 0").count() == 0
    again, other = ({r.record for r in as_records(generate_documents(spark, 40, seed).repartition(5)).collect()} for seed in (7, 8))
    records = {r.record for r in as_records(docs).collect()}
    assert records == again and len(records & other) < 100
    assert {(r.doc_type, r.template) for r in docs.select("doc_type", "template").distinct().collect()} == {(t, n) for t, names in TEMPLATES.items() for n in names}
    sums = docs.where("doc_type = 'invoice'").selectExpr("double(ground_truth['total']) - double(ground_truth['subtotal']) - double(ground_truth['tax']) AS gap", "size(notes) AS n", "aggregate(case_table.body_rows, 0d, (a, r) -> a + double(r[3])) - double(ground_truth['subtotal']) AS items").collect()
    assert all(abs(r.gap - 10 * r.n) < 0.005 and abs(r["items"]) < 0.005 for r in sums) and 0 < sum(r.n for r in sums) < 20
    truth = docs.select(F.col("case_id").alias("doc_id"), F.explode("ground_truth").alias("name", "value"))
    found = extract_fields(docs.select(F.col("case_id").alias("doc_id"), "text", "doc_type")).select("doc_id", "name", F.coalesce("value_str", F.col("value_num").cast("string")).alias("value"))
    micro = M.with_prf(M.field_counts(found, truth).agg(*[F.sum(c).alias(c) for c in M.COUNTS])).first()
    assert micro.f1 > 0.7
    wrong = validate_fields(docs.select(F.col("case_id").alias("doc_id"), "doc_type"), truth.join(docs.select(F.col("case_id").alias("doc_id"), "doc_type"), "doc_id").select("doc_id", "doc_type", "name", F.when(~F.col("name").isin("subtotal", "tax", "total"), F.col("value")).alias("value_str"), F.when(F.col("name").isin("subtotal", "tax", "total"), F.col("value").cast("double")).alias("value_num"))).where("code = 'math_mismatch'").count()
    assert wrong == sum(r.n for r in sums)
    assert set(json.loads(as_records(docs).first().record)) >= {"case_id", "text"} and generate_documents(spark, 0).count() == 0


def test_generated_tables(spark):
    tables = generate_tables(spark, 60).collect()
    assert len(tables) == 60 and {t.kind for t in tables} == {"items", "accounts", "schedule"}
    assert all(len(t.headers) == 4 and 2 <= len(t.rows) <= 6 and all(len(r) == 4 and None not in r for r in t.rows) for t in tables)
    assert sum(not t.ruled for t in tables) == 20 and all(len({r[0] for r in t.rows}) == len(t.rows) for t in tables)


def test_the_last_of_a_field_given_twice_counts(spark):
    docs = spark.createDataFrame([("d", "contract")], "doc_id string, doc_type string")
    rows = [("d", "contract", "term_months", None, 900.0, 0), ("d", "contract", "term_months", None, 12.0, 1), ("d", "contract", "effective_date", "2025-01-01", None, 0), ("d", "contract", "effective_date", "1 May", None, 2)]
    codes = {r.code for r in validate_fields(docs, spark.createDataFrame(rows, "doc_id string, doc_type string, name string, value_str string, value_num double, pos int")).collect()}
    assert "implausible_term" not in codes and "non_iso_date" in codes


def test_answers_fall_back_to_the_text(spark):
    good, bad = '{"fields": [{"name": "receipt_number", "value": "R-9"}]}', '{"fields": [{"name": "total", "value": "1", "confidence": 3}]}'
    docs = spark.createDataFrame([(i, "receipt", "Receipt No: R-55", a) for i, a in enumerate([good, bad, "no json", None])], "doc_id int, doc_type string, text string, answer string")
    fields, methods = extract_with_answers(docs)
    assert {(r.doc_id, r.value_str, r.source) for r in fields.collect()} == {(0, "R-9", "extractor"), (1, "R-55", "regex"), (2, "R-55", "regex"), (3, "R-55", "regex")}
    assert {r.doc_id: r.method for r in methods.collect()} == {0: "model", 1: "heuristic_after_bad_answer", 2: "heuristic_after_bad_answer", 3: "heuristic"}
    asked = docs.select(prompt(F.col("doc_type"), F.repeat("text", 2000), 30).alias("p")).first().p
    assert "payment_method" in asked and len(asked) < 300


def test_models_are_asked_again():
    seen = []

    def model(prompts):
        seen.append(1)
        if len(seen) < 3:
            raise TimeoutError
        return prompts + "!"

    assert list(retrying(model, lambda e: isinstance(e, TimeoutError), 3, 0.0)(pd.Series(["a"]))) == ["a!"]
    with pytest.raises(ValueError):
        retrying(lambda p: (_ for _ in ()).throw(ValueError()), lambda e: False)(pd.Series(["a"]))


def test_small_functions(spark, tmp_path):
    row = spark.range(1).select(S.trace_id(F.lit("a")).alias("t"), F.length(S.trace_id()).alias("n"), S.today_iso().alias("d"), S.cost_usd(F.lit(1000), F.lit(200), 3.0, 15.0).alias("c"), S.split_list(F.lit(" a, ,b ,")).alias("l")).first()
    assert row.t == "0cc175b9c0f1b6a831c399e269772661" and row.n == 32 and len(row.d) == 10 and row.c == 0.006 and row.l == ["a", "b"]
    assert [M.clamped(n) for n in (-1, 7, 999)] == [1, 7, 100]
    costs = M.cost_totals(spark.createDataFrame([(0.1, True), (0.2, False), (0.3, True)], "c double, t boolean"), "c", "t").first()
    assert (costs.cost_usd, costs.cost_per_document) == (0.6, 0.3)
    parts = spark.createDataFrame([([("Title", " A "), ("UncategorizedText", "Total: 5"), ("NarrativeText", "so it is"), ("Other", " ")],)], "p array<struct<category:string,text:string>>")
    assert [(e.category, e.text, e.value) for e in parts.select(from_partition(F.col("p")).alias("e")).first().e] == [("Title", "A", None), ("KeyValue", "Total: 5", "5"), ("NarrativeText", "so it is", None)]
    (tmp_path / "x").write_text("abc")
    assert [(r.path, r.sha256[:8]) for r in manifest(spark, [f"file:{tmp_path}/x", f"{tmp_path}/gone", f"{tmp_path}/x"]).collect()] == [(f"file:{tmp_path}/x", "ba7816bf"), (f"{tmp_path}/x", "ba7816bf")]
    assert repository(spark, None)(spark.range(3)) == 0
