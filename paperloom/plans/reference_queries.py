"""Queries of the document operators, each with independent SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.dims import DATE_FIELDS, DOC_TYPES, FIELDS, KEYWORDS, MONTH_NAMES, NIT_WEIGHTS, REQUIRED
from paperloom.functions import scalars as S
from paperloom.operators import forms as G
from paperloom.operators import metrics as M
from paperloom.operators.classify import best_type, keyword_scores
from paperloom.operators.extract import extract_fields, fields_from_answer
from paperloom.operators.layout import explode_elements, key_values, elements
from paperloom.operators.score import input_path, is_scanned, needs_reprocessing, route, score_documents
from paperloom.operators.tables import grid_to_table, n_cells
from paperloom.operators.timestamps import normalise_timestamps
from paperloom.operators.validate import judge_verdict, missing_required, penalize_fields, validate_fields
from paperloom.plans import render as R
from paperloom.plans import evaluation as V
from paperloom.plans.ingest import Readers, extract_tables, ingest
from paperloom.plans.pipeline import Settings, document_results, judge, run, run_scores
from paperloom.session import cut, table
from paperloom.sources.readers import check_pdf, check_text, decode_pdf, document_columns, exactly_one
from paperloom.sources.writers import first_writers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- rendered documents and what is read from them -------------------------------------------------

_NIT = " + ".join(f"(b // {10**k} % 10) * {w}" for k, w in enumerate(NIT_WEIGHTS[:9]))
_FACTS = f"""
WITH items AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS subtotal FROM lineitem GROUP BY l_orderkey),
based AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS issue, subtotal, c_name, o_custkey + 800000000 AS b,
         array_to_string(list_transform(string_split(lower(translate(n_name, '_0123456789', ' ABCDEFGHIJ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS nation,
         CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'COP' END AS currency
  FROM orders JOIN items ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
facts AS (
  SELECT *, nation || ' Trading House' AS vendor, issue + INTERVAL 30 DAY AS due, round(subtotal * 0.19, 2) AS tax,
         subtotal + round(subtotal * 0.19, 2) AS total,
         substr(CAST(b AS VARCHAR), 1, 3) || '.' || substr(CAST(b AS VARCHAR), 4, 3) || '.' || substr(CAST(b AS VARCHAR), 7, 3) || '-' ||
           CAST(CASE WHEN ({_NIT}) % 11 < 2 THEN ({_NIT}) % 11 ELSE 11 - ({_NIT}) % 11 END AS VARCHAR) AS nit
  FROM based)
"""
_AMOUNT = "CAST(CAST({} AS DECIMAL(18,2)) AS VARCHAR)"
_DAY = "strftime({}, '%Y-%m-%d')"


def _eav(**values: str) -> str:
    return _FACTS + " UNION ALL ".join(f"SELECT o_orderkey AS doc_id, '{k}' AS name, {v} AS value FROM facts" for k, v in values.items())


def _values(fields: DataFrame) -> DataFrame:
    text = F.coalesce("value_str", F.when(F.col("name") == "term_months", F.col("value_num").cast("int").cast("string")).otherwise(F.col("value_num").cast("decimal(18,2)").cast("string")))
    return fields.select("doc_id", "name", text.alias("value"))


def _read(spark: SparkSession, d: str, render, doc_type: str) -> DataFrame:
    docs = render(R.order_facts(spark, d)).withColumn("doc_type", F.lit(doc_type))
    return _values(extract_fields(docs))


@query(_eav(invoice_number="'INV-2026-' || o_orderkey", vendor="upper(vendor)", vendor_tax_id="nit", issue_date=_DAY.format("issue"), due_date=_DAY.format("due"), currency="currency", subtotal=_AMOUNT.format("subtotal"), tax=_AMOUNT.format("tax"), total=_AMOUNT.format("total"), payment_terms="'Net 30'"))
def invoice_roundtrip_kv(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, R.invoices_kv, "invoice")


@query(_eav(invoice_number="'FV-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0')", vendor_tax_id="nit", issue_date=_DAY.format("issue"), due_date=_DAY.format("due"), currency="currency", subtotal=_AMOUNT.format("subtotal"), tax=_AMOUNT.format("tax"), total=_AMOUNT.format("total"), payment_terms="'Net 30'"))
def invoice_roundtrip_es(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, R.invoices_es, "invoice")


@query(_eav(invoice_number="'INV-' || o_orderkey || '-X'", vendor="vendor", vendor_tax_id="nit", issue_date=_DAY.format("issue"), due_date=_DAY.format("due"), currency="currency", subtotal=_AMOUNT.format("subtotal"), tax=_AMOUNT.format("tax"), total=_AMOUNT.format("total"), payment_terms="'Net 30'"))
def invoice_roundtrip_block(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, R.invoices_block, "invoice")


@query(_eav(currency="currency", total=_AMOUNT.format("subtotal")))
def invoice_prose_total(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, R.invoices_prose, "invoice")


@query(_eav(receipt_number="'R-' || (o_orderkey + 100)", vendor="vendor", issue_date=_DAY.format("issue"), total=_AMOUNT.format("total"), currency="'USD'", payment_method="CASE o_orderkey % 4 WHEN 0 THEN 'cash' WHEN 1 THEN 'visa' WHEN 2 THEN 'transfer' ELSE 'mastercard' END"))
def receipt_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, R.receipts, "receipt")


@query(_eav(contract_number="'MSA-' || (o_orderkey + 10)", parties="vendor || '; Orion Holdings'", effective_date=_DAY.format("issue"), term_months="CAST(o_orderkey % 36 + 1 AS VARCHAR)", total_value=_AMOUNT.format("total"), currency="currency", governing_law="'State of Delaware'"))
def contract_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, R.contracts, "contract")


@query(_eav(form_id="'F-' || (o_orderkey + 100)", submitter="vendor", date=_DAY.format("issue"), department="'Finance'"))
def form_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, R.forms, "form")


@query(_FACTS + "SELECT count(*) AS n_documents, CAST(0 AS BIGINT) AS n_fields FROM facts")
def form_without_colons(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a key and a value with blanks between them are no pairs: no field is read from any document."""
    docs = R.forms_without_colons(R.order_facts(spark, d)).withColumn("doc_type", F.lit("form"))
    once = extract_fields(docs, with_documents=True)
    return once.agg(F.count_if(F.col("name").isNull()).alias("n_documents"), F.count("name").alias("n_fields"))


@query(_eav(title="'Yearly Summary Of ' || nation", author="c_name", date=_DAY.format("issue"), fiscal_year="CAST(year(issue) AS VARCHAR)"))
def report_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, R.reports, "report")


@query(_FACTS + "SELECT o_orderkey AS doc_id, 'invoice' AS doc_type, CAST(0 AS BIGINT) AS n_errors, CAST(0.866 AS DOUBLE) AS confidence, 'human_review' AS routing FROM facts")
def document_confidence(spark: SparkSession, d: str) -> DataFrame:
    """All stages over rendered invoices: classified, extracted, checked, masked, scored."""
    return run_scores(R.invoices_kv(R.order_facts(spark, d))).select("doc_id", "doc_type", "n_errors", "confidence", "routing")


_CORPUS_TYPES = "CASE o_orderkey % 5 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'contract' WHEN 3 THEN 'form' ELSE 'report' END"


@query(f"SELECT {_CORPUS_TYPES} AS doc_type, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def corpus_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of all rendered documents, by keywords alone."""
    return R.corpus(spark, d).select(best_type(keyword_scores(F.col("text")))["doc_type"].alias("doc_type")).groupBy("doc_type").agg(F.count("*").alias("n"))


@query()
def corpus_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return run_scores(R.corpus(spark, d))


@query()
def routing_histogram(spark: SparkSession, d: str) -> DataFrame:
    scores = run_scores(R.corpus(spark, d))
    return scores.groupBy("doc_type", "routing").agg(F.count("*").alias("n"))


@query()
def case_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields read from the texts of the evaluation cases."""
    docs = table(spark, d, "eval_cases").select(F.col("case_id").alias("doc_id"), "text", "doc_type").distinct()
    return extract_fields(docs)


@query()
def case_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of the fields read from the cases' texts against their truth, by field, by type and overall."""
    cases = table(spark, d, "eval_cases").where("case_id is not null").dropDuplicates(["case_id"])
    docs = cases.select(F.col("case_id").alias("doc_id"), "text", "doc_type")
    truth = cases.select(F.col("case_id").alias("doc_id"), F.explode("ground_truth").alias("name", "value"))
    found = extract_fields(docs).select("doc_id", "name", F.coalesce("value_str", F.col("value_num").cast("string")).alias("value"))
    counts = M.field_counts(found, truth).join(docs.select("doc_id", "doc_type"), "doc_id")
    return M.with_prf(M.sum_counts(counts, [["name"], ["doc_type"], []], ["name", "doc_type"])).drop("grouping")


# --- scalar functions ------------------------------------------------------------------------------


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS iso, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS dmy, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS long, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS text, CASE WHEN day(o_orderdate) > 28 THEN NULL ELSE strftime(make_date(2023, 2, CAST(day(o_orderdate) AS INT)), '%Y-%m-%d') END AS february FROM orders")
def norm_date_styles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("x"))
    styles = {s: S.normalize_date(F.concat(F.lit("dated "), R.day(F.col("x"), s), F.lit("."))) for s in ("iso", "dmy", "long", "text")}
    return rows.select("o_orderkey", *[c.alias(s) for s, c in styles.items()], S.normalize_date(F.concat(F.lit("2023-02-"), F.lpad(F.day("x").cast("string"), 2, "0"))).alias("february"))


@query("SELECT o_custkey % 20 AS source, count(*) AS n, TRUE AS nearly_all_right FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def learned_dates(spark: SparkSession, d: str) -> DataFrame:
    """Twenty sources, every other one month first, read by their neighbours alone: at least 99 % of each must come out right."""
    rows = table(spark, d, "orders").where("o_orderdate is not null").select("o_orderkey", F.to_date("o_orderdate").alias("truth"), (F.col("o_custkey") % 20).alias("source"))
    rows = rows.withColumn("written", F.when(F.col("source") % 2 == 0, F.date_format("truth", "dd/MM/yyyy")).otherwise(F.date_format("truth", "MM/dd/yyyy")))
    read = normalise_timestamps(rows, "written", "source", ["truth", "o_orderkey"], policy="learn")
    right = F.avg(F.when(F.col("written_date") == F.col("truth"), 1.0).otherwise(0.0)) >= 0.99
    return read.groupBy("source").agg(F.count("*").alias("n"), right.alias("nearly_all_right"))


@query("SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS us, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS eu FROM customer")
def norm_amount_us_eu(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("c_acctbal").cast("decimal(18,2)")
    return table(spark, d, "customer").select("c_custkey", S.normalize_amount(F.concat(F.lit("USD "), R.money(x))).alias("us"), S.normalize_amount(R.money(x, "eu")).alias("eu"))


@query("SELECT o_orderkey, CAST(substr(CAST(o_orderkey + 1000 AS VARCHAR), 1, 3) AS DOUBLE) AS compat, CAST(o_orderkey + 1000 AS DOUBLE) AS whole FROM orders")
def norm_amount_plain_runs(spark: SparkSession, d: str) -> DataFrame:
    text = (F.col("o_orderkey") + 1000).cast("string")
    return table(spark, d, "orders").select("o_orderkey", S.normalize_amount(text).alias("compat"), S.normalize_amount(text, compat=False).alias("whole"))


_NIT_CUST = " + ".join(f"((c_custkey + 800000000) // {10**k} % 10) * {w}" for k, w in enumerate(NIT_WEIGHTS[:9]))


@query(f"SELECT c_custkey, CAST(CASE WHEN ({_NIT_CUST}) % 11 < 2 THEN ({_NIT_CUST}) % 11 ELSE 11 - ({_NIT_CUST}) % 11 END AS INTEGER) AS digit, c_custkey % 10 = (CASE WHEN ({_NIT_CUST}) % 11 < 2 THEN ({_NIT_CUST}) % 11 ELSE 11 - ({_NIT_CUST}) % 11 END) AS valid FROM customer")
def nit_digits(spark: SparkSession, d: str) -> DataFrame:
    base = (F.col("c_custkey") + 800_000_000).cast("string")
    return table(spark, d, "customer").select("c_custkey", S.nit_check_digit(base).alias("digit"), S.is_valid_nit(F.concat(base, F.lit("-"), (F.col("c_custkey") % 10).cast("string"))).alias("valid"))


@query("SELECT o_orderkey, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN CAST(n[i] AS INT) > 4 THEN CAST(n[i] AS INT) * 2 - 9 ELSE CAST(n[i] AS INT) * 2 END ELSE CAST(n[i] AS INT) END)) % 10 = 0 AS ok FROM (SELECT o_orderkey, '4242' || lpad(CAST(o_orderkey * 7919 AS VARCHAR), 12, '0') AS n FROM orders)")
def luhn_numbers(spark: SparkSession, d: str) -> DataFrame:
    number = F.concat(F.lit("4242"), F.lpad((F.col("o_orderkey") * 7919).cast("string"), 12, "0"))
    return table(spark, d, "orders").select("o_orderkey", S.luhn_ok(number).alias("ok"))


@query("SELECT case_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS INTEGER) AS n_email, CAST(len(regexp_extract_all(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[REDACTED:email]', 'g'), '\\b\\d{3}-\\d{2}-\\d{4}\\b')) AS INTEGER) AS n_ssn FROM (SELECT DISTINCT case_id, text FROM eval_cases WHERE text IS NOT NULL)")
def pii_counts(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "eval_cases").where("text is not null").select("case_id", "text").distinct()
    return S.mask_pii(texts, "text", "masked").select("case_id", "n_email", "n_ssn")


@query()
def pii_masked(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "eval_cases").select("case_id", "text").distinct()
    return S.mask_pii(texts, "text", "masked").drop("text")


@query("SELECT part.p_partkey, trim(lower(regexp_replace(p_name, '\\s+', ' ', 'g')), ' .,:;-_\"''()') AS plain FROM part")
def norm_text(spark: SparkSession, d: str) -> DataFrame:
    noisy = F.concat(F.lit(" ("), F.regexp_replace(F.upper("p_name"), " ", "  "), F.lit("):. "))
    return table(spark, d, "part").select("p_partkey", S.normalize_text(noisy).alias("plain"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' END AS currency FROM orders")
def currencies_in_text(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 4 == 0, "$ 5 or EUR 4").when(F.col("o_orderkey") % 4 == 1, "£ 3 and $ 4").when(F.col("o_orderkey") % 4 == 2, "£ 3").otherwise("EURO 5")
    return table(spark, d, "orders").select("o_orderkey", S.currency_in_text(text).alias("currency"))


# --- layout and classification ---------------------------------------------------------------------

@query()
def layout_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories of all elements, as the pipeline reads them; a line of several pairs counts once a pair."""
    texts = table(spark, d, "eval_cases").where("text is not null").select(F.col("case_id").alias("doc_id"), "text").distinct()
    return explode_elements(texts).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS doc_id, CAST(p AS INTEGER) AS pos, k AS key, v AS value FROM (SELECT o_orderkey, unnest([0, 1, 2]) AS p, unnest(['To', 'Order', 'Date']) AS k, unnest(['Mr. Smith', CAST(o_orderkey AS VARCHAR), strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d')]) AS v FROM orders)")
def multi_pair_lines(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("To:  Mr. Smith  Order: "), "o_orderkey", F.lit("\tDate:  "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    return explode_elements(docs).select("doc_id", "pos", "key", "value")


def _sql_score(doc_type: str) -> str:
    return "round(" + " + ".join(f"least(len(regexp_extract_all(lower(text), '{p}')), 3) * {w}" for p, w in KEYWORDS[doc_type]) + ", 3)"


@query("SELECT case_id, " + ", ".join(f"CAST({_sql_score(t)} AS DOUBLE) AS {t}" for t in DOC_TYPES) + " FROM (SELECT DISTINCT case_id, text FROM eval_cases WHERE text IS NOT NULL)")
def classify_scores(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "eval_cases").where("text is not null").select("case_id", "text").distinct()
    return texts.select("case_id", keyword_scores(F.col("text")).alias("s")).select("case_id", *[F.element_at("s", F.lit(t)).alias(t) for t in DOC_TYPES])


_SCORED = "WITH s AS (SELECT case_id, " + ", ".join(f"{_sql_score(t)} AS {t}" for t in DOC_TYPES) + " FROM (SELECT DISTINCT case_id, text FROM eval_cases WHERE text IS NOT NULL)), "
_SCORED += "r AS (SELECT case_id, t, sc, row_number() OVER (PARTITION BY case_id ORDER BY sc DESC, o) AS rn FROM (" + " UNION ALL ".join(f"SELECT case_id, '{t}' AS t, {i} AS o, {t} AS sc FROM s" for i, t in enumerate(DOC_TYPES)) + "))"


@query(_SCORED + " SELECT a.case_id, CASE WHEN a.sc > 0 THEN a.t ELSE 'form' END AS doc_type, CASE WHEN a.sc > 0 THEN round(0.35 + 0.6 * least(1.0, (a.sc - b.sc) / greatest(a.sc, 1.0)), 2) ELSE 0.35 END AS confidence FROM r a JOIN r b ON a.case_id = b.case_id AND a.rn = 1 AND b.rn = 2")
def classify_argmax(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "eval_cases").where("text is not null").select("case_id", "text").distinct()
    best = texts.select("case_id", keyword_scores(F.col("text")).alias("s")).select("case_id", best_type(F.col("s")).alias("b"))
    # two digits, so that the third one's rounding of doubles in either engine doesn't show
    return best.select("case_id", "b.doc_type", F.when(F.col("b.confidence") == 0.35, 0.35).otherwise(F.round(F.col("b.confidence"), 2)).alias("confidence"))


ORACLES.pop("classify_argmax")
ORACLES["classify_argmax"] = _SCORED + " SELECT a.case_id, CASE WHEN a.sc > 0 THEN a.t ELSE 'form' END AS doc_type, CASE WHEN a.sc > 0 THEN round(round(0.35 + 0.6 * least(1.0, (a.sc - b.sc) / greatest(a.sc, 1.0)), 3), 2) ELSE 0.35 END AS confidence FROM r a JOIN r b ON a.case_id = b.case_id AND a.rn = 1 AND b.rn = 2"


# --- routing and input -----------------------------------------------------------------------------


def _page_reader(content: bytes) -> list[dict]:
    """A stand-in for a text layer: form feeds part the pages, a tab on a page is a table."""
    text = content.decode().removeprefix("%PDF ")
    return [{"text": t, "confidence": 1.0, "has_tables": "\t" in t} for t in text.split("\f")]


def _ocr_reader(content: bytes) -> list[dict]:
    return [{"text": "recognised " + content.decode().removeprefix("%PDF "), "confidence": 0.5}]


def _grid_reader(content: bytes) -> list[dict]:
    rows = [line.split("\t") for line in content.decode().removeprefix("%PDF ").split("\n") if "\t" in line]
    return [{"page": 1, "cells": rows, "confidence": 0.9}]


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Customers as deliveries: a text, a file with a text layer, one with a table, a scanned file, no PDF, both, nothing."""
    k = F.col("c_custkey") % 7
    said = F.concat(F.lit("Customer file of "), "c_name", F.lit(" with all that is needed"))
    file = F.when(k.isin(1, 5), F.concat(F.lit("%PDF "), said)).when(k == 2, F.concat(F.lit("%PDF "), said, F.lit("\nName\tBalance\n"), "c_name", F.lit("\t1.00"))).when(k == 3, F.lit("%PDF x")).when(k == 4, F.lit("GIF89"))
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.when(k.isin(0, 5), said).alias("text"), file.cast("binary").alias("content"))


_READERS = Readers(text_layer=_page_reader, recognised=_ocr_reader, tables={"lines": _grid_reader})


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CASE c_custkey % 7 WHEN 0 THEN 'raw' WHEN 1 THEN 'text' WHEN 2 THEN 'text' WHEN 3 THEN 'ocr' WHEN 4 THEN 'text' ELSE 'raw' END AS source, CASE c_custkey % 7 WHEN 3 THEN 'ocr' ELSE 'text' END AS pipeline_used, c_custkey % 7 = 2 AS has_tables, CASE c_custkey % 7 WHEN 4 THEN 'invalid_pdf' WHEN 5 THEN 'not_one_input' WHEN 6 THEN 'not_one_input' END AS error_code FROM customer")
def ingested_inputs(spark: SparkSession, d: str) -> DataFrame:
    """What is delivered through checks, readers and the route."""
    return ingest(_deliveries(spark, d), _READERS).select("doc_id", "source", "pipeline_used", "has_tables", "error_code")


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CAST(1 AS INTEGER) AS page, 'Name,Balance' AS headers, c_name AS first_cell, CAST(0.9 AS DOUBLE) AS confidence, 'lines' AS backend FROM customer WHERE c_custkey % 7 = 2")
def gated_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables, of the files whose text layer shows one."""
    docs = _deliveries(spark, d)
    found = extract_tables(docs, ingest(docs, _READERS), _READERS)
    return found.select("doc_id", "page", F.array_join("headers", ",").alias("headers"), F.get(F.get("rows", F.lit(0)), F.lit(0)).alias("first_cell"), "confidence", "backend")


@query("SELECT md5(CAST(c_custkey AS VARCHAR)) AS trace_id, CASE c_custkey % 7 WHEN 3 THEN 'ocr' ELSE 'text' END AS pipeline_used, CAST(CASE WHEN c_custkey % 7 = 2 THEN 1 ELSE 0 END AS INTEGER) AS n_tables, c_custkey % 7 = 3 AS hardly_read FROM customer WHERE c_custkey % 7 < 4")
def ingested_results(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries through all stages to result rows: files with tables keep them, pages hardly recognised have a warning."""
    docs = _deliveries(spark, d)
    read = cut(ingest(docs, _READERS))
    rows = document_results(run(read), extract_tables(docs, read, _READERS))
    return rows.select("trace_id", "pipeline_used", F.size("tables").alias("n_tables"), F.exists("findings", lambda f: f["code"] == "low_ocr_confidence").alias("hardly_read"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'vlm' WHEN event_id % 5 = 0 THEN 'text' WHEN event_id % 7 = 0 AND event_id % 4 <> 0 THEN 'ocr' WHEN event_id % 7 = 0 AND event_id % 3 = 0 THEN 'vlm' ELSE 'text' END AS path, event_id % 11 > 8 AND event_id % 3 = 0 AND event_id % 13 > 3 AS again FROM events")
def input_routes(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    path = input_path(e % 2 == 0, e % 3 == 0, e % 4 != 0, e % 5 != 0, e % 7 == 0)
    routing = route(F.lit(1.0) - F.when(e % 11 > 8, 0.5).otherwise(0.0))
    return table(spark, d, "events").select("event_id", path.alias("path"), needs_reprocessing(routing, F.lit(False), e % 3 == 0, F.when(e % 13 > 3, 2)).alias("again"))


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty' WHEN length(text) > 5000 THEN 'oversized' END AS text_error, length(trim(coalesce(text, ''), ' ')) > 0 AS one_given FROM documents")
def input_checks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", check_text(F.col("text"), 5000).alias("text_error"), exactly_one(F.col("text"), F.lit(None)).alias("one_given"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'empty' WHEN 1 THEN NULL WHEN 2 THEN 'invalid_pdf' WHEN 3 THEN 'invalid_pdf' ELSE 'oversized' END AS error_code FROM customer")
def encoded_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    good = F.base64(F.concat(F.lit("%PDF-1.4 "), F.col("c_name")).cast("binary"))
    text = F.when(k == 0, "  ").when(k == 1, F.concat(F.lit("data:application/pdf;base64,"), good)).when(k == 2, "not base64 !").when(k == 3, F.base64(F.lit("hello").cast("binary"))).otherwise(F.repeat(F.lit("QUFB"), 200))
    return table(spark, d, "customer").select("c_custkey", decode_pdf(text, 300)["error_code"].alias("error_code"))


@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS n_text, CAST(2 AS INTEGER) AS n_pages, CAST(0.75 AS DOUBLE) AS mean_confidence FROM (SELECT doc_id, upper(source) || chr(10) || chr(10) || lang AS text FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)")
def document_pages(spark: SparkSession, d: str) -> DataFrame:
    page = lambda n, t, c: F.struct(F.lit(n).alias("number"), t.alias("text"), F.lit(c).alias("confidence"))
    docs = table(spark, d, "documents").where("source is not null and lang is not null").select("doc_id", F.array(page(1, F.upper("source"), 1.0), page(2, F.col("lang"), 0.5)).alias("pages"))
    return docs.withColumns(document_columns(F.col("pages"))).select("doc_id", F.length("text").alias("n_text"), "n_pages", "mean_confidence")


@query()
def document_pii_masked(spark: SparkSession, d: str) -> DataFrame:
    """The long texts with personal data masked, and the counts of all kinds."""
    return S.mask_pii(table(spark, d, "documents").select("doc_id", "text"), "text", "masked").drop("text")


@query()
def document_pii_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all kinds of personal data in the long texts."""
    return S.mask_pii(table(spark, d, "documents").select("doc_id", "text"), "text", "masked").drop("text", "masked")


@query()
def document_text_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every text as pages cut at its form feeds, read as a document; a null text has no page."""
    pages = F.transform(F.split("text", "\f"), lambda t, i: F.struct((i + 1).cast("int").alias("number"), t.alias("text"), F.lit(1.0).alias("confidence")))
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(pages, F.slice(F.array(F.struct(F.lit(1).alias("number"), F.lit("").alias("text"), F.lit(1.0).alias("confidence"))), 1, 0)).alias("pages"))
    return docs.withColumns(document_columns(F.col("pages"))).select("doc_id", F.length("text").alias("n_text"), "n_pages", "mean_confidence")


@query()
def document_scores(spark: SparkSession, d: str) -> DataFrame:
    """All stages over the long texts."""
    return run(table(spark, d, "documents").select("doc_id", "text")).scores


# --- validation ------------------------------------------------------------------------------------


def _invoice_fields(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The invoices as stored, one whole row of each trace_id (the least), as documents and their fields."""
    names = FIELDS["invoice"]
    rows = table(spark, d, "invoices").where("trace_id is not null").groupBy("trace_id").agg(F.min(F.struct(*names)).alias("r")).select("trace_id", "r.*")
    docs = rows.select(F.col("trace_id").alias("doc_id"), F.lit("invoice").alias("doc_type"))
    numbers = ("subtotal", "tax", "total")
    entries = [F.struct(F.lit(c).alias("name"), (F.lit(None) if c in numbers else F.col(c)).cast("string").alias("value_str"), (F.col(c) if c in numbers else F.lit(None)).cast("double").alias("value_num")) for c in names]
    fields = rows.select(F.col("trace_id").alias("doc_id"), F.lit("invoice").alias("doc_type"), F.explode(F.array(*entries)).alias("e")).select("doc_id", "doc_type", "e.*", F.lit(0.9).alias("confidence"), F.lit("regex").alias("source"))
    return docs, fields.where("value_str is not null or value_num is not null")


_INV = "WITH inv AS (SELECT trace_id AS doc_id, " + ", ".join(FIELDS["invoice"]) + " FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY " + ", ".join(f"{c} NULLS FIRST" for c in FIELDS["invoice"]) + ") AS rn FROM invoices WHERE trace_id IS NOT NULL) WHERE rn = 1) "
_ISO = r"'^\d{4}-\d{2}-\d{2}$'"


def _codes(spark: SparkSession, d: str, *codes: str) -> DataFrame:
    docs, fields = _invoice_fields(spark, d)
    return validate_fields(docs, fields).where(F.col("code").isin(*codes)).select("doc_id", "severity", "code", "field")


@query(_INV + " UNION ALL ".join(f"SELECT doc_id, 'error' AS severity, 'missing_required' AS code, '{c}' AS field FROM inv WHERE {c} IS NULL" + ("" if c in ("subtotal", "tax", "total") else f" OR {c} = ''") for c in REQUIRED["invoice"]))
def check_required(spark: SparkSession, d: str) -> DataFrame:
    return _codes(spark, d, "missing_required")


@query(_INV + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS field FROM inv WHERE {c} IS NULL" + ("" if c in ("subtotal", "tax", "total") else f" OR {c} = ''") for c in REQUIRED["invoice"]))
def missing_by_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return missing_required(*_invoice_fields(spark, d))


@query(_INV + "SELECT doc_id, 'error' AS severity, 'math_mismatch' AS code, 'total' AS field FROM inv WHERE abs(round(subtotal + tax, 2) - total) > 0.05")
def check_invoice_sums(spark: SparkSession, d: str) -> DataFrame:
    return _codes(spark, d, "math_mismatch")


@query(_INV + f"SELECT doc_id, 'error' AS severity, 'due_before_issue' AS code, 'due_date' AS field FROM inv WHERE regexp_matches(issue_date, {_ISO}) AND regexp_matches(due_date, {_ISO}) AND TRY_CAST(due_date AS DATE) < TRY_CAST(issue_date AS DATE)")
def check_date_order(spark: SparkSession, d: str) -> DataFrame:
    return _codes(spark, d, "due_before_issue")


@query(_INV + " UNION ALL ".join(f"SELECT doc_id, CASE WHEN regexp_matches({c}, {_ISO}) THEN 'error' ELSE 'warn' END AS severity, CASE WHEN regexp_matches({c}, {_ISO}) THEN 'invalid_date' ELSE 'non_iso_date' END AS code, '{c}' AS field FROM inv WHERE {c} IS NOT NULL AND (NOT regexp_matches({c}, {_ISO}) OR TRY_CAST({c} AS DATE) IS NULL)" for c in ("issue_date", "due_date")))
def check_iso_dates(spark: SparkSession, d: str) -> DataFrame:
    return _codes(spark, d, "non_iso_date", "invalid_date")


@query(_INV + " UNION ALL ".join([f"SELECT doc_id, 'warn' AS severity, 'negative_amount' AS code, '{c}' AS field FROM inv WHERE {c} < 0" for c in ("subtotal", "tax", "total")] + ["SELECT doc_id, 'warn', 'invalid_currency_code', 'currency' FROM inv WHERE NOT regexp_matches(currency, '^[A-Z]{3}$')"]))
def check_amounts(spark: SparkSession, d: str) -> DataFrame:
    return _codes(spark, d, "negative_amount", "invalid_currency_code")


_BASE = "reverse(regexp_extract(bare, '^(\\d{6,10})[-\\s]?(\\d)$', 1))"
_CHECK = f"list_sum(list_transform(range(1, len({_BASE}) + 1), lambda i: CAST({_BASE}[i] AS INT) * {list(NIT_WEIGHTS)}[i])) % 11"


@query(_INV + f", b AS (SELECT doc_id, vendor_tax_id AS v, replace(replace(vendor_tax_id, '.', ''), ' ', '') AS bare FROM inv WHERE vendor_tax_id IS NOT NULL), k AS (SELECT *, regexp_matches(bare, '^\\d{{6,10}}[-\\s]?\\d$') AS nit, CASE WHEN regexp_matches(bare, '^\\d{{6,10}}[-\\s]?\\d$') THEN {_CHECK} END AS r FROM b) SELECT doc_id, CASE WHEN nit THEN 'error' ELSE 'warn' END AS severity, CASE WHEN nit THEN 'invalid_nit_check_digit' ELSE 'implausible_tax_id' END AS code, 'vendor_tax_id' AS field FROM k WHERE (nit AND CAST(right(bare, 1) AS INT) <> CASE WHEN r < 2 THEN r ELSE 11 - r END) OR (NOT nit AND NOT regexp_matches(v, '(?i)^[A-Z0-9][A-Z0-9./ -]{{4,24}}$'))")
def check_tax_ids(spark: SparkSession, d: str) -> DataFrame:
    return _codes(spark, d, "invalid_nit_check_digit", "implausible_tax_id")


@query("SELECT trace_id AS doc_id, 'warn' AS severity, 'implausible_term' AS code, 'term_months' AS field FROM (SELECT trace_id, max(term_months) AS t FROM contracts WHERE trace_id IS NOT NULL GROUP BY trace_id) WHERE t <= 0 OR t > 600")
def check_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "contracts").where("trace_id is not null").groupBy(F.col("trace_id").alias("doc_id")).agg(F.max("term_months").cast("double").alias("value_num"))
    docs = rows.select("doc_id", F.lit("contract").alias("doc_type"))
    fields = rows.select("doc_id", F.lit("contract").alias("doc_type"), F.lit("term_months").alias("name"), F.lit(None).cast("string").alias("value_str"), "value_num")
    return validate_fields(docs, fields).where("code = 'implausible_term'").select("doc_id", "severity", "code", "field")


_MONTH = "CASE " + " ".join(f"WHEN lower({{0}}) IN ({', '.join(repr(n) for n in names)}) THEN {i}" for i, names in enumerate(MONTH_NAMES, 1)) + " END"


def _sql_date(v: str) -> str:
    """The date in a text, by the forms the scalar reads, in their order."""
    iso, numbers = r"\b(\d{4})-(\d{2})-(\d{2})\b", r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b"
    named, days = r"\b([A-Za-z]{3,10})\.?\s+(\d{1,2}),?\s+(\d{4})\b", r"\b(\d{1,2})\s+(?:de\s+)?([A-Za-z]{3,10})\.?,?\s+(?:de\s+)?(\d{4})\b"
    part = lambda p, i: f"TRY_CAST(regexp_extract({v}, '{p}', {i}) AS INTEGER)"
    word = lambda p, i: _MONTH.format(f"regexp_extract({v}, '{p}', {i})")
    made = lambda y, m, x: f"TRY_CAST(printf('%04d-%02d-%02d', {y}, {m}, {x}) AS DATE)"
    swap = f"({part(numbers, 2)} > 12 AND {part(numbers, 1)} <= 12)"
    month, day_ = f"CASE WHEN {swap} THEN {part(numbers, 1)} ELSE {part(numbers, 2)} END", f"CASE WHEN {swap} THEN {part(numbers, 2)} ELSE {part(numbers, 1)} END"
    return (
        f"CASE WHEN regexp_matches({v}, '{iso}') THEN {made(part(iso, 1), part(iso, 2), part(iso, 3))} WHEN regexp_matches({v}, '{numbers}') THEN {made(part(numbers, 3), month, day_)}"
        f" WHEN {word(named, 1)} IS NOT NULL THEN {made(part(named, 3), word(named, 1), part(named, 2))} WHEN {word(days, 2)} IS NOT NULL THEN {made(part(days, 3), word(days, 2), part(days, 1))} END"
    )


@query(_INV + f", n AS (SELECT doc_id, {_sql_date('issue_date')} AS a, {_sql_date('due_date')} AS b FROM inv) SELECT doc_id, 'error' AS severity, 'due_before_issue' AS code, 'due_date' AS field FROM n WHERE b < a")
def check_read_date_order(spark: SparkSession, d: str) -> DataFrame:
    """The order of dates as an extraction reads them: in whatever form they are written, then compared."""
    docs, fields = _invoice_fields(spark, d)
    read = F.when(F.col("name").isin(*DATE_FIELDS), S.normalize_date(F.col("value_str"))).otherwise(F.col("value_str"))
    return validate_fields(docs, fields.withColumn("value_str", read)).where("code = 'due_before_issue'").select("doc_id", "severity", "code", "field")


def _sql_scores(findings: str, fields: str, n_required: int) -> str:
    """Scores from relations f (doc_id, severity, field) and v (doc_id, n fields, have, and the fields' names)."""
    return f""", f AS ({findings}), v AS ({fields}),
e AS (SELECT doc_id, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warn') AS n_warnings, count(DISTINCT CASE WHEN severity = 'error' THEN field END) AS named FROM f GROUP BY doc_id),
g AS (SELECT f.doc_id, count(DISTINCT f.field) AS flagged FROM f JOIN v ON f.doc_id = v.doc_id WHERE severity = 'error' AND list_contains(v.names, f.field) GROUP BY f.doc_id),
s AS (SELECT v.doc_id, coalesce(CAST(CAST(n * 0.9 - coalesce(flagged, 0) * 0.3 AS DECIMAL(10,3)) AS DOUBLE) / nullif(n, 0), 0.0) AS mean_confidence, have / {n_required} AS coverage, coalesce(n_errors, 0) AS n_errors, coalesce(n_warnings, 0) AS n_warnings
  FROM v LEFT JOIN e ON e.doc_id = v.doc_id LEFT JOIN g ON g.doc_id = v.doc_id),
c AS (SELECT *, greatest(0, least(1, mean_confidence * (0.5 + 0.5 * coverage) - 0.10 * n_errors - 0.03 * n_warnings)) AS raw FROM s)"""


_INVOICE_CODES = ("check_required", "check_invoice_sums", "check_iso_dates", "check_amounts", "check_tax_ids", "check_date_order")
_INVOICE_FINDINGS = " UNION ALL ".join(f"SELECT doc_id, severity, field FROM ({ORACLES[c]})" for c in _INVOICE_CODES)
_GIVEN = "list_filter([" + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{c}' END" for c in FIELDS["invoice"]) + "], lambda x: x IS NOT NULL)"
_HAVE = " + ".join(f"CAST(coalesce(CAST({c} AS VARCHAR), '') <> '' AS INTEGER)" for c in REQUIRED["invoice"])


# a hundredth more or less than a bound of the routing is left to either engine's rounding of doubles
@query(_INV + _sql_scores(_INVOICE_FINDINGS, f"SELECT doc_id, {_GIVEN} AS names, len({_GIVEN}) AS n, {_HAVE} AS have FROM inv", len(REQUIRED["invoice"])) + " SELECT doc_id, CAST(n_errors AS BIGINT) AS n_errors, CAST(n_warnings AS BIGINT) AS n_warnings, round(coverage, 6) AS coverage, CAST(round(raw * 100 + 0.0001) AS INTEGER) AS percent FROM c")
def invoice_scores(spark: SparkSession, d: str) -> DataFrame:
    """Checks, lowered confidences and scores of the invoices as stored, the confidence in whole percents."""
    docs, fields = _invoice_fields(spark, d)
    findings = validate_fields(docs, fields)
    scores = score_documents(docs, penalize_fields(fields, findings), findings)
    return scores.select("doc_id", "n_errors", "n_warnings", F.round("coverage", 6).alias("coverage"), _percent(F.col("mean_confidence"), F.col("coverage"), F.col("n_errors"), F.col("n_warnings")).alias("percent"))


def _percent(mean: Column, coverage: Column, errors: Column, warnings: Column) -> Column:
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean * (0.5 + 0.5 * coverage) - 0.10 * errors - 0.03 * warnings))
    return F.round(raw * 100 + 0.0001).cast("int")


_JUDGED_FINDINGS = """
SELECT o_orderkey AS doc_id, 'error' AS severity, 'receipt_number' AS field FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'warn', 'issue_date' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'error', 'issue_date' FROM orders WHERE o_orderkey % 5 = 1
UNION ALL SELECT o_orderkey, 'warn', 'total' FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'error', 'total' FROM orders WHERE o_orderkey % 7 = 1
UNION ALL SELECT o_orderkey, 'warn', 'currency' FROM orders WHERE o_orderkey % 11 = 0"""
_JUDGED_FIELDS = "SELECT o_orderkey AS doc_id, list_filter([CASE WHEN o_orderkey % 3 <> 0 THEN 'receipt_number' END, 'vendor', 'issue_date', 'total', 'currency', 'payment_method'], lambda x: x IS NOT NULL) AS names, CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE 6 END AS n, CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE 6 END AS have FROM orders"


@query("WITH k AS (SELECT 1)" + _sql_scores(_JUDGED_FINDINGS, _JUDGED_FIELDS, 6) + " SELECT doc_id, CAST(n_errors AS BIGINT) AS n_errors, CAST(n_warnings AS BIGINT) AS n_warnings, round(coverage, 6) AS coverage, CAST(round(raw * 100 + 0.0001) AS INTEGER) AS percent, CASE WHEN round(raw, 3) >= 0.9 THEN 'auto_approve' WHEN round(raw, 3) >= 0.7 THEN 'human_review' ELSE 'vlm_fallback' END AS routing FROM c")
def judged_orders(spark: SparkSession, d: str) -> DataFrame:
    """Receipts with missing, malformed and impossible fields through checks, lowering, masking, scoring and routing."""
    k = F.col("o_orderkey")
    text = lambda n, c: F.struct(F.lit(n).alias("name"), c.cast("string").alias("value_str"), F.lit(None).cast("double").alias("value_num"))
    number = lambda n, c: F.struct(F.lit(n).alias("name"), F.lit(None).cast("string").alias("value_str"), c.cast("double").alias("value_num"))
    total = F.when(k % 7 == 1, text("total", F.lit("n/a"))).otherwise(number("total", F.when(k % 7 == 0, -5.0).otherwise(5.0)))
    entries = F.array(
        text("receipt_number", F.when(k % 3 != 0, F.concat(F.lit("R-"), k))),
        text("vendor", F.lit("Mill House")),
        text("issue_date", F.when(k % 5 == 0, "01/02/2024").when(k % 5 == 1, "2024-13-01").otherwise("2024-02-01")),
        total,
        text("currency", F.when(k % 11 == 0, "usd").otherwise("USD")),
        text("payment_method", F.lit("cash")),
    )
    rows = table(spark, d, "orders").select(k.alias("doc_id"), F.lit("receipt").alias("doc_type"), F.explode(entries).alias("e"))
    fields = rows.select("doc_id", "doc_type", "e.*", F.lit(0.9).alias("confidence"), F.lit("regex").alias("source")).where("value_str is not null or value_num is not null")
    _, _, scores = judge(table(spark, d, "orders").select(k.alias("doc_id"), F.lit("receipt").alias("doc_type")), fields, Settings())
    percent = _percent(F.col("mean_confidence"), F.col("coverage"), F.col("n_errors"), F.col("n_warnings"))
    return scores.select("doc_id", "n_errors", "n_warnings", F.round("coverage", 6).alias("coverage"), percent.alias("percent"), "routing")


# --- evaluation ------------------------------------------------------------------------------------


def _graded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Predicted and true fields of the orders; some predictions are wrong and some are missing."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("doc_id"), F.concat(F.lit("INV-"), k).alias("invoice_number"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("issue_date"))
    entry = lambda n, c: F.struct(F.lit(n).alias("name"), c.cast("string").alias("value"))
    truth = rows.select("doc_id", F.explode(F.array(*[entry(n, F.col(n)) for n in ("invoice_number", "total", "issue_date")])).alias("e")).select("doc_id", "e.*")
    said = [
        entry("invoice_number", F.when(F.col("doc_id") % 3 != 0, F.col("invoice_number"))),
        entry("total", F.when(F.col("doc_id") % 5 == 0, F.col("total") + 10).otherwise(F.col("total"))),
        entry("issue_date", F.when(F.col("doc_id") % 7 != 0, F.col("issue_date"))),
        entry("vendor", F.when(F.col("doc_id") % 11 == 0, F.lit("X"))),
    ]
    predicted = rows.select("doc_id", F.explode(F.array(*said)).alias("e")).select("doc_id", "e.*").where("value is not null")
    return predicted, truth


_GRADED = """WITH c AS (
 SELECT o_orderkey AS doc_id, 'invoice_number' AS name, CAST(o_orderkey % 3 <> 0 AS INT) AS tp, 0 AS fp, CAST(o_orderkey % 3 = 0 AS INT) AS fn FROM orders
 UNION ALL SELECT o_orderkey, 'total', CAST(o_orderkey % 5 <> 0 AS INT), CAST(o_orderkey % 5 = 0 AS INT), CAST(o_orderkey % 5 = 0 AS INT) FROM orders
 UNION ALL SELECT o_orderkey, 'issue_date', CAST(o_orderkey % 7 <> 0 AS INT), 0, CAST(o_orderkey % 7 = 0 AS INT) FROM orders
 UNION ALL SELECT o_orderkey, 'vendor', 0, 1, 0 FROM orders WHERE o_orderkey % 11 = 0) """
_PRF = "round(coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0), 4) AS precision, round(coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0), 4) AS recall, round(coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0), 4) AS f1"


@query(_GRADED + f"SELECT name, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, {_PRF} FROM c GROUP BY GROUPING SETS ((name), ())")
def field_prf(spark: SparkSession, d: str) -> DataFrame:
    return M.with_prf(M.sum_counts(M.field_counts(*_graded(spark, d)), [["name"], []], ["name"])).drop("grouping")


@query(_GRADED + ", f AS (SELECT name, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f FROM c GROUP BY name HAVING sum(tp) + sum(fn) > 0) SELECT round(avg(f), 4) AS macro_f1 FROM f")
def field_macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return M.macro_f1(M.field_counts(*_graded(spark, d)))


@query(_GRADED + "SELECT round(avg(CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN 1.0 ELSE 0.0 END), 4) AS doc_accuracy FROM orders")
def document_accuracy(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("invoice").alias("doc_type"))
    return M.accuracy(M.documents_correct(M.field_counts(*_graded(spark, d)), docs), "correct", "doc_accuracy")


@query(_GRADED + ", s AS (SELECT doc_id, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f1, (doc_id % 100) / 100 AS confidence FROM c GROUP BY doc_id) SELECT doc_id, round(f1, 6) AS f1, confidence FROM s ORDER BY s.f1, confidence, doc_id LIMIT 10")
def worst_documents(spark: SparkSession, d: str) -> DataFrame:
    counts = M.field_counts(*_graded(spark, d)).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in M.COUNTS])
    scored = counts.select("doc_id", M.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"), ((F.col("doc_id") % 100) / 100).alias("confidence"))
    return M.worst_cases(scored, 10).withColumn("f1", F.round("f1", 6))


@query(_GRADED + "SELECT doc_id, coalesce(string_agg(CASE WHEN fn > 0 THEN name END, ',' ORDER BY name), '') AS missed, coalesce(string_agg(CASE WHEN fp > 0 THEN name END, ',' ORDER BY name), '') AS wrong FROM c GROUP BY doc_id")
def missed_and_wrong_fields(spark: SparkSession, d: str) -> DataFrame:
    found = M.missed_and_wrong(M.field_counts(*_graded(spark, d)))
    return found.select("doc_id", F.array_join("missed", ",").alias("missed"), F.array_join("wrong", ",").alias("wrong"))


# Two modes: text as graded; pdf, which reads the total only, and that right.
_MODES = _GRADED + """, m AS (SELECT 'text' AS mode, * FROM c
 UNION ALL SELECT 'pdf', doc_id, name, CAST(name = 'total' AS INT), 0, CAST(name <> 'total' AS INT) FROM c WHERE name <> 'vendor') """


def _evaluation(spark: SparkSession, d: str) -> V.Evaluation:
    predicted, truth = _graded(spark, d)
    cases = truth.groupBy(F.col("doc_id").alias("case_id")).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("ground_truth"))
    cases = cases.select("case_id", F.when(F.col("case_id") % 2 == 0, "synthetic").otherwise("annotated").alias("origin"), F.lit("invoice").alias("doc_type"), "ground_truth")
    k = F.col("case_id")
    said = predicted.select(F.col("doc_id").alias("case_id"), F.lit("text").alias("mode"), "name", "value")
    right = truth.where("name = 'total'").select(F.col("doc_id").alias("case_id"), F.lit("pdf").alias("mode"), "name", "value")
    outcomes = cases.select("case_id", F.explode(F.array(F.lit("text"), F.lit("pdf"))).alias("mode")).select(
        "case_id", "mode", F.when(k % 4 == 0, "receipt").otherwise("invoice").alias("predicted_type"), F.when(k % 3 == 0, "auto_approve").otherwise("human_review").alias("routing"),
        ((k % 100) / 100).alias("confidence"), (k % 50).alias("latency_ms"), (k % 7 * F.lit("0.001").cast("decimal(6,3)")).cast("double").alias("cost_usd"),
    )
    return V.evaluate(cases, outcomes, said.unionByName(right))


@query(
    _MODES
    + f""", micro AS (SELECT mode, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, {_PRF} FROM m GROUP BY mode),
macro AS (SELECT mode, round(avg(f), 4) AS macro_f1 FROM (SELECT mode, name, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f FROM m GROUP BY mode, name HAVING sum(tp) + sum(fn) > 0) GROUP BY mode),
k AS (SELECT o_orderkey AS k, unnest(['text', 'pdf']) AS mode FROM orders),
a AS (SELECT mode, count(*) AS documents, round(avg(CASE WHEN mode = 'text' AND k % 3 <> 0 AND k % 5 <> 0 AND k % 7 <> 0 THEN 1.0 ELSE 0.0 END), 4) AS doc_accuracy,
  round(avg(CASE WHEN k % 4 <> 0 THEN 1.0 ELSE 0.0 END), 4) AS classifier_accuracy, round(CAST(sum(k % 7) AS DOUBLE) / 1000, 6) AS cost_usd, round(sum(k % 7) / 1000 / count(*), 6) AS cost_per_document FROM k GROUP BY mode)
SELECT * FROM a JOIN micro USING (mode) JOIN macro USING (mode)"""
)
def evaluation_by_mode(spark: SparkSession, d: str) -> DataFrame:
    """A run of two modes over the same cases: accuracies, costs and figures of the fields for each."""
    return _evaluation(spark, d).summary.drop("latency_mean", "latency_p50", "latency_p95")


@query(_MODES + f"SELECT mode, name, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, {_PRF} FROM m GROUP BY mode, name")
def evaluation_by_field(spark: SparkSession, d: str) -> DataFrame:
    return _evaluation(spark, d).by_field


@query(_MODES + "SELECT doc_id AS case_id, mode, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 4) AS f1, coalesce(string_agg(CASE WHEN fn > 0 THEN name END, ',' ORDER BY name), '') AS missed, coalesce(string_agg(CASE WHEN fp > 0 THEN name END, ',' ORDER BY name), '') AS wrong FROM m GROUP BY doc_id, mode")
def evaluation_details(spark: SparkSession, d: str) -> DataFrame:
    rows = _evaluation(spark, d).details
    return rows.select("case_id", "mode", "f1", F.array_join("missed", ",").alias("missed"), F.array_join("wrong", ",").alias("wrong"))


@query("SELECT count(*) AS documents, count(*) FILTER (origin = 'synthetic') AS synthetic, count(*) FILTER (origin <> 'synthetic') AS annotated, (SELECT count(DISTINCT case_id) FROM eval_cases WHERE case_table IS NOT NULL) AS tables FROM (SELECT DISTINCT case_id, origin FROM eval_cases WHERE case_id IS NOT NULL)")
def evaluation_dataset(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "eval_cases").where("case_id is not null")
    return V.dataset_counts(cases.select("case_id", "origin").distinct(), cases.where("case_table is not null").select("case_id").distinct())


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "eval_cases").where("pairs is not null").select("case_id", "pairs").distinct()
    return cases.select(F.col("case_id").alias("doc_id"), F.explode("pairs").alias("p")).select("doc_id", F.get("p", F.lit(0)).alias("question"), F.get("p", F.lit(1)).alias("answer"))


_CLEAN = "trim(lower(trim(regexp_replace({}, '\\s+', ' ', 'g'))), ' .,:;-_\"''()')"
_PAIRS = f"WITH p AS (SELECT DISTINCT case_id AS doc_id, {_CLEAN.format('pair[1]')} AS q, {_CLEAN.format('pair[2]')} AS a FROM (SELECT case_id, unnest(pairs) AS pair FROM (SELECT DISTINCT case_id, pairs FROM eval_cases WHERE pairs IS NOT NULL))) "


@query(_PAIRS + "SELECT doc_id, CAST(sum(CASE WHEN length(q) % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, CAST(sum(CASE WHEN length(q) % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM p WHERE q IS NOT NULL AND a IS NOT NULL GROUP BY doc_id")
def pair_prf(spark: SparkSession, d: str) -> DataFrame:
    """Predicted are the pairs whose question has an even length, in capitals."""
    truth = _pairs(spark, d).where("question is not null and answer is not null")
    predicted = truth.where(F.length(S.normalize_text(F.col("question"))) % 2 == 0).select("doc_id", F.upper("question").alias("question"), F.concat(F.lit("  "), F.upper("answer"), F.lit(".")).alias("answer"))
    return M.pair_counts(predicted, truth)


@query("SELECT case_id AS doc_id, trim(pair[1]) AS question, trim(pair[2]) AS answer FROM (SELECT case_id, unnest(pairs) AS pair FROM (SELECT DISTINCT case_id, pairs FROM eval_cases WHERE pairs IS NOT NULL)) WHERE trim(pair[1]) <> '' AND trim(pair[2]) <> ''")
def form_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs as an annotated form with links from questions to answers, and back."""
    cases = table(spark, d, "eval_cases").where("pairs is not null").select("case_id", "pairs").distinct()
    entity = lambda i, text, label, link: F.struct(i.cast("int").alias("id"), text.alias("text"), F.array(F.lit(0), F.lit(0), F.lit(9), F.lit(9)).alias("box"), F.lit(label).alias("label"), link.alias("linking"))
    link = lambda i: F.array(F.array((i * 2).cast("int"), (i * 2 + 1).cast("int")))
    questions = F.transform("pairs", lambda p, i: entity(i * 2, F.get(p, F.lit(0)), "question", link(i)))
    answers = F.transform("pairs", lambda p, i: entity(i * 2 + 1, F.get(p, F.lit(1)), "answer", link(i)))
    forms = cases.select(F.col("case_id").alias("doc_id"), F.concat(questions, answers).alias("form"))
    return G.linked_pairs(G.explode_entities(forms))


def _tables(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_cases").where("case_table is not null and case_table.headers is not null").select("case_id", "case_table.headers", F.col("case_table.body_rows").alias("rows"))
    return rows.where("size(rows) > 0").distinct().select(F.col("case_id").alias("table_id"), "headers", "rows")


_TABLES = "WITH t AS (SELECT DISTINCT case_id AS table_id, case_table.headers AS headers, case_table.body_rows AS body FROM eval_cases WHERE case_table IS NOT NULL AND case_table.headers IS NOT NULL AND len(case_table.body_rows) > 0), "
_FILLED = f"len(list_filter({{}}, lambda x: {_CLEAN.format('x')} <> ''))"


@query(_TABLES + f"n AS (SELECT table_id, {_FILLED.format('flatten(list_concat([headers], body))')} AS every, {_FILLED.format('body[len(body)]')} AS last FROM t) SELECT table_id, CAST(every - last AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, CAST(last AS BIGINT) AS fn FROM n")
def cell_prf(spark: SparkSession, d: str) -> DataFrame:
    """The predicted tables lack the last row."""
    truth = _tables(spark, d)
    predicted = truth.withColumn("rows", F.slice("rows", 1, F.size("rows") - 1))
    return M.cell_counts(predicted, truth, ["table_id"])


@query(_TABLES + f"n AS (SELECT table_id, {_FILLED.format('flatten(list_concat([headers], body))')} AS every FROM t) SELECT table_id, CAST(1 AS INTEGER) AS pos, CAST(every AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn FROM n")
def best_table(spark: SparkSession, d: str) -> DataFrame:
    """Of a cut table, the whole one and the whole one again, the second is best."""
    truth = _tables(spark, d)
    cut_one = truth.select("table_id", F.lit(0).alias("pos"), F.slice("headers", 1, 1).alias("headers"), F.array().cast("array<array<string>>").alias("rows"))
    whole = truth.select("table_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("pos"), "headers", "rows")
    return M.best_tables(cut_one.unionByName(whole), truth)


_RULED = """WITH t AS (SELECT DISTINCT case_id AS table_id, case_table.headers AS headers, case_table.body_rows AS body, case_table.ruled AS ruled FROM eval_cases WHERE case_table IS NOT NULL AND case_table.headers IS NOT NULL), """
_WHOLE = _FILLED.format("flatten(list_concat([headers], coalesce(body, [])))")
_HEAD = _FILLED.format("headers")


@query(
    _RULED
    + f"""n AS (SELECT table_id, ruled, len(headers) % 2 = 0 OR ruled AS seen, {_WHOLE} AS every, CASE WHEN ruled THEN {_WHOLE} WHEN len(headers) % 2 = 0 THEN {_HEAD} ELSE 0 END AS tp FROM t)
SELECT ruled, count(*) AS tables, count(*) FILTER (seen) AS detected, CAST(sum(tp) AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, CAST(sum(every - tp) AS BIGINT) AS fn,
 CASE WHEN sum(tp) > 0 THEN 1.0 ELSE 0.0 END AS precision, round(coalesce(sum(tp) / nullif(sum(every), 0), 0), 4) AS recall, round(coalesce(2 * sum(tp) / nullif(sum(tp) + sum(every), 0), 0), 4) AS f1
FROM n GROUP BY GROUPING SETS ((ruled), ())"""
)
def table_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Ruled tables are found whole; of those without rules only the header is, and not of those with an odd number of columns."""
    rows = table(spark, d, "eval_cases").where("case_table is not null and case_table.headers is not null").select(F.col("case_id").alias("table_id"), "case_table.*").distinct()
    truth = rows.select("table_id", F.lit("case").alias("kind"), "headers", F.coalesce("body_rows", F.array().cast("array<array<string>>")).alias("rows"), "ruled")
    seen = truth.where("ruled or size(headers) % 2 = 0").select("table_id", F.lit(0).alias("pos"), "headers", F.when(F.col("ruled"), F.col("rows")).otherwise(F.array().cast("array<array<string>>")).alias("rows"))
    return V.evaluate_tables(seen, truth)[0]


@query(_TABLES + "g AS (SELECT table_id, len(headers) + list_sum(list_transform(body, lambda r: len(r))) AS n, len(body) AS r FROM t) SELECT table_id, CAST(n AS INTEGER) AS n_cells, CAST(r AS INTEGER) AS n_rows FROM g")
def table_grids(spark: SparkSession, d: str) -> DataFrame:
    """The grid with a blank row and ragged ends in between comes out as the table it was."""
    blank = F.array(F.array(F.lit("  "), F.lit(None).cast("string")))
    grids = _tables(spark, d).select("table_id", "headers", "rows", grid_to_table(F.concat(F.array("headers"), blank, "rows")).alias("t"))
    return grids.select("table_id", n_cells(F.col("headers"), F.col("rows")).alias("n_cells"), F.size("rows").alias("n_rows"))


_RANKS = """WITH r AS (SELECT document_type, latency_ms, row_number() OVER (PARTITION BY document_type ORDER BY latency_ms) - 1 AS k, count(*) OVER (PARTITION BY document_type) AS n, avg(latency_ms) OVER (PARTITION BY document_type) AS m FROM processed_documents WHERE latency_ms IS NOT NULL)
SELECT document_type, CAST(max(n) AS BIGINT) AS n, round(max(m), 1) AS mean, max(CASE WHEN k = n // 2 THEN latency_ms END) AS p50, max(CASE WHEN k = least(n - 1, CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) THEN latency_ms END) AS p95 FROM r GROUP BY document_type"""


@query(_RANKS)
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return M.latency_stats(table(spark, d, "processed_documents"), "latency_ms", ["document_type"])


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_requests(spark: SparkSession, d: str) -> DataFrame:
    return M.recent(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 20)


@query("WITH l AS (SELECT CAST(value AS DECIMAL(20,4)) AS v FROM events WHERE value IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 100), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM l) SELECT CAST(max(n) AS BIGINT) AS n, CAST(max(CASE WHEN k = n // 2 THEN v END) AS DOUBLE) AS p50, CAST(max(CASE WHEN k = least(n - 1, CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) THEN v END) AS DOUBLE) AS p95 FROM r")
def ring_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("value is not null").select("ts", "event_id", F.col("value").cast("decimal(20,4)").cast("double").alias("value"))
    return M.ring_stats(rows, ["ts", "event_id"], "value").drop("mean")


@query("SELECT document_type, routing, count(*) AS n FROM processed_documents GROUP BY document_type, routing")
def routing_by_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "processed_documents").groupBy("document_type", "routing").agg(F.count("*").alias("n"))


@query("SELECT pipeline_used, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(*) AS n FROM processed_documents GROUP BY pipeline_used")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "processed_documents").groupBy("pipeline_used").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("n"))


# --- sinks and models' answers ---------------------------------------------------------------------


@query("WITH e AS (SELECT DISTINCT trace_id FROM processed_documents WHERE document_type = 'report'), r AS (SELECT trace_id, latency_ms, row_number() OVER (PARTITION BY trace_id ORDER BY loaded_at, created_at) AS rn FROM processed_documents WHERE trace_id IS NOT NULL AND trace_id NOT IN (SELECT trace_id FROM e WHERE trace_id IS NOT NULL)) SELECT trace_id, latency_ms FROM r WHERE rn = 1")
def idempotent_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Rows an insert would add where those of reports exist already."""
    rows = table(spark, d, "processed_documents").select("trace_id", "latency_ms", "loaded_at", "created_at", "document_type")
    return first_writers(rows.where("document_type = 'report'"), rows, "trace_id", ["loaded_at", "created_at"]).select("trace_id", "latency_ms")


@query("SELECT o_orderkey AS doc_id, 'total' AS name, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS value FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, 'issue_date', strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') FROM orders WHERE o_orderkey % 4 <> 0")
def fields_from_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers with an unknown name and a null; every fourth one has a confidence above 1 and is rejected whole."""
    entry = lambda n, v, c: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"), c.alias("confidence"))
    c = F.when(F.col("o_orderkey") % 4 == 0, F.lit(1.5)).otherwise(F.lit(0.8))
    answer = F.to_json(F.struct(F.array(entry("total", F.col("o_totalprice").cast("decimal(18,2)"), c), entry("issue_date", F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(None).cast("double")), entry("colour", F.lit("red"), F.lit(0.9)), entry("vendor", F.lit(None), F.lit(0.9))).alias("fields")))
    return _values(fields_from_answer(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("invoice").alias("doc_type"), answer.alias("answer"))))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 3 + (o_orderkey // 3) % 3 + 4 AS INTEGER) END AS total, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 + (o_orderkey // 3) % 3 + 4 >= 8 THEN 'pass' WHEN o_orderkey % 3 + (o_orderkey // 3) % 3 + 4 >= 5 THEN 'review' ELSE 'fail' END AS verdict FROM orders")
def judge_verdicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    score = lambda c, v: F.concat(F.lit(f'"{c}": '), v.cast("string"))
    parts = [score("faithfulness", k % 3), score("completeness", F.floor(k / 3) % 3), score("types", F.lit(2)), score("consistency", F.when(k % 7 == 0, 3).otherwise(1)), score("plausibility", F.lit(1))]
    verdict = judge_verdict(F.concat(F.lit('{"scores": {'), F.concat_ws(", ", *parts), F.lit("}}")))
    return table(spark, d, "orders").select("o_orderkey", verdict["total"].alias("total"), verdict["verdict"].alias("verdict"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN c_name END AS name FROM customer")
def json_in_answers(spark: SparkSession, d: str) -> DataFrame:
    k, body = F.col("c_custkey") % 4, F.to_json(F.struct("c_name"))
    text = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), body, F.lit(" as asked."))).otherwise(F.concat(F.lit("["), "c_custkey", F.lit(", 2]")))
    return table(spark, d, "customer").select("c_custkey", F.get_json_object(S.json_object(text), "$.c_name").alias("name"))
