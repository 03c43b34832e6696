"""Registered queries meet every row: no class of documents, id or line is left out before the operator."""

import datetime

import pytest
from pyspark.sql import functions as F

from paperloom.operators.validate import compared_date
from paperloom.plans.reference_queries import QUERIES


@pytest.fixture(scope="module")
def orders_dir(spark, tmp_path_factory):
    """Orders 0 to 11 with two items each, so that each of the five kinds is rendered at least twice."""
    d = str(tmp_path_factory.mktemp("orders"))
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    write("orders", [(k, k % 3, datetime.datetime(1997, 1, 1 + k)) for k in range(12)], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp")
    write("lineitem", [(k, 100.25 + k) for k in range(12) for _ in range(2)], "l_orderkey bigint, l_extendedprice double")
    write("customer", [(k, f"Customer#{k}", 0) for k in range(3)], "c_custkey bigint, c_name string, c_nationkey int")
    write("nation", [(0, "NATION_1")], "n_nationkey int, n_name string")
    return d


def test_corpus_types_counts_reports_too(spark, orders_dir):
    got = {r.doc_type: r.n for r in QUERIES["corpus_types"](spark, orders_dir).collect()}
    assert got == {"invoice": 3, "receipt": 3, "contract": 2, "form": 2, "report": 2}


def test_invoice_blocks_with_short_numbers_are_read(spark, orders_dir):
    rows = QUERIES["invoice_roundtrip_block"](spark, orders_dir).collect()
    assert {r.doc_id: r.value for r in rows if r.name == "invoice_number"} == {k: f"INV-{k}-X" for k in range(12)}
    assert len(rows) == 120


def test_layout_categories_counts_lines_with_columns_and_several_pairs(spark, tmp_path):
    text = "INVOICE\nItem  2  3.00\nItem\t2\t3.00\nTo:  Mr. Smith  Date:  9/3/92\n\nEnd: x"
    spark.createDataFrame([("a", text), ("a", text), ("b", None), ("c", "")], "case_id string, text string").write.parquet(f"{tmp_path}/eval_cases.parquet")
    got = {r.category: r.n for r in QUERIES["layout_categories"](spark, str(tmp_path)).collect()}
    assert got == {"Title": 1, "Table": 2, "KeyValue": 3}


def test_dates_are_compared_in_the_forms_of_iso_dates_only(spark, tmp_path):
    texts = ["2025-09-20", "20250920", "2025-W38-6", "2025W386", "2025-W38", "2020-W53-5", "2025-W53-1", "2025-09-20T01:35", "2025-09-20 01:35:00", "2025-9-20", "2025", "2025-02-30", "20/09/2025", "", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", compared_date(F.col("t")).cast("string").alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == ["2025-09-20"] * 4 + ["2025-09-15", "2021-01-01"] + [None] * 9
    columns = "trace_id string, invoice_number string, vendor string, vendor_tax_id string, issue_date string, due_date string, currency string, subtotal double, tax double, total double, payment_terms string"
    dates = {"a": ("2025-09-20", "2025-09-01"), "b": ("20250920", "2025-09-01"), "c": ("2025-09-20T01:35", "2025-09-01"), "d": ("2025-09-01", "2025-09-20")}
    spark.createDataFrame([(k, "1", "v", "900", *v, "EUR", 1.0, 1.0, 2.0, None) for k, v in dates.items()], columns).write.parquet(f"{tmp_path}/invoices.parquet")
    assert {r.doc_id for r in QUERIES["check_date_order"](spark, str(tmp_path)).collect()} == {"a", "b"}


def test_long_texts_go_through_masking_pages_and_pipeline(spark, tmp_path):
    long = "Invoice No: 7\n" + "word " * 8000 + "\f mail a.b@c.com, card 4242 4242 4242 4242"
    spark.createDataFrame([(1, long, None, None), (2, None, "x", "en"), (3, "", "x", None)], "doc_id int, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda name: {r.doc_id: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    masked, counts, pages, scores = map(rows, ("document_pii_masked", "document_pii_counts", "document_text_pages", "document_scores"))
    assert masked[1].masked.endswith("mail [REDACTED:email], card [REDACTED:credit_card]") and set(masked) == {1, 2, 3}
    assert (counts[1].n_email, counts[1].n_credit_card, counts[1].n_iban) == (1, 1, 0)
    assert pages[1].n_pages == 2 and pages[1].n_text > 40_000 and set(pages) == {1, 2, 3}
    assert set(scores) == {1} and scores[1].doc_type == "invoice"
