"""Scalars, layout, extraction, checks, scoring, evaluation, sources, sinks and streams on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.operators import forms, metrics
from paperloom.operators.classify import classify
from paperloom.operators.extract import extract_fields, fields_from_answer
from paperloom.operators.layout import assemble_lines, category, explode_elements, number_lines
from paperloom.operators.score import is_scanned, route
from paperloom.operators.tables import grid_to_table
from paperloom.operators.validate import judge_findings, judge_verdict, low_ocr_confidence, redact_fields, validate_fields
from paperloom.plans.pipeline import reprocess, results, run
from paperloom.sources import readers, writers
from paperloom.streaming.ingest import dedupe, process_to_table, routing_counts


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_dates(spark):
    texts = ["14/03/2026", "03/14/2026", "March 14, 2026", "14 March 2026", "14 de marzo de 2026", "x 2026-03-14 y", "2026-13-40", "no date", "2026-02-30", "14 Foo 2026", None, ""]
    assert values(spark, texts, S.normalize_date) == ["2026-03-14"] * 6 + [None] * 6


def test_amounts(spark):
    texts = ["2,499.00", "2.499,00", "USD 1,250", "$ -12.5", "7", "n/a", "2499", "1200.00", "12.345", None, "-3"]
    assert values(spark, texts, S.normalize_amount) == [2499.0, 2499.0, 1250.0, -12.5, 7.0, None, 249.0, 120.0, 12345.0, None, -3.0]
    assert values(spark, ["2499", "1234.56"], lambda c: S.normalize_amount(c, compat=False)) == [2499.0, 1234.56]


def test_text_identifiers_and_json(spark):
    assert values(spark, ["  ACME  Corp. ", None, "(a b):"], S.normalize_text) == ["acme corp", None, "a b"]
    assert values(spark, ["900123456", "12a"], S.nit_check_digit) == [8, None]
    assert values(spark, ["900.123.456-8", "900123456-7", "abc"], S.is_valid_nit) == [True, False, False]
    assert values(spark, ["4242424242424242", "4242424242424241", ""], S.luhn_ok) == [True, False, False]
    got = values(spark, ['{"a": 1}', '```json\n{"a": 1}\n```', 'So: {"a": 1}.', "none", "[1]", '{"a": ', None], S.json_object)
    assert [g and json.loads(g) for g in got] == [{"a": 1}] * 3 + [None] * 4


def test_masking(spark):
    text = "Mail a.b@c.com, SSN 123-45-6789, card 4242 4242 4242 4242, call +1 415 555 0100, ref 2026-0042"
    row = S.mask_pii(spark.createDataFrame([(text,), (None,), ("",)], "t string"), "t", "m").collect()
    assert row[0].m == "Mail [REDACTED:email], SSN [REDACTED:ssn], card [REDACTED:credit_card], call [REDACTED:phone], ref 2026-0042"
    assert (row[0].n_email, row[0].n_ssn, row[0].n_credit_card, row[0].n_phone) == (1, 1, 1, 1) and row[1].m is None and row[2].m == ""


def test_layout(spark):
    texts = ["INVOICE", "Invoice No: 7", "- milk", "Item  2  3.00", "Acme Consulting", "This is a line of text that says something.", "", "http://a.b"]
    assert values(spark, texts, category) == ["Title", "KeyValue", "ListItem", "Table", "Title", "NarrativeText", "Other", "KeyValue"]
    docs = spark.createDataFrame([(1, "To:  Mr. Smith  Date:  9/3/92\n\njust   some   words\r\nEnd: x"), (2, None), (3, "")], "doc_id int, text string")
    got = [(r.doc_id, r.pos, r.category, r.key, r.value) for r in explode_elements(docs).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 0, "KeyValue", "To", "Mr. Smith"), (1, 1, "KeyValue", "Date", "9/3/92"), (1, 2, "Table", None, None), (1, 3, "KeyValue", "End", "x")]


def test_ocr_lines(spark):
    words = [("Invoice", 96, 1), ("No:", 95, 1), ("INV-1", 93, 1), ("", -1, 1), ("Total:", 90, 2), ("42.00", 88, 2)]
    df = spark.createDataFrame([("d", 1, 1, 1, line, i, t, c) for i, (t, c, line) in enumerate(words)], "doc_id string, page int, block int, par int, line int, seq int, text string, conf int")
    page = assemble_lines(df).collect()[0]
    assert page.text == "Invoice No: INV-1\nTotal: 42.00" and page.n_words == 5 and page.confidence == pytest.approx(0.924)
    assert [r.line_no for r in number_lines(df).orderBy("seq").collect()] == [0, 0, 0, 1, 1]


INVOICE = "\n".join(
    ["ACME CONSULTING S.A.S.", "Calle 1", "NIT: 900.123.456-8", "", "Invoice No: INV-2026-0042", "Invoice Date: 2026-03-14", "Due Date: 2026-04-13", "Bill To: Globex Corporation", "Payment Terms: Net 30", ""]
    + ["Subtotal: 2,100.00", "Tax (19%): 399.00", "Total Due: USD 2,499.00", "Currency: USD"]
)


def test_golden_invoice(spark):
    got = {r.name: (r.value_str if r.value_str is not None else r.value_num, r.confidence) for r in extract_fields(spark.createDataFrame([(1, INVOICE)], "doc_id int, text string")).collect()}
    assert got == {
        "invoice_number": ("INV-2026-0042", 0.88), "vendor": ("ACME CONSULTING S.A.S.", 0.6), "vendor_tax_id": ("900.123.456-8", 0.92), "issue_date": ("2026-03-14", 0.88), "due_date": ("2026-04-13", 0.92),
        "currency": ("USD", 0.92), "subtotal": (2100.0, 0.92), "tax": (399.0, 0.82), "total": (2499.0, 0.88), "payment_terms": ("Net 30", 0.92),
    }
    stages = run(spark.createDataFrame([(1, INVOICE), (2, " "), (3, None), (4, "x" * 200_001), (None, "text")], "doc_id int, text string"))
    score = stages.scores.collect()
    assert [(s.doc_id, s.doc_type, s.coverage, s.confidence, s.routing) for s in score] == [(1, "invoice", 1.0, 0.866, "human_review")]
    assert {(r.doc_id, r.error_code) for r in stages.errors.collect()} == {(2, "empty"), (3, "empty"), (4, "oversized"), (None, "no_id")}
    assert stages.findings.count() == 0 and len(results(stages).collect()[0].fields) == 10


def test_classifier(spark):
    docs = ["Invoice with subtotal and due date", "RECIBO cashier cash", "This agreement, governing law", "APPLICATION FORM submitted by", "Executive summary of findings", "nothing", None]
    assert values(spark, docs, lambda c: classify(c)["doc_type"]) == ["invoice", "receipt", "contract", "form", "report", "form", "form"]
    assert values(spark, ["nothing"], lambda c: classify(c)["confidence"]) == [0.35]
    assert values(spark, ['{"type": " Report ", "confidence": 2}'], lambda c: classify(F.lit("x"), c)["confidence"]) == [1.0]
    assert values(spark, ['{"type": "poem"}', "broken", None], lambda c: classify(F.lit("invoice"), c)["doc_type"]) == ["invoice"] * 3


def field_rows(spark, doc_type, **fields):
    rows = [(1, doc_type, k, v if isinstance(v, str) else None, None if isinstance(v, str) else float(v), 0.9) for k, v in fields.items()]
    return spark.createDataFrame([(1, doc_type)], "doc_id int, doc_type string"), spark.createDataFrame(rows, "doc_id int, doc_type string, name string, value_str string, value_num double, confidence double")


def test_findings(spark):
    bad = dict(invoice_number="", vendor_tax_id="900123456-7", issue_date="2026-02-30", due_date="14/03/2026", currency="usd", subtotal=10, tax=1, total=-12)
    codes = {(r.severity, r.code, r.field) for r in validate_fields(*field_rows(spark, "invoice", **bad)).collect()}
    assert codes == {
        ("error", "missing_required", "invoice_number"), ("error", "missing_required", "vendor"), ("error", "invalid_nit_check_digit", "vendor_tax_id"), ("error", "invalid_date", "issue_date"),
        ("warn", "non_iso_date", "due_date"), ("warn", "invalid_currency_code", "currency"), ("warn", "negative_amount", "total"), ("error", "math_mismatch", "total"),
    }
    assert {r.code for r in validate_fields(*field_rows(spark, "contract", term_months=700, total_value="much")).collect()} == {"missing_required", "implausible_term", "non_numeric_amount"}
    docs, none = field_rows(spark, "form", form_id="F-1")
    assert validate_fields(docs, none.limit(0)).where("code = 'missing_required'").count() == 3
    masked = redact_fields(field_rows(spark, "form", submitter="a@b.com", form_id="a@b.com")[1]).orderBy("name").collect()
    assert [(r.name, r.value_str, r.redacted) for r in masked] == [("form_id", "a@b.com", False), ("submitter", "[REDACTED:email]", True)]
    assert low_ocr_confidence(spark.createDataFrame([(1, "ocr", 0.5), (2, "text", 0.1)], "doc_id int, source string, mean_confidence double")).count() == 1


def test_judge_and_routes(spark):
    scores = lambda *v: json.dumps({"scores": dict(zip(("faithfulness", "completeness", "types", "consistency", "plausibility"), v))})
    got = values(spark, [scores(2, 2, 2, 2, 2), scores(0, 0, 0, 0, 0), scores(2, 2, 1, 1, 1), scores(3, 1, 1, 1, 1), scores(1), None], judge_verdict)
    assert [(g.verdict, g.total) if g else None for g in got] == [("pass", 10), ("fail", 0), ("review", 7), None, None, None]
    assert judge_findings(spark.createDataFrame([(1, "pass"), (2, "fail"), (3, "review")], "doc_id int, verdict string")).count() == 2
    assert values(spark, ["0.9", "0.7", "0.69"], lambda c: route(c.cast("double"))) == ["auto_approve", "human_review", "vlm_fallback"]
    assert values(spark, ["ab", "x" * 30], lambda c: is_scanned(F.array(c))) == [True, False]


def test_answers_become_fields(spark):
    answer = json.dumps({"fields": [{"name": "total", "value": "1,200.50", "confidence": 0.9}, {"name": "issue_date", "value": "14/03/2026"}, {"name": "vendor", "value": ""}, {"name": "x", "value": "y"}]})
    rows = [(1, "invoice", answer), (2, "invoice", answer.replace("0.9", "7")), (3, "invoice", "broken"), (4, "invoice", None)]
    got = fields_from_answer(spark.createDataFrame(rows, "doc_id int, doc_type string, answer string")).orderBy("name").collect()
    assert [(r.doc_id, r.name, r.value_str, r.value_num, r.confidence) for r in got] == [(1, "issue_date", "2026-03-14", None, 0.7), (1, "total", None, 1200.5, 0.9)]


def test_field_and_pair_and_cell_counts(spark):
    mk = lambda rows: spark.createDataFrame(rows, "doc_id int, name string, value string")
    counts = metrics.field_counts(mk([(1, "invoice_number", "A-1"), (1, "total", "11"), (1, "vendor", "X"), (1, "tax", "")]), mk([(1, "invoice_number", "a-1."), (1, "total", "10"), (1, "issue_date", "2026-01-01")]))
    assert {r.name: (r.tp, r.fp, r.fn) for r in counts.collect()} == {"invoice_number": (1, 0, 0), "total": (0, 1, 1), "vendor": (0, 1, 0), "issue_date": (0, 0, 1)}
    pairs = lambda rows: spark.createDataFrame(rows, "doc_id int, question string, answer string")
    p = metrics.pair_counts(pairs([(1, "To:", "B"), (1, "TO", "b."), (1, "x", "y")]), pairs([(1, "to", "b"), (1, "q", "a")])).collect()[0]
    assert (p.tp, p.fp, p.fn) == (1, 1, 1)
    t = lambda h, r: spark.createDataFrame([(1, h, r)], "table_id int, headers array<string>, rows array<array<string>>")
    c = metrics.cell_counts(t(["A", "B", "Z"], [["1", "9"], ["w"]]), t(["a", "b"], [["1", "2"]]), ["table_id"]).collect()[0]
    assert (c.tp, c.fn, c.fp) == (3, 1, 3)
    flags = metrics.documents_correct(counts, spark.createDataFrame([(1, "invoice"), (2, "invoice")], "doc_id int, doc_type string")).collect()
    assert {r.doc_id: r.correct for r in flags} == {1: False, 2: None}


def test_latencies(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([50, 10, 30, 20])] + [(9, None)], "i int, v int")
    row = metrics.latency_stats(df, "v").collect()[0]
    assert (row.n, row.mean, row.p50, row.p95) == (4, 27.5, 30, 50)
    ring = metrics.ring_stats(df.where("i < 9"), ["i"], "v", 3).collect()[0]
    assert (ring.p50, ring.p95) == (20, 30)
    assert metrics.latency_stats(df.limit(0), "v").count() == 0


def test_tables_and_forms(spark):
    grid = [["  a ", None], [" ", ""], ["1"], ["2", "x  y"]]
    got = spark.createDataFrame([(grid,), ([["a"]],), ([],)], "g array<array<string>>").select(grid_to_table(F.col("g")).alias("t")).collect()
    assert got[0].t.headers == ["a", ""] and got[0].t.rows == [["1", ""], ["2", "x y"]] and got[1].t is None and got[2].t is None
    form = [(0, "Name", [0, 0, 10, 10], "question", [[0, 1]]), (1, "Ann", [50, 2, 60, 12], "answer", [[0, 1]]), (2, "Next", [0, 14, 9, 20], "other", []), (3, " ", [5, 0, 6, 9], "answer", []), (4, "Deep", [0, 30, 9, 40], "header", None)]
    df = spark.createDataFrame([("f", form)], "doc_id string, form array<struct<id:int,text:string,box:array<int>,label:string,linking:array<array<int>>>>")
    entities = forms.explode_entities(df)
    assert [(r.question, r.answer) for r in forms.linked_pairs(entities).collect()] == [("Name", "Ann")]
    assert forms.reading_order(entities).collect()[0].text == "Name  Next  Ann\nDeep".replace("Name  Next  Ann", "Name  Next  Ann")
    assert {r.label: r.n for r in forms.label_counts(entities).collect()} == {"question": 1, "answer": 2, "other": 1, "header": 1}


def test_readers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "a", "text": "t", "ground_truth": {"total": 5}}\n\n{"id": "b"}\n')
    assert [r.id for r in readers.read_cases(spark, str(tmp_path / "c.jsonl")).orderBy("id").collect()] == ["a", "b"]
    (tmp_path / "forms").mkdir()
    for name in ("b", "a"):
        (tmp_path / "forms" / f"{name}.json").write_text(json.dumps({"form": [{"id": 1, "text": name, "box": [0, 0, 1, 1], "label": "other", "linking": []}]}, indent=1))
    assert [r.doc_id for r in readers.read_forms(spark, str(tmp_path / "forms")).collect()] == ["a", "b"]
    df = spark.createDataFrame([(1, b"%PDF-1"), (2, b"boom"), (3, b"")], "doc_id int, content binary")
    assert {r.doc_id: r.e for r in df.select("doc_id", readers.check_pdf(F.col("content")).alias("e")).collect()} == {1: None, 2: "invalid_pdf", 3: "empty"}

    def reader(content):
        if content == b"boom":
            raise ValueError
        return [{"text": content.decode()}]

    got = {r.doc_id: (r.pages and r.pages[0].text, r.error_code) for r in readers.with_reader(df, reader).collect()}
    assert got == {1: ("%PDF-1", None), 2: (None, "ValueError"), 3: ("", None)}
    pages = values(spark, ['{"pages": [{"text": "a"}, {"confidence": 7}]}', '{"pages": []}', "x"], readers.vision_pages)
    assert [(p.number, p.text, p.confidence) for p in pages[0]] == [(1, "a", 0.8), (2, "", 1.0)] and pages[1:] == [None, None]


def test_sinks(spark, tmp_path):
    name = "results_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    rows = [("a", "2026-01-02 00:00:00", "x"), ("a", "2026-01-01 00:00:00", "first"), ("b", "2026-01-01 00:00:00", "y")]
    batch = spark.createDataFrame(rows, "trace_id string, created_at string, result string").select(
        "trace_id", F.col("created_at").cast("timestamp").alias("created_at"), *[F.lit(None).cast(t).alias(c) for c, t in (("document_type", "string"), ("routing", "string"), ("pipeline_used", "string"), ("overall_confidence", "double"), ("latency_ms", "int"), ("input_tokens", "int"), ("output_tokens", "int"))], "result"
    )
    try:
        assert writers.upsert_results(spark, name, batch) == 2 and writers.upsert_results(spark, name, batch) == 0
        assert {r.trace_id: r.result for r in spark.table(name).collect()} == {"a": "first", "b": "y"}
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    writers.write_jsonl(spark.createDataFrame([(1, "é")], "b int, a string"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":"é","b":1}']
    (tmp_path / "r.md").write_text("x<!-- a -->old<!-- b -->y")
    assert writers.replace_block(str(tmp_path / "r.md"), "<!-- a -->", "<!-- b -->", "new") and "\nnew\n" in (tmp_path / "r.md").read_text()
    assert not writers.replace_block(str(tmp_path / "none.md"), "a", "b", "c")
    got = writers.manifest(spark, [str(tmp_path / "r.md"), str(tmp_path / "none")]).collect()
    assert len(got) == 1 and len(got[0].sha256) == 64
    assert "| 12.5 % |" in writers.markdown_table(spark.createDataFrame([(0.125,)], "f1 double"), ("f1",))
    assert [r.case_id for r in writers.gallery(spark.createDataFrame([("a", "t"), ("b", "t")], "case_id string, text string"), ["b", "z", "a"]).collect()] == ["b", "a"]


def test_reprocess_once(spark):
    docs = spark.createDataFrame([(1, "Receipt"), (2, "Receipt")], "doc_id int, text string")
    stages = run(docs)
    assert {r.routing for r in stages.scores.collect()} == {"vlm_fallback"}
    images = spark.createDataFrame([(1, 2), (2, 0)], "doc_id int, n_images int")
    good = [("receipt_number", "R-1", None), ("vendor", "V", None), ("issue_date", "2026-01-01", None), ("total", None, 5.0), ("currency", "USD", None), ("payment_method", "cash", None)]
    reader = lambda d: d.crossJoin(spark.createDataFrame(good, "name string, value_str string, value_num double")).select("doc_id", "doc_type", "name", "value_str", "value_num", F.lit(0.95).alias("confidence"), F.lit("vlm").alias("source"))
    assert {r.doc_id: r.routing for r in reprocess(stages, images, reader).scores.collect()} == {1: "auto_approve", 2: "vlm_fallback"}


def test_streams(spark, tmp_path):
    source, name = tmp_path / "in", "stream_results_test"
    source.mkdir()
    rows = [{"doc_id": "a", "text": INVOICE, "received_at": "2026-01-01T00:00:00Z"}, {"doc_id": "a", "text": INVOICE, "received_at": "2026-01-01T00:01:00Z"}, {"doc_id": "b", "text": "Receipt No: R-77", "received_at": "2026-01-01T01:00:00Z"}]
    (source / "1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("doc_id string, text string, received_at timestamp").json(str(source))
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    try:
        process_to_table(dedupe(stream), name, str(tmp_path / "cp")).awaitTermination(120)
        assert sorted(r.trace_id for r in spark.table(name).collect()) == ["a", "b"]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    counted = routing_counts(stream.select(F.col("received_at").alias("created_at"), F.lit("x").alias("routing")))
    q = counted.writeStream.format("memory").queryName("routing_counts_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("routing_counts_test").collect()) == [1, 2]
