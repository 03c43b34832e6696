"""Checks of extracted fields. Every check gives rows (doc_id, seq, severity, code, field, details)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.dims import DATE_FIELDS, FIELD_COST, FIELDS, NUMERIC_FIELDS, PII_ORDER, REQUIRED, SAFE_FIELDS
from paperloom.functions.scalars import is_valid_nit, looks_like_nit, mask_pii

# Patterns of identifiers and dates.
GENERIC_TAX_ID = r"(?i)^[A-Z0-9][A-Z0-9.\-/ ]{4,24}$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO_WEEK = r"^(?:(\d{4})-W(\d{2})(?:-(\d))?|(\d{4})W(\d{2})(\d)?)$"


def compared_date(text: Column) -> Column:
    """The date of an ISO 8601 text without a time (yyyy-mm-dd, yyyymmdd, yyyy-Www[-d], yyyyWww[d]); null for any other form."""
    part = lambda i: F.nullif(F.coalesce(F.nullif(F.regexp_extract(text, ISO_WEEK, i), F.lit("")), F.regexp_extract(text, ISO_WEEK, i + 3)), F.lit("")).cast("int")
    year, week, weekday = part(1), part(2), F.coalesce(part(3), F.lit(1))
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_add(fourth, (week - 1) * 7 - F.weekday(fourth))
    by_week = F.when((week >= 1) & (F.weekofyear(monday) == week) & weekday.between(1, 7), F.date_add(monday, weekday - 1))
    plain = F.when(text.rlike(r"^\d{8}$"), F.concat_ws("-", text.substr(1, 4), text.substr(5, 2), text.substr(7, 2))).when(text.rlike(ISO_DATE), text)
    return F.coalesce(plain.try_cast("date"), F.when(text.rlike(ISO_WEEK), by_week))


def _finding(when: Column, seq: int, severity: str, code: str, field: str | None, details: dict[str, Column] | None = None) -> Column:
    entries = [x for k, v in (details or {}).items() for x in (F.lit(k), v.cast("string"))]
    held = F.create_map(*entries) if entries else F.expr("map()").cast("map<string,string>")
    return F.when(when, F.struct(F.lit(seq).alias("seq"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(field).cast("string").alias("field"), held.alias("details")))


def wide_fields(fields: DataFrame) -> DataFrame:
    """fields: doc_id, doc_type, name, value_str, value_num and perhaps pos, their order.

    (doc_id, doc_type, s: map name -> text, n: map name -> number): one row a document, for checks across fields."""
    value = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("name", c))))
    # a field given twice counts once: the last one where the rows have a position, else the greatest row
    both = F.struct("value_str", "value_num")
    last = F.max_by(both, "pos") if "pos" in fields.columns else F.max(both)
    fields = fields.where("name is not null").groupBy("doc_id", "doc_type", "name").agg(last.alias("v")).select("doc_id", "doc_type", "name", "v.*")
    return fields.groupBy("doc_id", "doc_type").agg(value("value_str").alias("s"), value("value_num").alias("n"))


def _checks() -> list[Column]:
    s, n = (lambda f: F.try_element_at("s", F.lit(f))), (lambda f: F.try_element_at("n", F.lit(f)))
    kind = F.col("doc_type")
    out: list[Column] = []
    add = lambda *a, **k: out.append(_finding(a[0], len(out), *a[1:], **k))
    for doc_type, names in REQUIRED.items():
        for f in names:
            missing = (F.coalesce(s(f), F.lit("")) == "") & n(f).isNull()
            add((kind == doc_type) & missing, "error", "missing_required", f)
    for f in DATE_FIELDS:
        add(s(f).isNotNull() & ~s(f).rlike(ISO_DATE), "warn", "non_iso_date", f, {"value": s(f)})
        add(s(f).rlike(ISO_DATE) & s(f).try_cast("date").isNull(), "error", "invalid_date", f, {"value": s(f)})
    for f in NUMERIC_FIELDS:
        add(s(f).isNotNull(), "error", "non_numeric_amount", f, {"value": s(f)})
        add(n(f) < 0, "warn", "negative_amount", f, {"value": n(f)})
    add(s("currency").isNotNull() & ~s("currency").rlike("^[A-Z]{3}$"), "warn", "invalid_currency_code", "currency", {"value": s("currency")})
    tax_id = s("vendor_tax_id")
    add(looks_like_nit(tax_id) & ~is_valid_nit(tax_id), "error", "invalid_nit_check_digit", "vendor_tax_id", {"value": tax_id})
    add(tax_id.isNotNull() & ~looks_like_nit(tax_id) & ~tax_id.rlike(GENERIC_TAX_ID), "warn", "implausible_tax_id", "vendor_tax_id", {"value": tax_id})
    expected = F.round(n("subtotal") + n("tax"), 2)
    add((kind == "invoice") & (F.abs(expected - n("total")) > 0.05), "error", "math_mismatch", "total", {"expected": expected, "got": n("total")})
    issue, due = compared_date(s("issue_date")), compared_date(s("due_date"))
    add((kind == "invoice") & (due < issue), "error", "due_before_issue", "due_date", {"issue_date": s("issue_date"), "due_date": s("due_date")})
    add((kind == "contract") & ((n("term_months") <= 0) | (n("term_months") > 600)), "warn", "implausible_term", "term_months", {"term_months": n("term_months")})
    return out


def validate_fields(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, seq, severity, code, field, details) for every document of docs (doc_id, doc_type), fields or not."""
    typed = docs.select("doc_id", "doc_type").join(wide_fields(fields).drop("doc_type"), "doc_id", "left")
    empty = lambda c, t: F.coalesce(F.col(c), F.expr("map()").cast(t))
    ready = typed.select("doc_id", "doc_type", empty("s", "map<string,string>").alias("s"), empty("n", "map<string,double>").alias("n"))
    found = ready.select("doc_id", F.array_compact(F.array(*_checks())).alias("f"))
    return found.select("doc_id", F.explode("f").alias("f")).select("doc_id", "f.*")


def missing_required(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, field) of required fields without a value, as an anti join."""
    spark = docs.sparkSession
    rows = [(t, f) for t, names in REQUIRED.items() for f in names]
    wanted = docs.select("doc_id", "doc_type").join(F.broadcast(spark.createDataFrame(rows, "doc_type string, field string")), "doc_type")
    have = fields.where("value_num is not null or coalesce(value_str, '') <> ''").select("doc_id", F.col("name").alias("field"))
    return wanted.join(have, ["doc_id", "field"], "left_anti").select("doc_id", "field")


def penalize_fields(fields: DataFrame, findings: DataFrame) -> DataFrame:
    """fields with the confidence of those an error names lowered once."""
    flagged = findings.where("severity = 'error' and field is not null").select("doc_id", F.col("field").alias("name")).distinct().withColumn("flagged", F.lit(True))
    joined = fields.join(flagged, ["doc_id", "name"], "left")
    lowered = F.round(F.greatest(F.lit(0.0), F.col("confidence") - FIELD_COST), 3)
    return joined.withColumn("confidence", F.when(F.col("flagged"), lowered).otherwise(F.col("confidence"))).drop("flagged").select(fields.columns)


def redact_fields(fields: DataFrame) -> DataFrame:
    """fields with personal data in the text values of unsafe fields masked, the flag redacted and counts n_<kind>."""
    masked = mask_pii(fields.withColumn("__t", F.when(~F.col("name").isin(*SAFE_FIELDS), F.col("value_str"))), "__t", "__m")
    total = reduce(lambda a, b: a + b, [F.col(f"n_{k}") for k in PII_ORDER])
    return masked.withColumns({"value_str": F.coalesce("__m", "value_str"), "redacted": total > 0}).drop("__t", "__m")


def pii_findings(redacted: DataFrame) -> DataFrame:
    """An info finding with the counts of each kind for documents in which something was masked."""
    sums = redacted.groupBy("doc_id").agg(*[F.sum(f"n_{k}").alias(k) for k in PII_ORDER])
    counts = F.map_filter(F.create_map(*[x for k in PII_ORDER for x in (F.lit(k), F.col(k).cast("string"))]), lambda k, v: v != "0")
    return sums.where(" + ".join(PII_ORDER) + " > 0").select("doc_id", F.lit(1000).alias("seq"), F.lit("info").alias("severity"), F.lit("pii_redacted").alias("code"), F.lit(None).cast("string").alias("field"), counts.alias("details"))


#: Pages recognised with a lower mean confidence get a warning.
LEAST_OCR = 0.6


def low_ocr_confidence(docs: DataFrame, least: float = LEAST_OCR) -> DataFrame:
    """A warning for recognised documents whose mean page confidence is low; docs: doc_id, source, mean_confidence."""
    low = docs.where((F.col("source") == "ocr") & (F.col("mean_confidence") < least))
    details = F.create_map(F.lit("mean_confidence"), F.col("mean_confidence").cast("string"))
    return low.select("doc_id", F.lit(999).alias("seq"), F.lit("warn").alias("severity"), F.lit("low_ocr_confidence").alias("code"), F.lit(None).cast("string").alias("field"), details.alias("details"))


CRITERIA = ("faithfulness", "completeness", "types", "consistency", "plausibility")


def judge_verdict(answer: Column, criteria: tuple[str, ...] = CRITERIA) -> Column:
    """struct<total, verdict> from a judge's scores (0, 1 or 2 for each criterion); null if one is missing or wrong."""
    scores = F.array(*[F.get_json_object(answer, f"$.scores.{c}").try_cast("int") for c in criteria])
    good = F.forall(scores, lambda v: v.isNotNull() & v.between(0, 2))
    total = F.aggregate(scores, F.lit(0), lambda a, v: a + v)
    return F.when(F.coalesce(good, F.lit(False)), F.struct(total.alias("total"), F.when(total >= 8, "pass").when(total >= 5, "review").otherwise("fail").alias("verdict")))


def judge_findings(verdicts: DataFrame) -> DataFrame:
    """verdicts (doc_id, verdict) as findings: fail an error, review a warning, pass none."""
    bad = verdicts.where("verdict in ('fail', 'review')")
    severity = F.when(F.col("verdict") == "fail", "error").otherwise("warn")
    return bad.select("doc_id", F.lit(998).alias("seq"), severity.alias("severity"), F.concat(F.lit("judge_"), "verdict").alias("code"), F.lit(None).cast("string").alias("field"), F.expr("map()").cast("map<string,string>").alias("details"))


def field_names(doc_type: str) -> list[str]:
    return FIELDS[doc_type]
