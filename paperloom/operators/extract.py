"""Field extraction: labelled values by ranked label joins, then pattern rules for what no label gave.

The pairs and the values of the rules are arrays next to each document; labels are a constant map of the plan,
and the best hit of each field is picked within the row. Only what was found leaves it: no join, no shuffle.
"""

from __future__ import annotations

import re
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.dims import CURRENCY_CODES, DATE_FIELDS, FIELDS, LABELS, NUMERIC_FIELDS, PAYMENT_METHODS
from paperloom.functions.scalars import SPACES, TRIMMED, bind, collapse, currency_in_text, group, normalize_amount, normalize_date
from paperloom.operators.classify import classify
from paperloom.operators.layout import elements, key_values

# Patterns of the rules.
TERM = r"(?iu)(\d{1,3})\s*(months?|meses|years?|años?)"
YEAR = r"(?:19|20)\d{2}"
ID_LIKE = r"(?i)[A-Z]{0,5}[-/ ]?\d{2,}[A-Z0-9\-/]*"
TOTAL = r"(?i)total[^\d\n]{0,25}([\d.,]+\d)"
DOCUMENT_WORDS = r"(?i)invoice|receipt|factura|recibo|report|agreement|contract|form|payment"
PARTIES = r"(?is)between\s+(.+?)\s+(?:\(.*?\)\s+)?and\s+(.+?)(?:\s*[\.,\n(]|$)"
CONTRACT_RULES = {
    "effective_date": r"(?im)(?:as of|effective(?: date)?(?: of)?|dated)\s+([A-Za-z0-9 ,/.-]{6,30}?)(?:\s*\(|\s+between|\s+by|[.;]|$)",
    "term_months": r"(?i)term(?: of this agreement)?\s+(?:is|shall be|of)\s+(\d{1,3}\s*(?:months?|years?))",
    "total_value": r"(?i)(?:contract value|total value|total fees?|consideration)\s+(?:is|of|shall be)\s+([A-Z]{3}\s*[\d.,]+)",
    "governing_law": r"(?i)governing law[:\s]+(?:of\s+)?(?:the\s+)?([A-Z][A-Za-z ]{3,60}?)(?:[.;\n]|$)",
}


#: The name under which a document itself goes through the extraction.
DOCUMENT = "\ue000document"


@cache
def label_rows() -> list[tuple[str, str, int, str]]:
    """(doc_type, field, rank, normalised label), in the order of the types' fields."""
    clean = lambda s: s.lower().strip(TRIMMED)
    return [(t, f, r, clean(label)) for t, names in FIELDS.items() for f in names for r, label in enumerate(LABELS[f])]


def label_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(label_rows(), "doc_type string, field string, rank int, label string")


def coerce(field: Column, raw: Column) -> Column:
    """struct<value_str, value_num, penalty> of a field's raw text; both null where it must be dropped."""
    null_str, null_num = F.lit(None).cast("string"), F.lit(None).cast("double")
    pack = lambda s, n, p: F.struct(s.alias("value_str"), n.alias("value_num"), F.lit(p).cast("double").alias("penalty") if not isinstance(p, Column) else p.alias("penalty"))
    months = group(raw, TERM, 1).cast("double") * F.when(F.lower(group(raw, TERM, 2)).rlike("^(?:year|año)"), 12).otherwise(1)
    iso = normalize_date(raw)
    code = group(F.upper(raw), rf"(?U)\b({'|'.join(CURRENCY_CODES)})\b")
    method = reduce(lambda w, m: w.when(F.lower(raw).contains(m), m), PAYMENT_METHODS, F.when(F.lit(False), ""))
    year, ident = group(raw, YEAR, 0), group(raw, ID_LIKE, 0)
    tidy = F.regexp_replace(F.btrim(raw), "[.;,]+$", "")
    either = lambda good, bad, p: bind(good, lambda g: pack(F.coalesce(g, bad), null_num, F.when(g.isNotNull(), F.lit(0.0)).otherwise(p)))
    return (
        F.when(field.isin(*NUMERIC_FIELDS), pack(null_str, normalize_amount(raw), 0.0))
        .when(field == "term_months", pack(null_str, months, 0.0))
        .when(field.isin(*DATE_FIELDS), either(iso, raw, 0.25))
        .when(field == "currency", either(code, F.upper(F.substring(raw, 1, 3)), 0.3))
        .when(field == "payment_method", either(method, raw, 0.2))
        .when(field == "fiscal_year", either(year, raw, 0.2))
        .when(field.endswith("_number") | (field == "form_id"), either(F.btrim(ident), raw, 0.2))
        .otherwise(pack(tidy, null_num, 0.0))
    )


def _rules(doc_type: Column, text: Column, elems: Column) -> Column:
    """array<struct<field, raw, confidence, ord>> of what the rules find, in the order they are tried."""
    found: list[Column] = []

    def rule(types: tuple[str, ...], field: str, raw: Column, confidence: float) -> None:
        entry = lambda r: F.when(r.isNotNull(), F.struct(F.lit(field).alias("field"), r.alias("raw"), F.lit(confidence).alias("confidence"), F.lit(at).alias("ord")))
        at = len(found)
        found.append(F.when(doc_type.isin(*types), bind(raw, entry)))

    head = F.filter(F.slice(elems, 1, 6), lambda e: e["category"].isin("Title", "NarrativeText") & ~e["text"].rlike(DOCUMENT_WORDS) & ~e["text"].rlike(r"(?U)\d") & (F.size(F.split(e["text"], SPACES)) <= 6) & e["text"].rlike(r"^\p{Lu}"))
    title = F.filter(F.slice(elems, 1, 5), lambda e: e["category"] == "Title")
    low = F.lower(text)
    method = reduce(lambda w, m: w.when(low.rlike(rf"(?U)\b{m}\b"), m), PAYMENT_METHODS, F.when(F.lit(False), ""))
    parties = F.when(text.rlike(PARTIES), F.concat(collapse(group(text, PARTIES, 1)), F.lit("; "), collapse(group(text, PARTIES, 2))))
    bought = ("invoice", "receipt")
    rule(bought, "currency", currency_in_text(text), 0.7)
    rule(bought, "vendor", F.get(head, F.lit(0))["text"], 0.6)
    rule(("contract",), "parties", parties, 0.7)
    for field, pattern in CONTRACT_RULES.items():
        rule(("contract",), field, group(text, pattern), 0.7)
    rule(("contract",), "currency", currency_in_text(text), 0.65)
    rule(("report",), "title", F.get(title, F.lit(0))["text"], 0.6)
    rule(bought, "total", group(text, TOTAL), 0.6)
    rule(("receipt",), "payment_method", method, 0.6)
    return F.array_compact(F.array(*found))


def with_candidates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, doc_type) with the arrays pairs and rules; still one narrow row a document."""
    staged = docs.select("doc_id", "doc_type", "text", elements(F.coalesce("text", F.lit(""))).alias("elements"))
    return staged.select("doc_id", "doc_type", key_values(F.col("elements")).alias("pairs"), _rules(F.col("doc_type"), F.coalesce("text", F.lit("")), F.col("elements")).alias("rules"))


def extract_fields(docs: DataFrame, with_documents: bool = False) -> DataFrame:
    """(doc_id, doc_type, name, value_str, value_num, confidence, source): at most one row a document and field.

    With with_documents, a row with a null name for each document as well, so that one pass over the texts
    tells the documents' types too.

    docs: doc_id, text, doc_type (null: no field; no such column: classified here). Every row is a document of
    its own. All is worked out within the row: nothing is joined, shuffled or grouped.
    """
    if "doc_type" not in docs.columns:
        docs = docs.select("doc_id", "text", F.inline(F.array(classify(F.col("text")))))
    ready = with_candidates(docs).select("doc_id", "doc_type", _hits(F.col("doc_type"), F.col("pairs"), F.col("rules")).alias("hits"))
    names = F.coalesce(F.try_element_at(_literal_map({t: F.array(*[F.lit(n) for n in fields]) for t, fields in FIELDS.items()}), F.col("doc_type")), F.array().cast("array<string>"))
    if with_documents:
        names = F.concat(names, F.array(F.lit(DOCUMENT)))
    # of a field's hits only the first by label is read; if it must be dropped, the first rule may still give the field
    of_field = lambda n, is_rule: F.get(F.filter("hits", lambda h: (h["field"] == n) & ((h["pass"] == RULE) == is_rule)), F.lit(0))
    tried = F.transform(names, lambda n: F.struct(n.alias("name"), F.array_compact(F.array(of_field(n, False), of_field(n, True))).alias("tries")))
    wanted = F.filter(tried, lambda t: (F.size(t["tries"]) > 0) | (t["name"] == DOCUMENT))
    rows = ready.select("doc_id", "doc_type", F.inline(wanted))

    def read(hit: Column) -> Column:
        is_rule = hit["pass"] == RULE
        as_found = F.struct(hit["raw"].alias("value_str"), F.lit(None).cast("double").alias("value_num"), F.lit(0.0).alias("penalty"))
        value = F.when(is_rule & F.col("name").isin("vendor", "title", "parties"), as_found).otherwise(coerce(F.col("name"), F.when(is_rule, hit["raw"]).otherwise(F.btrim(hit["raw"]))))
        return bind(value, lambda v: F.struct(v["value_str"], v["value_num"], F.round(F.least(F.lit(0.98), F.greatest(F.lit(0.05), hit["confidence"] - v["penalty"])), 3).alias("confidence")))

    good = lambda v: (F.coalesce(v["value_str"], F.lit("")) != "") | v["value_num"].isNotNull()
    # the generator keeps the reading in one place of the plan: nothing above it is pushed into it
    best = F.inline(F.array(F.get(F.filter(F.transform("tries", read), good), F.lit(0))))
    out = rows.select("doc_id", "doc_type", "name", best)
    kept = (F.col("value_str").isNotNull() | F.col("value_num").isNotNull()) | (F.col("name") == DOCUMENT)
    return out.where(kept).select("doc_id", "doc_type", F.nullif(F.col("name"), F.lit(DOCUMENT)).alias("name"), "value_str", "value_num", "confidence", F.lit("regex").alias("source"))


EXACT, NEAR, RULE = 1, 2, 3


def _literal_map(entries: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])


def _labels_by_word() -> Column:
    """map<doc_type, map<first word, array<struct<field, rank, label>>>>: a constant of the plan, under 200 labels."""
    by: dict[str, dict[str, list[Column]]] = {}
    for doc_type, field, rank, label in label_rows():
        entry = F.struct(F.lit(field).alias("field"), F.lit(rank).alias("rank"), F.lit(label).alias("label"))
        by.setdefault(doc_type, {}).setdefault(re.match(r"[^ (]+", label)[0], []).append(entry)
    return _literal_map({t: _literal_map({w: F.array(*entries) for w, entries in words.items()}) for t, words in by.items()})


def _hits(doc_type: Column, pairs: Column, rules: Column) -> Column:
    """array<struct<pass, rank, pos, field, raw, confidence>>, the best first: what labels and rules found.

    A key meets the labels that begin with its first word, and either is the label or begins with it.
    """
    known = sorted({label for *_, label in label_rows()})
    labels = F.try_element_at(_labels_by_word(), doc_type)
    none = F.array().cast("array<struct<field:string,rank:int,label:string>>")

    def near(nkey: Column, label: Column) -> Column:
        starts = nkey.startswith(F.concat(label, F.lit(" "))) | nkey.startswith(F.concat(label, F.lit("(")))
        return starts & (F.length(label) >= 3) & (F.length(nkey) - F.length(label) <= 12) & ~nkey.isin(known)

    def of_pair(p: Column) -> Column:
        of_word = F.coalesce(F.try_element_at(labels, F.regexp_extract(p["nkey"], r"^[^ (]+", 0)), none)
        met = F.filter(of_word, lambda b: (p["nkey"] == b["label"]) | near(p["nkey"], b["label"]))

        def hit(b: Column) -> Column:
            exact = p["nkey"] == b["label"]
            confidence = F.when(exact, F.greatest(F.lit(0.55), 0.92 - 0.04 * b["rank"])).otherwise(F.greatest(F.lit(0.5), 0.82 - 0.04 * b["rank"]))
            return F.struct(F.when(exact, EXACT).otherwise(NEAR).alias("pass"), b["rank"].alias("rank"), p["pos"].alias("pos"), b["field"].alias("field"), p["value"].alias("raw"), confidence.alias("confidence"))

        return F.transform(met, hit)

    by_rule = F.transform(rules, lambda r: F.struct(F.lit(RULE).alias("pass"), F.lit(0).alias("rank"), r["ord"].alias("pos"), r["field"].alias("field"), r["raw"].alias("raw"), r["confidence"].alias("confidence")))
    return F.array_sort(F.concat(F.flatten(F.transform(pairs, of_pair)), by_rule))


def extract_with_answers(docs: DataFrame, source: str = "extractor") -> tuple[DataFrame, DataFrame]:
    """(fields, methods) of docs (doc_id, doc_type, text, answer): a model's answer where it can be used, else the text's fields.

    methods: doc_id, method: 'model', 'heuristic' (no answer was given) or 'heuristic_after_bad_answer'.
    """
    good = F.coalesce(usable_answer(F.col("answer")), F.lit(False))
    method = F.when(F.col("answer").isNull(), "heuristic").when(good, "model").otherwise("heuristic_after_bad_answer")
    told = docs.withColumn("method", method)
    said = fields_from_answer(told.where("method = 'model'").select("doc_id", "doc_type", "answer"), source=source)
    read = extract_fields(told.where("method <> 'model'").select("doc_id", "doc_type", "text"))
    return said.select(*read.columns).unionByName(read), told.select("doc_id", "method")


_ANSWER = "struct<fields:array<struct<name:string,value:string,confidence:string>>>"


def usable_answer(answer: Column) -> Column:
    """Whether an answer has a list of fields of which no confidence is anything but a number in 0..1; null for no JSON."""
    return bind(F.from_json(answer, _ANSWER)["fields"], lambda f: ~F.exists(f, lambda e: e["confidence"].isNotNull() & ~F.coalesce(e["confidence"].try_cast("double").between(0, 1), F.lit(False))))


def prompt(doc_type: Column, text: Column, max_chars: int = 12_000) -> Column:
    """What a model is asked: the fields of the type and the text, no longer than a model is given."""
    names = F.create_map(*[x for t, fields in FIELDS.items() for x in (F.lit(t), F.lit(", ".join(fields)))])
    return F.format_string("Read these fields of a %s as JSON {\"fields\": [{\"name\", \"value\", \"confidence\"}]}: %s\n\n%s", doc_type, F.try_element_at(names, doc_type), F.substring(text, 1, max_chars))


def fields_from_answer(answers: DataFrame, id_col: str = "doc_id", source: str = "extractor") -> DataFrame:
    """(id, doc_type, name, value_str, value_num, confidence, source) from models' JSON answers.

    answers: id, doc_type, answer: {"fields": [{"name", "value", "confidence"}]}. Unknown names and null or
    empty values are left out; a confidence that is no number in 0..1 rejects the whole answer.
    """
    parsed = answers.where(F.coalesce(usable_answer(F.col("answer")), F.lit(False))).select(id_col, "doc_type", F.from_json("answer", _ANSWER)["fields"].alias("f"))
    rows = parsed.select(id_col, "doc_type", F.posexplode("f").alias("pos", "e"))
    allowed = label_table(answers.sparkSession).select("doc_type", F.col("field").alias("name")).distinct()
    rows = rows.select(id_col, "doc_type", "pos", F.col("e.name").alias("name"), F.col("e.value").alias("raw"), F.coalesce(F.col("e.confidence").try_cast("double"), F.lit(0.7)).alias("confidence"))
    rows = rows.where("raw is not null and raw <> ''").join(F.broadcast(allowed), ["doc_type", "name"], "left_semi")
    number = F.when(F.col("name").isin(*NUMERIC_FIELDS), F.coalesce(F.col("raw").try_cast("double"), normalize_amount(F.col("raw")))).when(F.col("name") == "term_months", F.floor(F.col("raw").try_cast("double")).cast("double"))
    text = F.when(F.col("name").isin(*NUMERIC_FIELDS, "term_months"), F.lit(None)).when(F.col("name").isin(*DATE_FIELDS), F.coalesce(normalize_date(F.col("raw")), "raw")).otherwise(F.col("raw"))
    out = rows.select(id_col, "doc_type", "name", "pos", text.cast("string").alias("value_str"), number.alias("value_num"), F.round("confidence", 3).alias("confidence"), F.lit(source).alias("source"))
    return out.where("value_str is not null or value_num is not null")
