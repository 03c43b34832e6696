"""Labelled documents and tables made up from a seed: any number, each the same whenever it is made again.

Every choice is a hash of (seed, number, what is chosen), so rows are independent of each other: a range of
numbers is all that is read, nothing is shuffled, and a lost task makes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.dims import DOC_TYPES
from paperloom.functions.scalars import bind
from paperloom.plans.render import day, dotted_nit, money

# Invented firms, people, places and goods.
FIRMS = ["Aurelia Mills", "Barranca Supply", "Cobalt Harbour", "Delmora Foods", "Estero Print", "Fenwick Tools", "Granada Textiles", "Hollow Pine"]
PEOPLE = ["Ines Calder", "Jonas Weil", "Karla Montes", "Liam Prior", "Mara Sandoval", "Nils Ebert"]
PLACES = ["Bogotá", "Valencia", "Leeds", "Hamburg"]
GOODS = [("Shelf unit", "84.90"), ("Copper wire", "12.35"), ("Desk lamp", "31.00"), ("Paint 5 l", "27.45"), ("Hinge set", "4.20"), ("Label roll", "9.99"), ("Steel pipe", "56.10"), ("Work gloves", "7.75"), ("Site survey", "320.00"), ("Repair hour", "65.50")]
LINES = ["Revenue", "Cost of sales", "Gross margin", "Overheads", "Operating profit", "Net profit"]
CODES = ["USD", "EUR", "COP", "GBP", "MXN"]
METHODS = ["cash", "card", "visa", "mastercard", "transfer"]
STATES = ["Open", "Done", "Blocked"]
DEPARTMENTS = ["Finance", "Legal", "Operations", "Research"]
LAWS = ["State of Delaware", "Kingdom of Spain", "Republic of Colombia"]
TEMPLATES = {
    "invoice": ["pairs", "spanish", "block", "prose"],
    "receipt": ["till", "pairs", "prose"],
    "contract": ["recital", "letter", "schedule"],
    "form": ["application", "no colons", "request"],
    "report": ["annual", "memo", "technical"],
}
ITEM_HEADERS = ["Description", "Qty", "Unit price", "Amount"]
#: One invoice in this many states a total that is 10 too high.
WRONG_TOTAL_ONE_IN = 5


def _hash(seed: int, what: str, number: Column | None = None) -> Column:
    return F.xxhash64(F.lit(seed), F.col("id") if number is None else number, F.lit(what))


def _below(seed: int, what: str, n: int) -> Column:
    return F.pmod(_hash(seed, what), F.lit(n)).cast("int")


def _pick(seed: int, what: str, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), _below(seed, what, len(values)))


def _sample(seed: int, what: str, rows: list[Column], n: Column) -> Column:
    """n of the rows without replacement: those of the least hashes, in the order of these."""
    ranked = F.array_sort(F.array(*[F.struct(_hash(seed, f"{what}{i}").alias("h"), r.alias("row")) for i, r in enumerate(rows)]))
    return F.transform(F.slice(ranked, 1, n), lambda e: e["row"])


def line_items(seed: int, least: int = 2, most: int = 4) -> Column:
    """array<struct<name, qty, unit, amount>> for the column id: goods without repeats, amounts rounded to cents."""
    goods = [F.struct(F.lit(name).alias("name"), (_below(seed, f"qty{i}", 12) + 1).alias("qty"), F.lit(unit).cast("decimal(12,2)").alias("unit")) for i, (name, unit) in enumerate(GOODS)]
    chosen = _sample(seed, "good", goods, _below(seed, "items", most - least + 1) + least)
    return F.transform(chosen, lambda g: F.struct(g["name"], g["qty"], g["unit"], F.round(g["qty"] * g["unit"], 2).cast("decimal(12,2)").alias("amount")))


def items_sum(items: Column) -> Column:
    return F.aggregate(items, F.lit("0").cast("decimal(18,2)"), lambda a, g: (a + g["amount"]).cast("decimal(18,2)"))


def item_rows(items: Column) -> Column:
    return F.transform(items, lambda g: F.array(g["name"], g["qty"].cast("string"), g["unit"].cast("string"), g["amount"].cast("string")))


def _lines(*parts: str | Column) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _truth(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def _texts() -> dict[tuple[str, str], Column]:
    """The text of each type and template, from the columns of `facts`."""
    c = F.col
    style = F.when(c("style") == 0, day(c("issue"), "iso")).when(c("style") == 1, day(c("issue"), "dmy")).otherwise(day(c("issue"), "long"))
    rows = F.array_join(F.transform("items", lambda g: F.concat(F.rpad(g["name"], 18, " "), F.lpad(g["qty"].cast("string"), 4, " "), F.lit(" x "), F.lpad(g["amount"].cast("string"), 10, " "))), "\n")
    return {
        ("invoice", "pairs"): _lines(F.upper("vendor"), _say("NIT: ", c("nit")), "", _say("Invoice No: ", c("number")), _say("Invoice Date: ", style), _say("Due Date: ", day(c("due"), "iso")), _say("Bill To: ", c("client")), _say("Payment Terms: ", c("terms")), "", rows, "", _say("Subtotal: ", money(c("subtotal"))), _say("Tax: ", money(c("tax"))), _say("Total Due: ", c("currency"), " ", money(c("stated")))),
        ("invoice", "spanish"): _lines("FACTURA", _say("Vendedor: ", c("vendor")), _say("NIT: ", c("nit")), _say("Factura No: ", c("number")), _say("Fecha: ", day(c("issue"), "dmy")), _say("Vencimiento: ", day(c("due"), "dmy")), _say("Moneda: ", c("currency")), _say("Condiciones de pago: ", c("terms")), _say("Subtotal: ", money(c("subtotal"), "eu")), _say("IVA: ", money(c("tax"), "eu")), _say("Total a pagar: ", money(c("stated"), "eu"))),
        ("invoice", "block"): _lines("INVOICE", "", _say("From: ", c("vendor"), "  Tax ID: ", c("nit")), _say("Invoice #: ", c("number"), "  Date: ", style), _say("Due: ", day(c("due"), "text"), "  Terms: ", c("terms")), "", _say("Sub Total: ", money(c("subtotal"))), _say("VAT: ", money(c("tax"))), _say("Amount Due: ", money(c("stated")), " ", c("currency"))),
        ("invoice", "prose"): _lines(_say("Dear ", c("client"), ","), "", _say("please find invoice ", c("number"), " of ", c("vendor"), " dated ", day(c("issue"), "long"), "."), _say("The subtotal of ", money(c("subtotal")), " and tax of ", money(c("tax")), " are payable by ", day(c("due"), "long"), "."), _say("Total due: ", c("currency"), " ", money(c("stated")))),
        ("receipt", "till"): _lines(F.upper("vendor"), c("place"), "", _say("Receipt #: ", c("number")), _say("Date: ", style), rows, _say("TOTAL: ", c("currency"), " ", money(c("subtotal"))), _say("Paid by: ", F.upper("method"))),
        ("receipt", "pairs"): _lines("RECEIPT", _say("Merchant: ", c("vendor")), _say("Receipt Number: ", c("number")), _say("Date: ", style), _say("Amount: ", money(c("subtotal")), " ", c("currency")), _say("Payment method: ", c("method"))),
        ("receipt", "prose"): _lines(_say("We thank you for buying at ", c("vendor"), " on ", day(c("issue"), "long"), "."), _say("Receipt ", c("number"), " over a total of ", money(c("subtotal")), " ", c("currency"), " was settled by ", c("method"), ".")),
        ("contract", "recital"): _lines("SERVICES AGREEMENT", _say("Contract No: ", c("number")), "", _say("This agreement is made as of ", day(c("issue"), "long"), " between ", c("vendor"), " and ", c("client"), "."), _say("The term of this agreement is ", c("months"), " months."), _say("The contract value is ", c("currency"), " ", money(c("subtotal")), "."), _say("Governing Law: ", c("law"))),
        ("contract", "letter"): _lines(_say("Agreement No: ", c("number")), _say("Dear ", c("client"), ", this letter sets out our contract, effective ", day(c("issue"), "long"), "."), _say("Duration: ", c("months"), " months"), _say("Total fees of ", c("currency"), " ", money(c("subtotal")), "."), _say("Jurisdiction: ", c("law"))),
        ("contract", "schedule"): _lines("CONTRACT SCHEDULE", _say("Contract ID: ", c("number")), _say("Parties: ", c("vendor"), "; ", c("client")), _say("Effective Date: ", style), _say("Term: ", c("months"), " months"), _say("Total Value: ", c("currency"), " ", money(c("subtotal"))), _say("Governing Law: ", c("law"))),
        ("form", "application"): _lines("APPLICATION FORM", _say("Form No: ", c("number")), _say("Submitted by: ", c("client")), _say("Date: ", style), _say("Department: ", c("department"))),
        ("form", "no colons"): _lines("REQUEST", _say("Form No    ", c("number")), _say("Submitted by    ", c("client")), _say("Date    ", day(c("issue"), "iso"))),
        ("form", "request"): _lines("Purchase request form", _say("Ref No: ", c("number"), "  Date: ", day(c("issue"), "iso")), _say("Requested by: ", c("client"), "  Dept: ", c("department")), "Please complete and return."),
        ("report", "annual"): _lines(_say("Annual Report ", c("vendor")), _say("Prepared by: ", c("client")), _say("Published: ", day(c("issue"), "long")), _say("Fiscal Year: ", F.year("issue")), "", "Executive summary", "Findings are listed below."),
        ("report", "memo"): _lines("MEMO", _say("Subject: Review of ", c("vendor")), _say("From: ", c("client")), _say("Date: ", style), "", "The findings of this report are final."),
        ("report", "technical"): _lines(_say("Title: Test report of ", c("vendor")), _say("Author: ", c("client")), _say("Report Date: ", style), "Table of contents"),
    }


def generate_documents(spark: SparkSession, n_per_type: int, seed: int = 42) -> DataFrame:
    """(case_id, origin, doc_type, template, text, ground_truth, pairs, case_table, notes): n_per_type of each type."""
    base = spark.range(n_per_type * len(DOC_TYPES)).withColumn("doc_type", F.get(F.array(*[F.lit(t) for t in DOC_TYPES]), (F.col("id") % len(DOC_TYPES)).cast("int")))
    template = F.coalesce(*[F.when(F.col("doc_type") == t, _pick(seed, "template", names)) for t, names in TEMPLATES.items()])
    prefix = F.element_at(F.create_map(*[F.lit(x) for pair in zip(DOC_TYPES, ("INV-2026-", "R-", "MSA-", "F-", "RP-")) for x in pair]), F.col("doc_type"))
    facts = base.select(
        "id", "doc_type", template.alias("template"), _pick(seed, "vendor", FIRMS).alias("vendor"), _pick(seed, "client", PEOPLE).alias("client"), _pick(seed, "place", PLACES).alias("place"),
        _pick(seed, "currency", CODES).alias("currency"), _pick(seed, "method", METHODS).alias("method"), _pick(seed, "department", DEPARTMENTS).alias("department"), _pick(seed, "law", LAWS).alias("law"),
        F.date_add(F.lit("2026-01-01").cast("date"), _below(seed, "issue", 270)).alias("issue"), _below(seed, "style", 3).alias("style"), (F.lit(15) * (_below(seed, "terms", 4) + 1)).alias("net"),
        (_below(seed, "months", 48) + 1).alias("months"), dotted_nit(F.lit(800_000_000) + F.pmod(_hash(seed, "nit"), F.lit(100_000_000))).alias("nit"), line_items(seed).alias("items"),
        F.concat(prefix, (F.col("id") + 100).cast("string")).alias("number"), _below(seed, "wrong", WRONG_TOTAL_ONE_IN).alias("wrong"),
    )
    rate = F.get(F.array(*[F.lit(r).cast("decimal(4,2)") for r in ("0.00", "0.05", "0.19", "0.21")]), _below(seed, "rate", 4))
    facts = facts.withColumns({"due": F.date_add("issue", F.col("net")), "terms": F.concat(F.lit("Net "), F.col("net").cast("string")), "subtotal": items_sum(F.col("items")), "rate": rate})
    facts = facts.withColumn("tax", F.round(F.col("subtotal") * F.col("rate"), 2).cast("decimal(18,2)")).withColumn("total", (F.col("subtotal") + F.col("tax")).cast("decimal(18,2)"))
    is_wrong = (F.col("doc_type") == "invoice") & (F.col("wrong") == 0)
    facts = facts.withColumn("stated", F.when(is_wrong, F.col("total") + 10).otherwise(F.col("total")).cast("decimal(18,2)"))
    text = F.coalesce(*[F.when((F.col("doc_type") == t) & (F.col("template") == name), body) for (t, name), body in _texts().items()])
    c, iso = F.col, day(F.col("issue"), "iso")
    truths = {
        "invoice": _truth(invoice_number=c("number"), vendor=c("vendor"), vendor_tax_id=c("nit"), issue_date=iso, due_date=day(c("due"), "iso"), currency=c("currency"), subtotal=c("subtotal"), tax=c("tax"), total=c("stated"), payment_terms=c("terms")),
        "receipt": _truth(receipt_number=c("number"), vendor=c("vendor"), issue_date=iso, total=c("subtotal"), currency=c("currency"), payment_method=c("method")),
        "contract": _truth(contract_number=c("number"), parties=F.concat("vendor", F.lit("; "), "client"), effective_date=iso, term_months=c("months"), total_value=c("subtotal"), currency=c("currency"), governing_law=c("law")),
        "form": _truth(form_id=c("number"), submitter=c("client"), date=iso, department=c("department")),
        "report": _truth(title=F.when(c("template") == "annual", _say("Annual Report ", c("vendor"))).when(c("template") == "memo", _say("Review of ", c("vendor"))).otherwise(_say("Test report of ", c("vendor"))), author=c("client"), date=iso, fiscal_year=F.when(c("template") == "annual", F.year("issue").cast("string"))),
    }
    truth = F.map_filter(F.coalesce(*[F.when(c("doc_type") == t, m) for t, m in truths.items()]), lambda k, v: v.isNotNull())
    pairs = F.when(c("template") == "application", F.array(F.array(F.lit("Form No"), c("number")), F.array(F.lit("Submitted by"), c("client")), F.array(F.lit("Department"), c("department"))))
    held = F.when(c("doc_type") == "invoice", F.struct(F.array(*[F.lit(h) for h in ITEM_HEADERS]).alias("headers"), item_rows(c("items")).alias("body_rows"), (_below(seed, "ruled", 10) < 7).alias("ruled")))
    return facts.select(
        F.concat(F.lit("gen-"), c("doc_type"), F.lit("-"), F.lpad(F.expr(f"id div {len(DOC_TYPES)}").cast("string"), 6, "0")).alias("case_id"), F.lit("synthetic").alias("origin"), "doc_type", "template",
        text.alias("text"), truth.alias("ground_truth"), pairs.alias("pairs"), held.alias("case_table"), F.when(is_wrong, F.array(F.lit("total does not add up"))).otherwise(F.array().cast("array<string>")).alias("notes"),
    )


def generate_tables(spark: SparkSession, n: int, seed: int = 43) -> DataFrame:
    """(table_id, kind, headers, rows, ruled): tables of goods, accounts and schedules; every third has no rules."""
    kind = _pick(seed, "kind", ["items", "accounts", "schedule"])

    def account(i: int, name: str) -> Column:
        a, b = _below(seed, f"a{i}", 8900) + 100, _below(seed, f"b{i}", 8900) + 100
        return F.array(F.lit(name), F.format_number(a, 0), F.format_number(b, 0), F.format_string("%+.1f%%", (b - a) * 100.0 / a))

    phases = [F.array(F.lit(f"Phase {k}"), _pick(seed, f"owner{k}", [p.split()[0] for p in PEOPLE]), day(F.date_add(F.lit("2026-01-01").cast("date"), _below(seed, f"day{k}", 360)), "iso"), _pick(seed, f"state{k}", STATES)) for k in range(1, 6)]
    headers = {"items": ITEM_HEADERS, "accounts": ["Line", "FY2024", "FY2025", "Change"], "schedule": ["Milestone", "Owner", "Due date", "Status"]}
    bodies = {
        "items": bind(line_items(seed, 2, 6), item_rows),
        "accounts": _sample(seed, "line", [account(i, name) for i, name in enumerate(LINES)], _below(seed, "lines", 4) + 3),
        "schedule": F.slice(F.array(*phases), 1, _below(seed, "phases", 3) + 3),
    }
    rows = spark.range(1, n + 1).withColumn("kind", kind)
    return rows.select(
        F.concat(F.lit("gen-table-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("table_id"),
        "kind",
        F.coalesce(*[F.when(F.col("kind") == k, F.array(*[F.lit(h) for h in v])) for k, v in headers.items()]).alias("headers"),
        F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in bodies.items()]).alias("rows"),
        (F.col("id") % 3 != 0).alias("ruled"),
    )


def as_records(rows: DataFrame) -> DataFrame:
    """(record): each row as a JSON object with its keys in order, null parts left out."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("record"))
