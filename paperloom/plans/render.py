"""Texts of business documents made from relational rows, with the truth they hold; one row a document."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.scalars import nit_check_digit
from paperloom.session import table


def money(amount: Column, style: str = "us") -> Column:
    text = F.format_number(amount, 2)
    return F.translate(text, ",.", ".,") if style == "eu" else text


def day(date: Column, style: str) -> Column:
    return F.date_format(date, {"iso": "yyyy-MM-dd", "dmy": "dd/MM/yyyy", "long": "MMMM dd, yyyy"}.get(style, "dd MMMM yyyy"))


def dotted_nit(base: Column) -> Column:
    """A nine-digit base written 999.999.999-d with its check digit."""
    b = base.cast("string")
    return F.concat(b.substr(1, 3), F.lit("."), b.substr(4, 3), F.lit("."), b.substr(7, 3), F.lit("-"), nit_check_digit(b).cast("string"))


def _lines(*parts: str | Column) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def document(text_of: Callable[[], Column]) -> Callable[[DataFrame], DataFrame]:
    """A renderer (facts -> doc_id, text) from the expression of its text, which it keeps as its attribute text_of."""

    @functools.wraps(text_of)
    def render(facts: DataFrame) -> DataFrame:
        return facts.select(F.col("o_orderkey").alias("doc_id"), text_of().alias("text"))

    render.text_of = text_of
    return render


def order_facts(spark: SparkSession, d: str) -> DataFrame:
    """What an order says as an invoice: number, vendor, dates, sums. Orders without items are left out."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("subtotal"))
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.initcap(F.translate("n_name", "_0123456789", " ABCDEFGHIJ")).alias("nation"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("issue"))
    joined = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), "c_nationkey")
    rows = joined.withColumns(
        {
            "tax": F.round(F.col("subtotal") * F.lit("0.19").cast("decimal(3,2)"), 2).cast("decimal(18,2)"),
            "due": F.date_add("issue", 30),
            "vendor": F.concat("nation", F.lit(" Trading House")),
            "nit": dotted_nit(F.col("o_custkey") + 800_000_000),
            "currency": F.element_at(F.array(*[F.lit(c) for c in ("USD", "EUR", "COP")]), (F.col("o_orderkey") % 3 + 1).cast("int")),
        }
    )
    return rows.withColumn("total", (F.col("subtotal") + F.col("tax")).cast("decimal(18,2)"))


@document
def invoices_kv() -> Column:
    text = _lines(
        F.upper("vendor"),
        F.concat(F.lit("NIT: "), "nit"),
        "",
        F.concat(F.lit("Invoice No: INV-2026-"), "o_orderkey"),
        F.concat(F.lit("Invoice Date: "), day(F.col("issue"), "iso")),
        F.concat(F.lit("Due Date: "), day(F.col("due"), "dmy")),
        F.concat(F.lit("Bill To: "), "c_name"),
        "Payment Terms: Net 30",
        "",
        F.concat(F.lit("Subtotal: "), money(F.col("subtotal"))),
        F.concat(F.lit("Tax (19%): "), money(F.col("tax"))),
        F.concat(F.lit("Total Due: "), "currency", F.lit(" "), money(F.col("total"))),
        F.concat(F.lit("Currency: "), "currency"),
    )
    return text


@document
def invoices_es() -> Column:
    text = _lines(
        "FACTURA DE VENTA",
        F.concat(F.lit("NIT: "), "nit"),
        F.concat(F.lit("Factura No: FV-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")),
        F.concat(F.lit("Fecha: "), day(F.col("issue"), "dmy")),
        F.concat(F.lit("Vencimiento: "), day(F.col("due"), "iso")),
        F.concat(F.lit("Moneda: "), "currency"),
        F.concat(F.lit("Subtotal: "), money(F.col("subtotal"), "eu")),
        F.concat(F.lit("IVA: "), money(F.col("tax"), "eu")),
        F.concat(F.lit("Total a pagar: "), money(F.col("total"), "eu")),
        "Condiciones de pago: Net 30",
    )
    return text


@document
def invoices_block() -> Column:
    text = _lines(
        "INVOICE",
        "",
        F.concat(F.lit("From: "), "vendor"),
        F.concat(F.lit("Tax ID: "), "nit"),
        F.concat(F.lit("Invoice #: INV-"), "o_orderkey", F.lit("-X  Date: "), day(F.col("issue"), "long")),
        F.concat(F.lit("Due:  "), day(F.col("due"), "text")),
        "Terms: Net 30",
        F.concat(F.lit("Sub Total: "), money(F.col("subtotal"))),
        F.concat(F.lit("VAT: "), money(F.col("tax"))),
        F.concat(F.lit("Amount Due: "), money(F.col("total")), F.lit(" "), "currency"),
    )
    return text


@document
def invoices_prose() -> Column:
    text = F.concat(
        F.lit("INVOICE\n\nThe invoice of "), "vendor", F.lit(" asks for "), "currency", F.lit(" in subtotal of "), money(F.col("subtotal")), F.lit(" plus tax; a grand total of "), money(F.col("total")), F.lit(" is payable soon.")
    )
    return text


@document
def receipts() -> Column:
    method = F.element_at(F.array(*[F.lit(m) for m in ("cash", "Visa ending 1234", "bank transfer", "Mastercard")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    text = _lines(
        F.col("vendor"),
        F.concat(F.lit("Receipt No: R-"), F.col("o_orderkey") + 100),
        F.concat(F.lit("Date: "), day(F.col("issue"), "dmy")),
        F.concat(F.lit("Total: $ "), money(F.col("total"))),
        F.concat(F.lit("Paid by: "), method),
    )
    return text


@document
def contracts() -> Column:
    text = _lines(
        "SERVICES AGREEMENT",
        F.concat(F.lit("Contract No: MSA-"), F.col("o_orderkey") + 10),
        "",
        F.concat(F.lit("This agreement is made as of "), day(F.col("issue"), "long"), F.lit(" between "), "vendor", F.lit(" and Orion Holdings.")),
        F.concat(F.lit("The term of this agreement shall be "), (F.col("o_orderkey") % 36 + 1).cast("string"), F.lit(" months.")),
        F.concat(F.lit("The contract value is "), "currency", F.lit(" "), money(F.col("total")), F.lit(".")),
        "Governing Law: State of Delaware",
    )
    return text


@document
def forms() -> Column:
    text = _lines(
        "APPLICATION FORM",
        F.concat(F.lit("Form No: F-"), F.col("o_orderkey") + 100),
        F.concat(F.lit("Submitted by: "), "vendor"),
        F.concat(F.lit("Date: "), day(F.col("issue"), "text")),
        "Department: Finance;",
    )
    return text


@document
def forms_without_colons() -> Column:
    text = _lines("REQUEST", F.concat(F.lit("Form No    F-"), "o_orderkey"), F.concat(F.lit("Submitted by    "), "vendor"), F.concat(F.lit("Date    "), day(F.col("issue"), "iso")))
    return text


@document
def reports() -> Column:
    text = _lines(
        F.concat(F.lit("Yearly Summary Of "), "nation"),
        "",
        F.concat(F.lit("Prepared by: "), "c_name"),
        F.concat(F.lit("Published: "), day(F.col("issue"), "long")),
        F.concat(F.lit("Fiscal Year: FY "), F.year("issue")),
    )
    return text


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Rendered documents of all kinds, one an order, with unique ids."""
    kinds = (invoices_kv, receipts, contracts, forms, reports)
    kind = F.col("o_orderkey") % len(kinds)
    # one pass over the facts: each row is rendered by its own kind
    text = F.coalesce(*[F.when(kind == i, k.text_of()) for i, k in enumerate(kinds)])
    return order_facts(spark, d).select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
