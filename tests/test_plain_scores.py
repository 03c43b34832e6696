"""Documents scored in one pass come out as the stages score them, whatever their texts hold."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.dims import DOC_TYPES, KEYWORDS, LABELS
from paperloom.operators.classify import needed_texts
from paperloom.operators.plain import score_of
from paperloom.plans.pipeline import run, run_scores

VALUES = (
    "INV-2026-7 | FV 0007 | 2026-03-14 | 14/03/2026 | 03.14.2026 | 2026-02-30 | 0000-05-05 | March 14, 2026 | 14 de marzo de 2026 | 3 Foo 2026 | soon | 2026-W07-2 | 20260314 | USD | eur | dollars | "
    "$ 1,250.50 | 1.250,5 | -3 | - 12.00 | USD 100.00 | 19.00 | 119.00 | 119.05 | 119.06 | 2499 | n/a | 900.123.456-8 | 900123456-7 | 90 012 345 6-8 | AB-12/34 | ?! | Net 30. | ACME Ltd.,; | Visa ending 1 | "
    "bank transfer | 12 months | 2 Years | 900 months | 0 months | FY 2024 | State of Delaware | a: b | x  Date:  2026-01-02 | ; | Mr. Smith | " + "long " * 45 + " | 99999999999999999999.00 | 1\x1f2"
).split(" | ")
LINES = (
    "INVOICE | Acme Consulting | Acme Consulting. | ACME 7 | - milk | a) item | Item  2  3.00 | This is a line of text that says something. | http://a.b | REQUEST FOR PAYMENT | Total due now 12.50 | total: | amount in EUR | pay $ 5 | "
    "between Alpha  Inc (the client) and Beta Corp. | This agreement is made as of March 14, 2026 between Alpha and Beta. | Effective date of 2026-01-05; | the term of this agreement shall be 24 months. | The contract value is USD 1,000.00. | "
    "Governing law: of the State of Texas. | paid in cash | To:  Mr. Smith  Date:  9/3/92 | Total:\t12.00\tTax:\t1.00 | Total:  | Total:    12.50   Currency  | 1. Total: 5 |  Due : 2026-01-01 | invoice invoices invoice-invoice | Yearly Summary Of Things | thank you for shopping"
).split(" | ")


def random_text(rng: random.Random) -> str:
    labels = sorted({label for names in LABELS.values() for label in names})
    words = [t for pairs in KEYWORDS.values() for p, _ in pairs for t in needed_texts(p)]

    def line() -> str:
        kind = rng.random()
        if kind < 0.6:
            label = rng.choice(labels)
            label = rng.choice((label, label.title(), label.upper(), label + rng.choice((" no", " (19%)", " of goods sold now", "s"))))
            return rng.choice(("", "", "  ", "\t")) + label + rng.choice((": ", ":", " : ", ":\t", ":  ")) + rng.choice(VALUES)
        return rng.choice(LINES) if kind < 0.85 else rng.choice(words) + rng.choice((" ", "_", ", ", "")) + rng.choice(words)

    breaks = rng.choice(("\n", "\n", "\n", "\r\n", "\n\n", "\x0b", "\r", "\x1d"))
    text = breaks.join(line() for _ in range(rng.randint(1, 14))) + rng.choice(("", "\n"))
    return text.replace("a", "á", 1) if rng.random() < 0.1 else text


@pytest.mark.parametrize("given", [None, "requested_type", "doc_type"])
def test_one_pass_scores_as_the_stages_do(spark, given):
    rng = random.Random(f"{given}")
    kinds = {"requested_type": (*DOC_TYPES, None, "memo", ""), "doc_type": (*DOC_TYPES, None, "memo", "")}.get(given, (None,))
    rows = [(i, random_text(rng), rng.choice(kinds), rng.choice(("ocr", "text")), rng.choice((0.5, 0.9, None))) for i in range(600)]
    rows += [(9001, "", None, "text", 0.9), (9002, None, None, "text", 0.9), (None, "Invoice No: 12", None, "text", 0.9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, given string, source string, mean_confidence double")
    docs = docs.withColumnRenamed("given", given) if given else docs.drop("given")
    want, got = run(docs).scores, run_scores(docs)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    texts = {i: t for i, t, *_ in rows}
    differ = [(texts[r.doc_id], r) for r in {*got.collect()} ^ {*want.collect()}]
    assert not differ, differ[:4]
    assert got.count() == 600


def test_most_texts_are_scored_in_the_pass_itself():
    rng = random.Random(7)
    texts = [t for _ in range(300) if (t := random_text(rng)).isascii() and "\r" not in t]
    assert sum(score_of(t) is not None for t in texts) > 0.85 * len(texts)
    assert score_of("ünlü") is None and score_of("Between A\rand B", "contract") is None


def test_plain_documents_are_scored_without_a_shuffle(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("Invoice No: INV-"), "id", F.lit("\nTotal Due: USD 12.00")).alias("text"))
    scores = run_scores(docs)
    assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_type, r.n_errors) for r in scores.collect()} == {("invoice", 5)}
