"""Annotated forms: linked question-answer pairs, reading order, label counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Centres of one text line lie within this many pixels of the first one.
LINE_TOLERANCE = 12


def explode_entities(forms: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, id, text, label, x0, y0, x1, y1, linking) from forms: doc_id, form array<struct>."""
    rows = forms.select(id_col, F.explode("form").alias("e"))
    box = F.col("e.box")
    return rows.select(
        id_col, F.col("e.id").alias("id"), F.coalesce("e.text", F.lit("")).alias("text"), F.col("e.label").alias("label"), *[F.get(box, F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], F.col("e.linking").alias("linking")
    )


def linked_pairs(entities: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, question, answer) along links from a question to an answer, both with text: one hop, an equi-join."""
    edges = entities.where("label = 'question' and trim(text) <> ''").select(id_col, F.col("id").alias("q"), F.trim("text").alias("question"), F.explode("linking").alias("link"))
    edges = edges.where("link[0] = q").select(id_col, "q", "question", F.col("link")[1].alias("a"))
    answers = entities.where("label = 'answer' and trim(text) <> ''").select(id_col, F.col("id").alias("a"), F.trim("text").alias("answer"))
    return edges.join(answers, [id_col, "a"]).select(id_col, "question", "answer")


def reading_order(entities: DataFrame, id_col: str = "doc_id", tolerance: int = LINE_TOLERANCE) -> DataFrame:
    """(doc_id, text): entities put into lines and the lines below each other.

    Sorted by the vertical centre, an entity opens a line when it is more than the tolerance below the first
    one of the line before; within a line entities go from left to right, two spaces apart. One form's
    entities are folded in one place; a form is a page.
    """
    item = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("cy"), F.col("x0").cast("double").alias("x0"), F.col("text").alias("text"))
    sorted_ = entities.where("trim(text) <> ''").groupBy(id_col).agg(F.sort_array(F.collect_list(item)).alias("items"))
    placed = "array<struct<line:int,x0:double,text:string>>"
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("line"), F.expr("array()").cast(placed).alias("out"))

    def step(acc, e):
        new = acc["anchor"].isNull() | (F.abs(e["cy"] - acc["anchor"]) > tolerance)
        line = acc["line"] + F.when(new, 1).otherwise(0)
        return F.struct(
            F.when(new, e["cy"]).otherwise(acc["anchor"]).alias("anchor"),
            line.alias("line"),
            F.concat(acc["out"], F.array(F.struct(line.alias("line"), e["x0"].alias("x0"), F.trim(e["text"]).alias("text")))).alias("out"),
        )

    cells = F.sort_array(F.aggregate("items", start, step)["out"])
    ranked = sorted_.select(id_col, cells.alias("cells"))
    n_lines = F.coalesce(F.array_max(F.transform("cells", lambda c: c["line"])), F.lit(-1))
    lines = F.transform(F.sequence(F.lit(0), n_lines), lambda i: F.array_join(F.transform(F.filter("cells", lambda c: c["line"] == i), lambda c: c["text"]), "  "))
    return ranked.select(id_col, F.array_join(lines, "\n").alias("text"))


def label_counts(entities: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return entities.groupBy(id_col, "label").agg(F.count("*").alias("n"))
