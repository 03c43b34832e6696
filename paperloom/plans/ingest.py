"""From what is delivered (texts or files) to documents: check, read, route, and take tables out.

The cheap reader comes first; only files whose text layer says too little go on to recognition or vision, as a
filter before the costly step. Readers are functions from the bytes of one file to its pages; none is part of
this package, and without one the route falls back to what there is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.score import input_path, is_scanned
from paperloom.operators.tables import grid_to_table
from paperloom.session import cut
from paperloom.sources.readers import check_pdf, check_text, document_columns, exactly_one, with_grids, with_reader

Reader = Callable[[bytes], list[dict]]


@dataclass(frozen=True)
class Readers:
    """Plug-ins: text_layer and recognised give [{text, confidence, has_tables}] a page, vision the same, tables give grids."""

    text_layer: Reader | None = None
    recognised: Reader | None = None
    vision: Reader | None = None
    tables: dict[str, Reader] | None = None


def table_reader(readers: Readers, backend: str = "auto") -> tuple[str, Reader] | None:
    """The named table reader, or with auto the first one there is; None if there is none."""
    held = readers.tables or {}
    if backend != "auto":
        return (backend, held[backend]) if backend in held else None
    return next(iter(held.items()), None)


def ingest(docs: DataFrame, readers: Readers = Readers(), max_text_chars: int = 200_000, max_pdf_bytes: int = 10 * 1024 * 1024, least_chars: int = 20) -> DataFrame:
    """(doc_id, text, source, pipeline_used, n_pages, mean_confidence, has_tables, error_code) for every row of docs.

    docs: doc_id, text, content (bytes of a PDF)[, force_vision boolean]. Exactly one of text and content must be
    given ('not_one_input' else). Texts are checked and taken as they are (source raw); files are checked, their
    text layer is read, and scanned ones are read again by recognition or vision if there is such a reader. What a
    reader raises is the row's error_code.
    """
    force = F.coalesce(F.col("force_vision"), F.lit(False)) if "force_vision" in docs.columns else F.lit(False)
    one = exactly_one(F.col("text"), F.when(F.octet_length("content") > 0, "pdf"))
    staged = docs.select("doc_id", "text", "content", force.alias("force_vision"), F.when(~one, "not_one_input").alias("bad"))
    is_file = F.octet_length("content") > 0
    texts = staged.where(~F.coalesce(is_file, F.lit(False)) | F.col("bad").isNotNull())
    out = texts.select(
        "doc_id",
        "text",
        F.lit("raw").alias("source"),
        F.lit("text").alias("pipeline_used"),
        F.lit(1).alias("n_pages"),
        F.lit(1.0).alias("mean_confidence"),
        F.lit(False).alias("has_tables"),
        F.coalesce("bad", check_text(F.col("text"), max_text_chars)).alias("error_code"),
    )
    files = staged.where(is_file & F.col("bad").isNull()).select("doc_id", "content", "force_vision", check_pdf(F.col("content"), max_pdf_bytes).alias("bad"))
    refused = files.where("bad is not null").select("doc_id", F.lit(None).cast("array<struct<number:int,text:string,confidence:double,has_tables:boolean>>").alias("pages"), F.lit("text").alias("source"), F.lit("text").alias("pipeline_used"), F.col("bad").alias("error_code"))
    usable = files.where("bad is null")
    if readers.text_layer is None:
        first = usable.select("doc_id", F.lit(None).cast("array<struct<number:int,text:string,confidence:double,has_tables:boolean>>").alias("pages"), F.lit("no_reader").alias("error_code"))
    else:
        first = with_reader(usable, readers.text_layer, with_tables=True)
    # read once: the route decides over what was read, and each costly reader gets the files routed to it only
    first = cut(first)
    scanned = is_scanned(F.transform("pages", lambda p: p["text"]), least_chars)
    path = input_path(F.col("force_vision"), F.lit(readers.vision is not None), F.lit(readers.recognised is not None), F.col("pages").isNotNull(), scanned)
    routed = first.join(usable.select("doc_id", "force_vision"), "doc_id").select("doc_id", "pages", "error_code", path.alias("pipeline_used"))
    parts = [routed.where("pipeline_used = 'text'").select("doc_id", "pages", F.lit("text").alias("source"), "pipeline_used", "error_code"), refused]
    for route, reader in (("ocr", readers.recognised), ("vlm", readers.vision)):
        if reader is not None:
            again = usable.join(routed.where(F.col("pipeline_used") == route).select("doc_id"), "doc_id", "left_semi")
            parts.append(with_reader(again, reader, with_tables=True).select("doc_id", "pages", F.lit(route).alias("source"), F.lit(route).alias("pipeline_used"), "error_code"))
    for part in parts:
        told = document_columns(F.col("pages"))
        out = out.unionByName(
            part.select(
                "doc_id",
                F.when(F.col("pages").isNotNull(), told["text"]).alias("text"),
                "source",
                "pipeline_used",
                F.coalesce(F.when(F.col("pages").isNotNull(), told["n_pages"]), F.lit(0)).alias("n_pages"),
                F.when(F.col("pages").isNotNull(), told["mean_confidence"]).otherwise(0.0).alias("mean_confidence"),
                F.coalesce(F.exists("pages", lambda p: F.coalesce(p["has_tables"], F.lit(False))), F.lit(False)).alias("has_tables"),
                F.coalesce("error_code", F.when(F.col("pages").isNull() | (told["n_pages"] == 0), "empty"), check_text(told["text"], max_text_chars)).alias("error_code"),
            )
        )
    return out


def extract_tables(docs: DataFrame, ingested: DataFrame, readers: Readers = Readers(), backend: str = "auto") -> DataFrame:
    """(doc_id, page, headers, rows, confidence, backend): tables of files whose text layer has some.

    docs: doc_id, content; ingested: what ingest gives. Texts and pages read by recognition or vision never
    have tables, so only routed and flagged files reach the reader.
    """
    chosen = table_reader(readers, backend)
    wanted = docs.select("doc_id", "content").where("content is not null").join(ingested.where("has_tables and error_code is null and pipeline_used = 'text'").select("doc_id"), "doc_id", "left_semi")
    if chosen is None:
        wanted = wanted.limit(0)
    name, reader = chosen or ("none", lambda content: [])
    grids = with_grids(wanted, reader)
    found = grids.select("doc_id", F.posexplode("grids").alias("pos", "g")).select("doc_id", "pos", F.col("g.page").alias("page"), grid_to_table(F.col("g.cells")).alias("t"), F.col("g.confidence").alias("confidence"))
    return found.where("t is not null").select("doc_id", "pos", "page", "t.headers", "t.rows", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))).alias("confidence"), F.lit(name).alias("backend"))
