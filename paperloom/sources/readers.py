"""Sources. Rows that can't be read keep an error_code instead of stopping the job."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TEXT_CHARS, MAX_PDF_BYTES = 200_000, 10 * 1024 * 1024

CASE_SCHEMA = (
    "id string, source string, doc_type string, template string, text string, ground_truth map<string,string>, "
    "`table` struct<headers:array<string>,rows:array<array<string>>,ruled:boolean>, notes array<string>"
)
TABLE_SCHEMA = "id string, kind string, headers array<string>, rows array<array<string>>, ruled boolean"
FORM_SCHEMA = "form array<struct<id:int,text:string,box:array<int>,label:string,linking:array<array<int>>,words:array<struct<text:string,box:array<int>>>>>"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines with a stated schema, so that nothing is read to guess it; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, CASE_SCHEMA)


def read_table_cases(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, TABLE_SCHEMA)


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, form) from a folder of annotation files, one object a file, in no order; doc_id is the file's name."""
    forms = spark.read.schema(FORM_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return forms.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("doc_id"), "form")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))


def check_text(text: Column, max_chars: int = MAX_TEXT_CHARS) -> Column:
    """Null for a usable text, else 'empty' or 'oversized'."""
    return F.when(~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False)), "empty").when(F.length(text) > max_chars, "oversized")


def check_pdf(content: Column, max_bytes: int = MAX_PDF_BYTES) -> Column:
    """Null for bytes that may be a PDF, else 'empty', 'oversized' or 'invalid_pdf'."""
    head = F.hex(F.substring(content, 1, 1024))
    return (
        F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "empty").when(F.octet_length(content) > max_bytes, "oversized").when(~head.rlike("^(?:(?:20|09|0A|0B|0C|0D))*25504446"), "invalid_pdf")
    )


def decode_pdf(encoded: Column, max_bytes: int = MAX_PDF_BYTES) -> Column:
    """struct<content, error_code> of a base64 text, with or without a data: prefix; too long is found before decoding."""
    bare = F.btrim(encoded)
    bare = F.when(bare.startswith("data:") & bare.contains(","), F.substring_index(bare, ",", -1)).otherwise(bare)
    content = F.try_to_binary(bare, F.lit("base64"))
    early = F.when(F.coalesce(bare, F.lit("")) == "", "empty").when(F.length(bare) > max_bytes * 4 / 3 + 4, "oversized").when(content.isNull(), "invalid_pdf")
    code = F.coalesce(early, F.when(early.isNull(), check_pdf(content, max_bytes)))
    return F.struct(F.when(code.isNull(), content).alias("content"), code.alias("error_code"))


def exactly_one(text: Column, pdf: Column) -> Column:
    """Whether one, and only one, of text and PDF is given."""
    given = lambda c: F.coalesce(F.btrim(c) != "", F.lit(False))
    return given(text) != given(pdf)


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, dead letters) by error_code."""
    return df.where("error_code is null").drop("error_code"), df.where("error_code is not null")


def vision_pages(answer: Column) -> Column:
    """array<struct<number, text, confidence>> from a transcription {"pages": [...]}; null without pages."""
    pages = F.from_json(answer, "struct<pages:array<struct<text:string,confidence:double>>>")["pages"]
    return F.when(
        F.size(pages) > 0,
        F.transform(pages, lambda p, i: F.struct((i + 1).alias("number"), F.coalesce(p["text"], F.lit("")).alias("text"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(p["confidence"], F.lit(0.8)))).alias("confidence"))),
    )


def document_columns(pages: Column) -> dict[str, Column]:
    """What follows from a document's pages: text, n_pages, chars_per_page, mean_confidence."""
    texts = F.transform(pages, lambda p: p["text"])
    n = F.size(pages)
    total = F.aggregate(texts, F.lit(0), lambda a, t: a + F.length(F.btrim(t)))
    confidence = F.aggregate(pages, F.lit(0.0), lambda a, p: a + p["confidence"])
    return {
        "text": F.array_join(texts, "\n\n"),
        "n_pages": n,
        "chars_per_page": F.when(n > 0, total / n).otherwise(0.0),
        "mean_confidence": F.when(n > 0, confidence / n).otherwise(1.0),
    }


def with_reader(df: DataFrame, reader: Callable[[bytes], list[dict]], content_col: str = "content", id_col: str = "doc_id", with_tables: bool = False) -> DataFrame:
    """(id, pages, error_code): PDF or image bytes through a reader that gives [{text, confidence}] a page.

    With with_tables the pages also tell whether the reader saw a table on them (has_tables).

    The reader is a plug-in (a PDF or OCR library is none of this package's needs); what it raises becomes
    the row's error_code. Files go through Arrow a few at a time.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages, codes = [], []
            for content in batch[content_col]:
                try:
                    read = reader(bytes(content))
                    pages.append([{"number": i + 1, "text": p.get("text", ""), "confidence": float(p.get("confidence", 1.0)), **({"has_tables": bool(p.get("has_tables", False))} if with_tables else {})} for i, p in enumerate(read)])
                    codes.append(None)
                except Exception as error:  # noqa: BLE001 - any failure is the row's own
                    pages.append(None)
                    codes.append(type(error).__name__)
            yield pd.DataFrame({id_col: batch[id_col], "pages": pages, "error_code": codes})

    return df.select(id_col, content_col).mapInPandas(work, f"{id_col} {id_type}, pages array<struct<number:int,text:string,confidence:double{',has_tables:boolean' if with_tables else ''}>>, error_code string")


def with_grids(df: DataFrame, reader: Callable[[bytes], list[dict]], content_col: str = "content", id_col: str = "doc_id") -> DataFrame:
    """(id, grids, error_code): files through a table reader that gives [{page, cells, confidence}], cells being rows of texts."""
    id_type = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grids, codes = [], []
            for content in batch[content_col]:
                try:
                    grids.append([{"page": int(g.get("page", 1)), "cells": [list(row) for row in g["cells"]], "confidence": float(g.get("confidence", 0.7))} for g in reader(bytes(content))])
                    codes.append(None)
                except Exception as error:  # noqa: BLE001 - any failure is the row's own
                    grids.append([])
                    codes.append(type(error).__name__)
            yield pd.DataFrame({id_col: batch[id_col], "grids": grids, "error_code": codes})

    return df.select(id_col, content_col).mapInPandas(work, f"{id_col} {id_type}, grids array<struct<page:int,cells:array<array<string>>,confidence:double>>, error_code string")


def retrying(model: Callable[[pd.Series], pd.Series], may_retry: Callable[[Exception], bool], attempts: int = 3, first_wait: float = 1.0, longest_wait: float = 10.0) -> Callable[[pd.Series], pd.Series]:
    """A model that is asked again after failures that may pass, with waits that double up to a bound; then the failure is raised."""

    def ask(prompts: pd.Series) -> pd.Series:
        wait = first_wait
        for attempt in range(attempts):
            try:
                return model(prompts)
            except Exception as error:  # noqa: BLE001 - the caller says which failures may pass
                if attempt + 1 == attempts or not may_retry(error):
                    raise
                time.sleep(min(wait, longest_wait))
                wait *= 2
        raise AssertionError("not reached")

    return ask


def with_model(df: DataFrame, model: Callable[[pd.Series], pd.Series], prompt_col: str, out_col: str = "answer") -> DataFrame:
    """df with a model's answers: an iterator pandas UDF, so that a client made once serves a whole task."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield model(prompts)

    return df.withColumn(out_col, ask(F.col(prompt_col)))
