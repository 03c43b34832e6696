"""Sinks."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_COLUMNS = (
    "trace_id string, created_at timestamp, document_type string, routing string, pipeline_used string, overall_confidence double, "
    "latency_ms int, input_tokens int, output_tokens int, result string, created_date date"
)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with the keys in alphabetical order."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode(mode).text(path)


def create_results(spark: SparkSession, name: str) -> None:
    """The table of results, parquet by day, so that a recent period reads only its days."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({RESULT_COLUMNS}) USING parquet PARTITIONED BY (created_date)")


def first_writers(existing: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of batch to insert: the first of each key, where no row of that key exists yet."""
    columns = batch.columns
    first = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r")).select("r.*")
    return first.join(existing.select(key).distinct(), key, "left_anti").select(columns)


def upsert_results(spark: SparkSession, name: str, batch: DataFrame, order: list[str] | None = None) -> int:
    """Insert what is new and leave the rest; giving the same batch twice changes nothing. The number inserted."""
    create_results(spark, name)
    new = first_writers(spark.table(name), batch, "trace_id", order or ["created_at"]).withColumn("created_date", F.to_date("created_at"))
    new = new.select(spark.table(name).columns).persist()
    try:
        count = new.count()
        if count:
            new.write.mode("append").insertInto(name)
        return count
    finally:
        new.unpersist()


def repository(spark: SparkSession, name: str | None) -> Callable[[DataFrame], int]:
    """Where results go: a table if one is named, else nowhere (0 rows stored)."""
    if name:
        return lambda batch: upsert_results(spark, name, batch)
    return lambda batch: 0


def write_nowhere(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def results_as_response(results: DataFrame) -> DataFrame:
    """The public shape of a result: findings are called validation_findings."""
    return results.withColumnRenamed("findings", "validation_findings")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a file exists in the file system its path names, local or not."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256) of the files that exist, in the order given."""
    wanted = [p for p in paths if _exists(spark, p)]
    if not wanted:
        return spark.createDataFrame([], "path string, sha256 string")
    order = spark.createDataFrame([(i, p, re.sub("^file:/*", "/", p)) for i, p in enumerate(wanted)], "ord int, path string, name string")
    files = spark.read.format("binaryFile").load(list({re.sub("^file:/*", "/", p): p for p in wanted}.values())).select(F.regexp_replace("path", "^file:/*", "/").alias("name"), F.sha2("content", 256).alias("sha256"))
    return files.join(F.broadcast(order), "name").orderBy("ord").select("path", "sha256")


def percent(value: float | None) -> str:
    return "-" if value is None else f"{value * 100:.1f} %"


def markdown_table(df: DataFrame, percents: tuple[str, ...] = (), limit: int = 200) -> str:
    """A small summary as a Markdown table; at most `limit` rows are taken to the driver."""
    rows = df.limit(limit).collect()
    cell = lambda r, c: percent(r[c]) if c in percents else "-" if r[c] is None else str(r[c])
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(cell(r, c) for c in df.columns) + " |" for r in rows])


def replace_block(path: str, begin: str, end: str, body: str) -> bool:
    """Put body between two marks in a file; False if the file or a mark is missing."""
    file = Path(path)
    if not file.exists():
        return False
    text = file.read_text(encoding="utf-8")
    start = text.find(begin)
    stop = text.find(end, start + len(begin))
    if start < 0 or stop < 0:
        return False
    file.write_text(text[: start + len(begin)] + "\n" + body + "\n" + text[stop:], encoding="utf-8")
    return True


def gallery(cases: DataFrame, ids: list[str], id_col: str = "case_id", preview: int = 1800) -> DataFrame:
    """The cases of a short list, in its order, with the beginning of their text as a preview."""
    order = cases.sparkSession.createDataFrame(list(enumerate(ids)), f"ord int, {id_col} string")
    return cases.join(F.broadcast(order), id_col).withColumn("preview", F.substring("text", 1, preview)).orderBy("ord").drop("ord")
