"""Queries of the llm problems, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.canonical import map_values
from paperloom.llm.mixing import mix_sources
from paperloom.llm.names import link_names, name_pairs
from paperloom.llm.other_names import other_name_table
from paperloom.llm.packing import count_tokens, fill_containers
from paperloom.llm.personal import redact_texts
from paperloom.llm.pieces import split_documents
from paperloom.llm.quantiles import exact_quantiles, merge_sketches, read_quantiles, sketch_groups
from paperloom.session import cut, table


def _names(spark: SparkSession, d: str) -> DataFrame:
    vendor = lambda t: table(spark, d, t).select(F.lit("vendor").alias("kind"), F.col("vendor").alias("name"))
    return vendor("invoices").unionByName(vendor("receipts")).unionByName(table(spark, d, "forms").select(F.lit("submitter").alias("kind"), F.col("submitter").alias("name")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(link_names(_names(spark, d)))


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    """One row per entity and spelling."""
    return link_names(_names(spark, d))


def _latencies(spark: SparkSession, d: str) -> DataFrame:
    """The first delivery of each document, if its latency is possible."""
    rows = table(spark, d, "processed_documents").where("trace_id is not null")
    first = rows.groupBy("trace_id").agg(F.min_by(F.struct("document_type", "pipeline_used", "latency_ms", F.to_date("loaded_at").alias("day")), F.struct("loaded_at", "created_at")).alias("r"))
    return first.select("r.*").where("latency_ms between 0 and 3600000")


_GROUPS = ["document_type", "pipeline_used"]


def _daily_sketches(latencies: DataFrame) -> DataFrame:
    return sketch_groups(latencies, ["day", *_GROUPS], "latency_ms")


def p4_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles with their bounds, from the sketches of single days merged."""
    whole = merge_sketches(_daily_sketches(_latencies(spark, d)), _GROUPS)
    return read_quantiles(whole, _GROUPS, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The sketches decide every group whose bounds allow one answer only; the rest get exact percentiles."""
    latencies = cut(_latencies(spark, d))
    whole = merge_sketches(_daily_sketches(latencies), _GROUPS)
    read = cut(read_quantiles(whole, _GROUPS, {"p50": 0.5, "p95": 0.95}))
    surely = read.where("p95_low > 10 * p50_high").select(*_GROUPS)
    unsure = read.where("p95_low <= 10 * p50_high and p95_high > 10 * p50_low").select(*[F.col(c).alias(f"u_{c}") for c in _GROUPS])
    same = [F.col(c).eqNullSafe(F.col(f"u_{c}")) for c in _GROUPS]
    checked = exact_quantiles(latencies.join(unsure, same, "left_semi"), _GROUPS, "latency_ms", {"p50": 0.5, "p95": 0.95}).where("p95 > 10 * p50")
    return surely.unionByName(checked.select(*_GROUPS)).distinct()


P4_SQL = """
WITH first AS (
  SELECT document_type, pipeline_used, latency_ms,
         row_number() OVER (PARTITION BY trace_id ORDER BY loaded_at, created_at) AS rn
  FROM processed_documents WHERE trace_id IS NOT NULL)
SELECT document_type, pipeline_used FROM first
WHERE rn = 1 AND latency_ms BETWEEN 0 AND 3600000
GROUP BY document_type, pipeline_used
HAVING quantile_cont(latency_ms, 0.95) > 10 * quantile_cont(latency_ms, 0.5)
"""


def _free_values(spark: SparkSession, d: str) -> DataFrame:
    part = lambda t, c: table(spark, d, t).select("trace_id", F.lit(c).alias("field"), F.col(c).alias("value"))
    return part("receipts", "payment_method").unionByName(part("invoices", "currency")).unionByName(part("invoices", "payment_terms"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    values, reference = _free_values(spark, d), table(spark, d, "ref_values")
    typed = values.where("trace_id is not null").join(reference.select("field", F.col("canonical").alias("value")), ["field", "value"], "left_anti")
    return typed.join(map_values(typed, reference, other_name_table(reference)), ["field", "value"]).select("trace_id", "field", "ref_id").distinct()


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that mean no entry, with the number of their rows."""
    values = _free_values(spark, d)
    reference = table(spark, d, "ref_values")
    none = map_values(values, reference, other_name_table(reference)).where("ref_id = 0")
    return values.join(none, ["field", "value"]).groupBy("field", "value").agg(F.count("*").alias("n_rows"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "eval_cases").select(F.lit("eval_cases").alias("tbl"), F.col("case_id").alias("rec_id"), "text")
    fields = table(spark, d, "extracted_fields").select(F.lit("extracted_fields").alias("tbl"), F.col("field_id").cast("string").alias("rec_id"), F.col("field_value").alias("text"))
    return cases.unionByName(fields)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d).where("rec_id is not null and text is not null")
    items = redact_texts(texts, ["tbl", "rec_id"], "text").select("tbl", "rec_id", F.explode("items").alias("i"))
    return items.select("tbl", "rec_id", F.col("i.kind").alias("kind"), F.col("i.start_pos").alias("start_pos")).distinct()


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with typed placeholders and a truthful flag."""
    return redact_texts(_texts(spark, d), ["tbl", "rec_id"], "text").select("tbl", "rec_id", "redacted_text", "redacted")


def _limit(spark: SparkSession, d: str, purpose: str) -> tuple[int, int]:
    row = table(spark, d, "size_limits").where(F.col("purpose") == purpose).first()
    return row["max_tokens"], row["overlap_tokens"]


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = count_tokens(table(spark, d, "documents"), "doc_id", "text")
    return fill_containers(sizes, _limit(spark, d, "container")[0]).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used against the least number that could do."""
    capacity = _limit(spark, d, "container")[0]
    fills = p8_containers(spark, d).groupBy("container").agg(F.sum("size").alias("fill"))
    return fills.agg(
        F.count("*").alias("containers"),
        F.ceil(F.sum("fill") / capacity).alias("at_least"),
        F.max("fill").alias("fullest"),
        F.round(F.sum("fill") / (F.count("*") * capacity), 6).alias("used"),
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources the mixing left below their share and whose exact sizes say that no mixing can reach it."""
    _, report = mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return report.where("size_reached < size_asked").where("not reachable").select("source_name")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The sizes of the report, which no draw changes."""
    return p9_report(spark, d).select("source_name", "size_held", F.round("size_asked", 2).alias("size_asked"), "reachable")


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


_SQL_TOKENS = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))"

_P9_SIZES = f"""WITH s AS (SELECT source, {_SQL_TOKENS} AS n FROM documents),
held AS (SELECT source, sum(n) AS size FROM s GROUP BY source),
total AS (SELECT sum(n) AS size FROM s)"""
P9_SQL = f"""
{_P9_SIZES}
SELECT t.source_name FROM mix_targets t LEFT JOIN held h ON h.source = t.source_name CROSS JOIN total
WHERE t.max_repeats * coalesce(h.size, 0) < t.target_share * total.size
"""
P9_SIZES_SQL = f"""
{_P9_SIZES}
SELECT t.source_name, CAST(coalesce(h.size, 0) AS BIGINT) AS size_held, round(t.target_share * total.size, 2) AS size_asked,
       t.max_repeats * coalesce(h.size, 0) >= t.target_share * total.size AS reachable
FROM mix_targets t LEFT JOIN held h ON h.source = t.source_name CROSS JOIN total
"""


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap = _limit(spark, d, "piece")
    return split_documents(table(spark, d, "documents"), limit, overlap, with_text=False).where("pieces > 1 and piece = 1").select("doc_id")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap = _limit(spark, d, "piece")
    return split_documents(table(spark, d, "documents"), limit, overlap)


P10_SQL = f"SELECT doc_id FROM documents WHERE {_SQL_TOKENS} > (SELECT max_tokens FROM size_limits WHERE purpose = 'piece')"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_entities, p4_found, p4_quantiles, p6_found, p6_unmatched, p7_found, p7_redacted, p8_containers, p8_fill, p9_found, p9_report, p9_sizes, p9_selection, p10_found, p10_pieces,
    )
}

ORACLES: dict[str, str] = {"p4_found": P4_SQL, "p9_found": P9_SQL, "p9_sizes": P9_SIZES_SQL, "p10_found": P10_SQL}
