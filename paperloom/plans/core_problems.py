"""Queries of the general problems 2, 3 and 5."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.nested import Plan, first_rows, flat_table, path_statistics, plan_tables, shred_rows
from paperloom.operators.packed import split_values
from paperloom.operators.timestamps import normalise_by_rule
from paperloom.session import table

RECORD_KEYS = ("trace_id", "document_type")
TABLE_ROWS = "$.tables[].rows[]"


def _records(spark: SparkSession, d: str) -> DataFrame:
    """The first delivery of each document."""
    return first_rows(table(spark, d, "processed_documents").select("trace_id", "loaded_at", "created_at", "result_json"), "trace_id", ["loaded_at", "created_at"])


def _plan(spark: SparkSession, d: str) -> Plan:
    return plan_tables(path_statistics(table(spark, d, "processed_documents"), "result_json", RECORD_KEYS))


def _finding_tables(plan: Plan) -> tuple[set[str], set[str]]:
    """(tables of findings, tables of their details): one each where the schema shows both names to be one element."""
    names = ("$.findings", "$.validation_findings")
    return {plan.table_of(n) + "[]" for n in names}, {plan.table_of(f"{n}[].details") + ".*" for n in names}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    plan = _plan(spark, d)
    _, details = _finding_tables(plan)
    rows = shred_rows(_records(spark, d), ["trace_id"], "result_json", plan, RECORD_KEYS, {TABLE_ROWS, *details}, with_columns=False)
    kind = F.when(F.col("tbl") == TABLE_ROWS, "table_row").otherwise("detail")
    return rows.select("trace_id", kind.alias("kind"), "parent_pos", F.col("key").alias("child_key")).distinct()


def p2_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every flat table, and the documents they come from; unreadable records are a table of their own."""
    rows = shred_rows(_records(spark, d), ["trace_id"], "result_json", _plan(spark, d), RECORD_KEYS, with_columns=False)
    by_document = rows.groupBy("tbl", "trace_id").agg(F.count("*").alias("n"))
    return by_document.groupBy("tbl").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_documents"))


def p2_findings(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of findings, whichever of its two names a record uses."""
    plan = _plan(spark, d)
    findings, _ = _finding_tables(plan)
    rows = shred_rows(_records(spark, d), ["trace_id"], "result_json", plan, RECORD_KEYS, findings)
    columns = ("severity", "code", "field", "message")
    parts = [flat_table(rows, ["trace_id"], t, list(columns)).select("trace_id", "pos", *columns) for t in sorted(findings)]
    return reduce(DataFrame.unionByName, parts)


def p2_fields(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of fields: items of a list, or entries of an object that names them."""
    rows = shred_rows(_records(spark, d), ["trace_id"], "result_json", _plan(spark, d), RECORD_KEYS, {"$.fields[]", "$.fields.*"})
    types = {"name": "string", "confidence": "double", "source": "string", "page": "int", "redacted": "boolean"}
    part = lambda t, name: flat_table(rows, ["trace_id"], t, types).select("trace_id", "pos", name.alias("name"), *[c for c in types if c != "name"])
    return part("$.fields[]", F.col("name")).unionByName(part("$.fields.*", F.col("key")))


# the record of each first delivery, out of its encodings and envelopes
_RECORDS_SQL = """
WITH f AS (SELECT trace_id, ltrim(result_json, chr(65279)) AS j,
             row_number() OVER (PARTITION BY trace_id ORDER BY loaded_at, created_at) AS rn
           FROM processed_documents WHERE trace_id IS NOT NULL),
a AS (SELECT trace_id, CASE WHEN json_valid(j) THEN CASE WHEN json_type(j) = 'VARCHAR' THEN j ->> '$' ELSE j END END AS j FROM f WHERE rn = 1),
b AS (SELECT trace_id, CASE WHEN json_valid(j) THEN j::JSON END AS j FROM a),
c AS (SELECT trace_id, CASE WHEN json_exists(j, '$.trace_id') THEN j WHEN json_exists(j, '$.result') THEN j -> '$.result' ELSE j -> '$.data.result' END AS j FROM b),
e AS (SELECT trace_id, CASE WHEN json_type(j) = 'VARCHAR' THEN (CASE WHEN json_valid(j ->> '$') THEN (j ->> '$')::JSON END) ELSE j END AS j FROM c),
rec AS (SELECT trace_id, j FROM e WHERE json_type(j) = 'OBJECT')
"""


def _list_sql(path: str) -> str:
    """The items of a list, or what stands in its place, as a list."""
    return f"CASE json_type(j, '{path}') WHEN 'ARRAY' THEN json_extract(j, '{path}[*]') WHEN 'NULL' THEN [] ELSE CASE WHEN json_exists(j, '{path}') THEN [json_extract(j, '{path}')] ELSE [] END END"


def _unnest_sql(relation: str, path: str) -> str:
    return f"SELECT trace_id, unnest(range(len(l))) AS pos, unnest(l) AS j FROM (SELECT trace_id, {_list_sql(path)} AS l FROM {relation})"


_FINDINGS_SQL = f"{_unnest_sql('rec', '$.findings')} UNION ALL {_unnest_sql('rec', '$.validation_findings')}"
P2_FOUND_SQL = (
    _RECORDS_SQL
    + f", t AS ({_unnest_sql('rec', '$.tables')}), r AS (SELECT trace_id, pos, unnest(range(len(l))) AS k FROM (SELECT trace_id, pos, {_list_sql('$.rows')} AS l FROM t)),"
    + f" g AS ({_FINDINGS_SQL}), h AS (SELECT trace_id, pos, unnest(json_keys(j, '$.details')) AS k FROM g WHERE json_type(j, '$.details') = 'OBJECT')"
    + " SELECT DISTINCT trace_id, 'table_row' AS kind, CAST(pos AS INTEGER) AS parent_pos, CAST(k AS VARCHAR) AS child_key FROM r"
    + " UNION SELECT DISTINCT trace_id, 'detail', CAST(pos AS INTEGER), k FROM h"
)
P2_FINDINGS_SQL = _RECORDS_SQL + f", g AS ({_FINDINGS_SQL}) SELECT trace_id, CAST(pos AS INTEGER) AS pos, " + ", ".join(f"j ->> '$.{c}' AS {c}" for c in ("severity", "code", "field", "message")) + " FROM g"
P2_FIELDS_SQL = (
    _RECORDS_SQL
    + f", l AS ({_unnest_sql("(SELECT * FROM rec WHERE json_type(j, '$.fields') = 'ARRAY')", '$.fields')}),"
    + " m AS (SELECT trace_id, j, json_keys(j, '$.fields') AS ks FROM rec WHERE json_type(j, '$.fields') = 'OBJECT'),"
    + " n AS (SELECT trace_id, unnest(range(len(ks))) AS pos, unnest(ks) AS k, j FROM m),"
    + " every AS (SELECT trace_id, pos, j ->> '$.name' AS name, j FROM l UNION ALL SELECT trace_id, pos, k, json_extract(j, '$.fields.\"' || k || '\"') FROM n)"
    + " SELECT trace_id, CAST(pos AS INTEGER) AS pos, name, TRY_CAST(j ->> '$.confidence' AS DOUBLE) AS confidence, j ->> '$.source' AS source, TRY_CAST(j ->> '$.page' AS INTEGER) AS page, TRY_CAST(j ->> '$.redacted' AS BOOLEAN) AS redacted FROM every"
)


_DATES = (("invoices", "issue_date"), ("invoices", "due_date"), ("contracts", "effective_date"), ("forms", "form_date"))


def _date_values(spark: SparkSession, d: str) -> DataFrame:
    values = None
    for tbl, field in _DATES:
        part = table(spark, d, tbl).select(F.lit(tbl).alias("tbl"), "trace_id", F.lit(field).alias("field"), F.col(field).alias("value"), "office_tz")
        values = part if values is None else values.unionByName(part)
    return values


def p3_normalised(spark: SparkSession, d: str) -> DataFrame:
    done = normalise_by_rule(_date_values(spark, d), "value", "office_tz")
    return done.select("tbl", "trace_id", "field", "value", "written_date", F.col("utc_instant").cast("string").alias("utc_instant"), "kind")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    done = normalise_by_rule(_date_values(spark, d), "value", "office_tz")
    other_day = F.col("time_of_day").isNotNull() & (F.to_date("utc_instant") != F.col("written_date"))
    return done.where(other_day & F.col("trace_id").isNotNull()).select("tbl", "trace_id", "field").distinct()


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    return split_values(table(spark, d, "contracts").select("trace_id", "parties").distinct(), ["trace_id"], "parties").select("trace_id", "pos", F.col("item").alias("party"), "n_items")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_values(spark, d).where("n_items >= 2 and trace_id is not null").select("trace_id", "pos", "party").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_tables, p2_findings, p2_fields, p3_found, p3_normalised, p5_found, p5_values)}

ORACLES: dict[str, str] = {"p2_found": P2_FOUND_SQL, "p2_findings": P2_FINDINGS_SQL, "p2_fields": P2_FIELDS_SQL}
