"""Evaluation: precision, recall and F1 of fields, pairs and cells, accuracies, latencies, worst cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.dims import CRITICAL
from paperloom.functions.scalars import normalize_text, values_match
from paperloom.operators.tables import cells

COUNTS = ("tp", "fp", "fn")


def precision(tp: Column, fp: Column) -> Column:
    return F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))


def recall(tp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def with_prf(counts: DataFrame, digits: int = 4) -> DataFrame:
    """counts with precision, recall and f1, 0 where nothing can be divided."""
    tp, fp, fn = (F.col(c) for c in COUNTS)
    return counts.withColumns({"precision": F.round(precision(tp, fp), digits), "recall": F.round(recall(tp, fn), digits), "f1": F.round(f1(tp, fp, fn), digits)})


def field_counts(predicted: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keys, name, tp, fp, fn): a row for each field predicted or true.

    predicted, truth: *keys, name, value. A wrong value counts as false positive and false negative.
    Empty and null values count as absent.
    """
    full = lambda df, v: df.where("value is not null and value <> ''").select(*keys, "name", F.col("value").alias(v))
    both = full(predicted, "p").join(full(truth, "t"), [*keys, "name"], "full_outer")
    hit = values_match(F.col("name"), F.col("p"), F.col("t"))
    as_int = lambda c: c.cast("int")
    return both.select(*keys, "name", as_int(hit).alias("tp"), as_int(F.col("p").isNotNull() & ~hit).alias("fp"), as_int(F.col("t").isNotNull() & ~hit).alias("fn"))


def sum_counts(counts: DataFrame, sets: list[list[str]], names: list[str]) -> DataFrame:
    """(*names, tp, fp, fn) for several groupings in one pass; a column that is not grouped is null."""
    sums = counts.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping_id().alias("grouping"))
    return sums


def macro_f1(counts: DataFrame) -> DataFrame:
    """(macro_f1): the plain mean of the f1 of all fields that occur in the truth."""
    by_name = counts.groupBy("name").agg(*[F.sum(c).alias(c) for c in COUNTS]).where("tp + fn > 0")
    return by_name.agg(F.round(F.coalesce(F.avg(f1(*[F.col(c) for c in COUNTS])), F.lit(0.0)), 4).alias("macro_f1"))


def documents_correct(counts: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, correct): whether all critical fields that the truth has agree; null without any truth.

    counts: doc_id, name, tp, fp, fn. documents: doc_id, doc_type.
    """
    critical = F.create_map(*[x for t, names in CRITICAL.items() for x in (F.lit(t), F.array(*[F.lit(n) for n in names]))])
    joined = documents.select("doc_id", "doc_type").join(counts, "doc_id", "left")
    in_truth = F.col("tp") + F.col("fn") > 0
    matters = in_truth & F.array_contains(F.try_element_at(critical, F.col("doc_type")), F.col("name"))
    by_doc = joined.groupBy("doc_id").agg(F.max(in_truth).alias("has_truth"), F.min(F.when(matters, F.col("tp") > 0)).alias("ok"))
    return by_doc.select("doc_id", F.when(F.col("has_truth"), F.coalesce("ok", F.lit(True))).alias("correct"))


def accuracy(flags: DataFrame, flag: str, name: str) -> DataFrame:
    return flags.agg(F.round(F.avg(F.col(flag).cast("double")), 4).alias(name))


def pair_counts(predicted: DataFrame, truth: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, tp, fp, fn) of the sets of normalised (question, answer) pairs; inputs: id, question, answer."""
    clean = lambda df, side: df.select(id_col, normalize_text(F.col("question")).alias("q"), normalize_text(F.col("answer")).alias("a")).distinct().withColumn(side, F.lit(1))
    both = clean(predicted, "p").join(clean(truth, "t"), [id_col, "q", "a"], "full_outer")
    return both.groupBy(id_col).agg(
        F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")
    )


def cell_counts(predicted: DataFrame, truth: DataFrame, id_cols: list[str]) -> DataFrame:
    """(*ids, tp, fp, fn) of the cells of tables aligned by position.

    Empty true cells are left out; a differing cell is missing, and false as well if something was predicted;
    predicted cells outside the true table count as false if not empty. Inputs: *ids, headers, rows.
    """
    clean = lambda df, v: cells(df, id_cols).select(*id_cols, "r", "c", normalize_text(F.coalesce("cell", F.lit(""))).alias(v))
    both = clean(predicted, "p").join(clean(truth, "t"), [*id_cols, "r", "c"], "full_outer")
    filled, said = F.coalesce(F.col("t") != "", F.lit(False)), F.coalesce(F.col("p") != "", F.lit(False))
    hit = filled & F.coalesce(F.col("p") == F.col("t"), F.lit(False))
    return both.groupBy(*id_cols).agg(F.count_if(hit).alias("tp"), F.count_if((filled & ~hit & said) | (F.col("t").isNull() & said)).alias("fp"), F.count_if(filled & ~hit).alias("fn"))


def best_tables(candidates: DataFrame, truth: DataFrame, id_col: str = "table_id") -> DataFrame:
    """(id, pos, tp, fp, fn) of the candidate table with the best f1 for each true table, the first on ties.

    candidates: id, pos, headers, rows; truth: id, headers, rows. Without candidates all is missing.
    """
    spread = truth.join(candidates.select(id_col, "pos"), id_col).select(id_col, "pos", "headers", "rows")
    scored = cell_counts(candidates, spread, [id_col, "pos"])
    best = scored.groupBy(id_col).agg(F.max_by(F.struct("pos", *COUNTS), F.struct(f1(*[F.col(c) for c in COUNTS]), -F.col("pos"))).alias("b"))
    none = cell_counts(truth.limit(0), truth, [id_col])
    return none.join(best, id_col, "left").select(id_col, F.col("b.pos").alias("pos"), *[F.coalesce(F.col(f"b.{c}"), F.col(c) if c == "fn" else F.lit(0)).alias(c) for c in COUNTS])


def latency_stats(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """(*groups, n, mean, p50, p95) by exact rank: p50 the upper median, p95 at rank round_half_even(0.95 (n - 1)).

    The values are counted first, so that what is ranked is at most one row for each different value.
    """
    groups = groups or []
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns({"__to": F.sum("__n").over(order), "__all": F.sum("__n").over(Window.partitionBy(*groups))})
    at = lambda rank: (F.col("__to") > rank) & (F.col("__to") - F.col("__n") <= rank)
    n = F.col("__all")
    p95 = F.least(n - 1, F.bround(0.95 * (n - 1), 0).cast("long"))
    exact = F.col(value).cast("decimal(20,4)") * F.col("__n")
    stats = ranked.groupBy(*groups).agg(
        F.max("__all").alias("n"),
        F.round(F.sum(exact).cast("double") / F.max("__all"), 1).alias("mean"),
        F.max(F.when(at(F.floor(n / 2)), F.col(value))).alias("p50"),
        F.max(F.when(at(p95), F.col(value))).alias("p95"),
    )
    return stats.where("n is not null")


def recent(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The last rows by time, newest first."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def clamped(limit: int, most: int = 100) -> int:
    """A limit asked for, within 1 and the most that is given out."""
    return max(1, min(limit, most))


def cost_totals(rows: DataFrame, cost: str, has_truth: str) -> DataFrame:
    """(cost_usd, cost_per_document): the sum, and its part for each document that has a truth."""
    total = F.sum(F.col(cost).cast("decimal(18,6)"))
    return rows.agg(F.round(total.cast("double"), 6).alias("cost_usd"), F.round(F.try_divide(total.cast("double"), F.count_if(F.col(has_truth))), 6).alias("cost_per_document"))


def ring_stats(df: DataFrame, order: list[str], latency: str, capacity: int = 100) -> DataFrame:
    """(n, mean, p50, p95) of the last `capacity` rows."""
    return latency_stats(recent(df, order, capacity), latency)


def worst_cases(scores: DataFrame, limit: int = 10) -> DataFrame:
    """The documents with the lowest f1, then the lowest confidence; scores: doc_id, f1, confidence."""
    return scores.orderBy("f1", "confidence", "doc_id").limit(limit)


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def missed_and_wrong(counts: DataFrame) -> DataFrame:
    """(doc_id, missed, wrong): sorted names of fields not found and found wrongly."""
    names = lambda c: F.sort_array(F.collect_set(F.when(F.col(c) > 0, F.col("name"))))
    return counts.groupBy("doc_id").agg(names("fn").alias("missed"), names("fp").alias("wrong"))
