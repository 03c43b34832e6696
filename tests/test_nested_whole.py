"""Nested records without caps: depth, free keys, shared lists, redeliveries."""

import json

from paperloom.operators import nested
from paperloom.operators.nested import first_rows, flat_table, fold_free_keys, path_statistics, plan_tables, read_record, shred, shred_rows


def test_any_number_of_envelopes():
    record = {"id": 1, "t": "x"}
    value, text = record, json.dumps(record)
    for _ in range(60):
        value = {"inner": value}
    for _ in range(6):
        text = json.dumps({"payload": text})
    assert read_record(json.dumps(value), ("id", "t")) == record
    assert read_record(text, ("id", "t")) == record


def test_deep_records_are_shredded_to_the_end(spark):
    deep = {"v": "bottom"}
    for _ in range(200):
        deep = {"kids": [deep]}
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, "["), (3, None), (4, "[" * 200_000), (5, "7")], "trace long, j string")
    plan = plan_tables(path_statistics(df, "j"))
    rows = shred_rows(df, ["trace"], "j", plan).collect()
    assert [r.columns["v"] for r in rows if r.columns.get("v")] == ["bottom"]
    assert sum(r.tbl != "unreadable" and r.trace == 1 for r in rows) == 201
    assert {(r.trace, r.key) for r in rows if r.tbl == "unreadable"} == {(2, "cut off"), (3, "empty"), (4, "too deep"), (5, "no record")}
    assert all(r.parent_row in {q.row for q in rows if q.trace == 1} for r in rows if r.trace == 1 and r.row)


def test_free_keys_are_folded_before_they_come_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(nested, "MAX_KEYS", 4)
    rows = [(json.dumps({"id": i, "m": {f"k{i}": {"a": 1, f"x{i}": {"deep": [i]}}}}),) for i in range(30)]
    df = spark.createDataFrame(rows, "j string").repartition(7)
    stats = path_statistics(df, "j")
    folded = {r.path: (r.objects, r.scalars) for r in fold_free_keys(stats).collect()}
    assert folded["$.m.*"] == (30, 0) and folded["$.m.*.*.deep[]"] == (0, 30) and len(folded) < 12
    assert plan_tables(stats, max_paths=10).maps == {"$.m", "$.m.*"}


def test_a_list_under_two_names_is_one_table(spark):
    item = {"code": "c", "level": "l", "text": "t"}
    rows = [(1, json.dumps({"id": 1, "found": [item]})), (2, json.dumps({"id": 2, "also_found": [item, item]})), (3, json.dumps({"id": 3, "other": [{"a": 1, "b": 2, "c": 3}]}))]
    df = spark.createDataFrame(rows, "trace long, j string")
    plan = plan_tables(path_statistics(df, "j"))
    assert plan.table_of("$.found") == plan.table_of("$.also_found") != plan.table_of("$.other")
    flat = flat_table(shred_rows(df, ["trace"], "j", plan), ["trace"], plan.table_of("$.found") + "[]", {"code": "string", "level": "int"})
    assert sorted((r.trace, r.pos, r.code, r.level) for r in flat.collect()) == [(1, 0, "c", None), (2, 0, "c", None), (2, 1, "c", None)]


def test_unwanted_parts_are_not_walked():
    record = {"a": [{"b": [1, 2]}, {"b": []}], "c": [{"d": 1}]}
    plan = nested.Plan(repeated={"$.a", "$.a[].b", "$.c"})
    every = [r for r in shred(record, plan) if r[0] == "$.a[].b[]"]
    some = shred(record, plan, {"$.a[].b[]"})
    assert [(r[0], r[4], r[5]) for r in some] == [(r[0], r[4], r[5]) for r in every] == [("$.a[].b[]", 0, 0), ("$.a[].b[]", 0, 1)]


def test_first_rows_of_repeated_keys(spark):
    rows = [("a", 2, "late"), ("a", 1, "first"), ("b", 1, "only"), (None, 1, "nobody"), ("c", 5, "x"), ("c", 5, "y"), ("c", 5, "x"), ("d", None, "no time"), ("d", 3, "timed")]
    df = spark.createDataFrame(rows, "k string, at int, v string")
    for bound in (200_000, 0):
        got = sorted((r.k, r.v) for r in first_rows(df, "k", ["at"], bound).collect())
        assert len(got) == 4 and got[:2] == [("a", "first"), ("b", "only")] and got[2][0] == "c" and got[2][1] in ("x", "y")
        assert got[3] == ("d", "no time")
    assert first_rows(df.where("k = 'b'"), "k", ["at"]).count() == 1 and first_rows(df.limit(0), "k", ["at"]).count() == 0
