"""Nested records, timestamps, packed values and components, against plain versions of the same."""

import datetime as dt
import itertools
import json
import random

import pytest

from paperloom.operators.components import connected_components
from paperloom.operators.nested import Plan, first_deliveries, flat_table, path_statistics, plan_tables, read_record, shred, shred_records
from paperloom.operators.packed import split_packed, split_values
from paperloom.operators.timestamps import DAY_FIRST, MONTH_FIRST, choose_readings, interpretations, normalise_timestamps, parse_values, read_value, viterbi, _costs, _step


# --- components


def test_components_against_union_find(spark):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 240)] + [(None, 3), (7, 7)]
    got = {row.node: row.label for row in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


# --- nested records

RECORDS = [
    {"id": 1, "t": "x", "items": [{"n": 1, "cells": ["a", None, "c"]}, {"n": 2, "cells": []}, {}], "meta": {"by": {"name": "A"}}},
    {"id": 2, "t": "y", "items": {"n": 3, "cells": ["z"]}, "notes": {"a": None, "b": 2}},
    {"id": 3, "t": "z", "items": None, "notes": {}},
    {"id": 4, "t": "z"},
]


def test_read_record_out_of_envelopes_and_encodings():
    record = {"id": 1, "t": "x"}
    plain = json.dumps(record)
    for text in (plain, "﻿" + plain, json.dumps(plain), json.dumps(json.dumps(plain)), json.dumps({"status": "ok", "data": {"attempt": 1, "result": record}}), json.dumps({"result": plain}), json.dumps([{"r": record}])):
        assert read_record(text, ("id", "t")) == record
    for text in (None, "", "null", "7", plain[:-1], plain + "}", '"' + plain, "not json", json.dumps({"a": 1})):
        assert read_record(text, ("id", "t")) is None


def test_shared_inlining_keeps_parents(spark):
    df = spark.createDataFrame([(r["id"], json.dumps(r), "clash") for r in RECORDS] + [(5, None, ""), (6, '{"id": 6, "t"', "")], "trace long, j string, rows string")
    plan = plan_tables(path_statistics(df, "j", ("id", "t")), maps=("$.notes",))
    assert {"$.items", "$.items[].cells"} <= plan.repeated and plan.maps == {"$.notes"}
    flat = shred_records(df, ["trace"], "j", plan, ("id", "t"))
    assert {r.trace for r in flat.where("not readable").collect()} == {5, 6}
    items = flat_table(flat, ["trace"], "$.items[]", ["n"]).orderBy("trace", "pos").collect()
    assert [(r.trace, r.pos, r.n) for r in items] == [(1, 0, "1"), (1, 1, "2"), (1, 2, None), (2, 0, "3")]
    cells = flat_table(flat, ["trace"], "$.items[].cells[]", ["value"]).orderBy("trace", "parent_pos", "pos").collect()
    assert [(r.trace, r.parent_pos, r.pos, r.value) for r in cells] == [(1, 0, 0, "a"), (1, 0, 1, None), (1, 0, 2, "c"), (2, 0, 0, "z")]
    rows = {(r.trace, r.row) for r in items}
    assert all((c.trace, c.parent_row) in rows for c in cells)
    notes = flat_table(flat, ["trace"], "$.notes.*", ["value"]).collect()
    assert sorted((r.trace, r.key, r.value) for r in notes) == [(2, "a", None), (2, "b", "2")]
    assert flat_table(flat, ["trace"], "$", ["meta.by.name"]).where("`meta.by.name` = 'A'").count() == 1
    empty = df.limit(0)
    assert shred_records(empty, ["trace"], "j", plan_tables(path_statistics(empty, "j")), ("id",)).count() == 0


def test_shared_and_recursive_elements():
    plan = Plan(repeated={"$.a", "$.b", "$.a[].a"}, same_as={"$.b": "$.a", "$.a[].a": "$.a"})
    rows = shred({"a": [{"v": 1, "a": [{"v": 2}]}], "b": [{"v": 3}]}, plan)
    assert [(t, r, p, c.get("v")) for t, r, p, _, _, _, _, c in rows] == [("$", 0, -1, None), ("$.a[]", 1, 0, "1"), ("$.a[]", 2, 1, "2"), ("$.a[]", 3, 0, "3")]


def test_first_deliveries(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), (None, 0, "x"), ("b", 5, "only"), ("b", 5, "only")], "k string, t int, v string")
    assert {(r.k, r.v) for r in first_deliveries(df, "k", ["t"], ["v"]).collect()} == {("a", "first"), ("b", "only")}


# --- timestamps

UTC = {
    "2025-09-18T09:11:48Z": "2025-09-18 09:11:48",
    "September 7, 2025 3:04 AM CEST": "2025-09-07 01:04:00",
    "06/11/2025 03:35": "2025-11-06 03:35:00",
    "09/25/2025 1:00 AM": "2025-09-25 01:00:00",
    "20250909T153111+0200": "2025-09-09 13:31:11",
    "2025-03-30 02:28 America/New_York": "2025-03-30 06:28:00",
    "2025-09-05T20:16:14[Europe/Berlin]": "2025-09-05 18:16:14",
    "24/09/2025 16:07 UTC-4": "2025-09-24 20:07:00",
    "03/01/2026 07:39 UTC-3:30": "2026-01-03 11:09:00",
    "07/09/2025 22h21": "2025-09-07 22:21:00",
    "Sun, 30 Mar 2025 02:59:35 +0100": "2025-03-30 01:59:35",
    "9 de marzo de 2025, 23:21": "2025-03-09 23:21:00",
    "1757727254": "2025-09-13 01:34:14",
    "1757486959275": "2025-09-10 06:49:19.275000",
    "12:30 AM": None,
}


def test_values_become_instants(spark):
    rows = [(i, v, None, 0) for i, v in enumerate(UTC)] + [
        (100, "2025-10-26 02:30:00", "Europe/Berlin", 0), (101, "2025-03-30 02:30:00", "Europe/Berlin", 0), (102, "2025-02-30", None, 0), (103, None, None, 0), (104, "  ", None, 0),
        (105, "2. Mai 2026", "Asia/Tokyo", 0), (106, "x" * 50000, None, 0), (107, "2025-09-18 09:11 nowhere", None, 0), (108, "30-MAR-25", None, 0), (109, "2025-01-01 25:00", None, 0), (110, "2025-09-18 09:00", "Not/AZone", 0),
    ]
    df = spark.createDataFrame(rows, "id int, v string, office string, reading_ int")
    got = {r.id: r for r in normalise_timestamps(df, "v", "office", ["id"], "office").collect()}
    assert len(got) == len(rows)
    for i, (v, want) in enumerate(UTC.items()):
        assert (str(got[i].utc_instant) if got[i].utc_instant else None) == want, v
    assert str(got[100].utc_instant) == "2025-10-26 00:30:00" and str(got[101].utc_instant) == "2025-03-30 01:30:00"
    assert [got[i].kind for i in (102, 103, 104, 106, 107, 109)] == ["unreadable"] * 6
    assert got[105].kind == "date" and got[105].written_date == dt.date(2026, 5, 2) and got[108].written_date == dt.date(2025, 3, 30)
    assert str(got[110].utc_instant) == "2025-09-18 09:00:00"
    assert normalise_timestamps(df.limit(0), "v", "office", ["id"], "office").count() == 0


def test_interpretations():
    assert [f for f, _ in interpretations("03/04/2025")] == [DAY_FIRST, MONTH_FIRST] and len(interpretations("25/04/2025")) == len(interpretations("04/25/2025")) == len(interpretations("04/04/2025")) == 1
    assert read_value("03/04/2025 10:00 PM PST")[1:3] == ("22:00:00.000000", "-08:00")


def brute(chain, policy):
    best = min(itertools.product(*[range(len(c)) for c in chain]), key=lambda p: (round(sum(_costs(c, policy)[i] for c, i in zip(chain, p)) + sum(_step(a[i], b[j]) for a, b, i, j in zip(chain, chain[1:], p, p[1:])), 6), p))
    return list(best)


def cost(chain, path, policy):
    return sum(_costs(c, policy)[i] for c, i in zip(chain, path)) + sum(_step(a[i], b[j]) for a, b, i, j in zip(chain, chain[1:], path, path[1:]))


@pytest.mark.parametrize("policy", ["learn", "day_first"])
def test_viterbi_is_optimal(policy):
    r = random.Random(1)
    for _ in range(60):
        chain = [[(f, r.randrange(20000, 20200)) for f in ([DAY_FIRST, MONTH_FIRST] if r.random() < 0.6 else [r.choice((1, DAY_FIRST, MONTH_FIRST))])] for _ in range(r.randrange(1, 9))]
        assert cost(chain, viterbi(chain, policy), policy) == pytest.approx(cost(chain, brute(chain, policy), policy))


def test_chains_cut_into_ranges_choose_like_whole_ones(spark):
    """One source holds most rows, so its chain crosses the ranges; neighbours decide under the policy 'learn'."""
    r = random.Random(2)
    rows = []
    for i in range(400):
        day = dt.date(2025, 1, 1) + dt.timedelta(days=i // 2)
        us = i % 200 < 100
        rows.append((i, "hot" if i % 5 else f"s{i % 3}", day.strftime("%m/%d/%Y" if us else "%d/%m/%Y")))
    df = spark.createDataFrame(rows, "id int, src string, v string").repartition(7)
    parsed = parse_values(df, "v")
    got = {x.id: x.reading for x in choose_readings(parsed, "src", ["id"], "learn").collect()}
    for source in {x[1] for x in rows}:
        own = [x for x in rows if x[1] == source]
        chain = [interpretations(x[2]) for x in own]
        assert cost(chain, [got[x[0]] for x in own], "learn") == pytest.approx(cost(chain, viterbi(chain, "learn"), "learn"))


# --- packed values


@pytest.mark.parametrize(
    "text,items",
    [
        ("A B LLC;;C D Co;", ["A B LLC", "C D Co"]),
        ("«A B S.A.», «C D»", ["A B S.A.", "C D"]),
        ('["A, Inc.", "B \\"Bee\\" C"]', ["A, Inc.", 'B "Bee" C']),
        ("(1) A B S.L. (2) C D GmbH (3) E F", ["A B S.L.", "C D GmbH", "E F"]),
        ("1. A B Inc. 2. C D Ltd", ["A B Inc.", "C D Ltd"]),
        ("between A B Inc. and C D S.A.S.", ["A B Inc.", "C D S.A.S."]),
        ("A B, LLC, C D, S.A. de C.V., E F Ltd., and G H", ["A B, LLC", "C D, S.A. de C.V.", "E F Ltd.", "G H"]),
        ("Sand / Stone A B AG, C D GmbH", ["Sand / Stone A B AG", "C D GmbH"]),
        ("A B & Sons\tC D LLC", ["A B & Sons", "C D LLC"]),
        ("Salud y Vida A B S.L.; C D Co", ["Salud y Vida A B S.L.", "C D Co"]),
        ('A "Al" B; "C ""See"" D"', ['A "Al" B', 'C "See" D']),
        ('"A B" "C D, Ltd."', ["A B", "C D, Ltd."]),
        ('"A B; C D', ['"A B', "C D"]),
        ("A  B GmbH // C D", ["A  B GmbH", "C D"]),
        ("A B Co & C D Ltd. y E F", ["A B Co", "C D Ltd.", "E F"]),
        ("A B", ["A B"]), (None, []), ("", []), (" ;; ", []), ("A B\n\nC D", ["A B", "C D"]), ("'A O'Neil Ltd', 'C D'", ["A O'Neil Ltd", "C D"]),
    ],
)
def test_split_packed(text, items):
    assert split_packed(text)[0] == items


def test_split_values_frame(spark):
    rows = [(1, "A B; C D", "x"), (2, None, "x"), (3, "", "x"), (4, '"A B; C D', "x"), (5, "; ".join(f"N{i} LLC" for i in range(3000)), "x"), (1, "A B; C D", "x")]
    got = split_values(spark.createDataFrame(rows, "id int, p string, item string"), ["id"], "p")
    assert got.where("id = 1").count() == 4 and got.where("id = 5").count() == 3000 and got.where("id in (2, 3)").count() == 0
    assert got.where("id = 4 and array_contains(flags, 'unclosed quote')").count() == 2
    assert split_values(spark.createDataFrame([], "id int, p string"), ["id"], "p").count() == 0
