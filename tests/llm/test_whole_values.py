"""One answer whatever the size of the list of entries."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm.canonical import BKTree, edits, map_values
from paperloom.llm.packing import fill_containers
from paperloom.llm.quantiles import exact_quantiles


@pytest.mark.parametrize("shards", [2, 3, 7])
def test_exact_values_win_over_equal_spellings_in_other_shards(spark, shards):
    names = ["USD", "Usd", "EUR", "Eur", "GBP", "Gbp", "EUR"]
    ref = spark.createDataFrame([(i, "currency", n, None) for i, n in enumerate(names, 1)], "ref_id int, field string, canonical string, description string")
    values = spark.createDataFrame([("currency", v) for v in (*names, "usd", "gbpp", "eurx", "nothing")], "field string, value string")
    whole = sorted(map(tuple, map_values(values, ref).collect()))
    assert whole == sorted(map(tuple, map_values(values, ref, shards=shards).collect()))
    by = {v: (r, d) for _, v, r, d in whole}
    assert by["USD"] == (1, 0) and by["EUR"] == (3, 0) and by["Eur"] == (4, 0) and by["Gbp"] == (6, 0) and by["usd"][0] == 0 and by["nothing"] == (0, -1)


def test_a_long_list_goes_on_in_shards(spark):
    ref = spark.createDataFrame([(i, "f", f"entry number {i:03}", None) for i in range(300)], "ref_id int, field string, canonical string, description string")
    values = spark.createDataFrame([("f", f"Entry nubmer {i:03}") for i in range(0, 300, 7)], "field string, value string")
    found = {r.value: (r.ref_id, r.distance) for r in map_values(values, ref, max_entries=50).collect()}
    assert found == {f"Entry nubmer {i:03}": (i, 1) for i in range(0, 300, 7)}


def test_other_names_are_the_callers(spark):
    ref = spark.createDataFrame([(1, "city", "Köln", None), (2, "city", "München", None)], "ref_id int, field string, canonical string, description string")
    names = spark.createDataFrame([(1, "Cologne"), (2, "Munich"), (2, None), (9, "Nowhere")], "ref_id int, name string")
    values = spark.createDataFrame([("city", v) for v in ("Colonge", "munich", "koln", "Nowhere")], "field string, value string")
    assert {r.value: r.ref_id for r in map_values(values, ref, names).collect()} == {"Colonge": 1, "munich": 2, "koln": 1, "Nowhere": 0}


def test_a_tree_as_deep_as_its_words_can_be_sent():
    import pickle

    tree = BKTree()
    for i in range(3000):
        tree.add("a" * i, i)
    assert {w for _, w, _ in pickle.loads(pickle.dumps(tree)).within("aaaa", 1)} == {"aaa", "aaaa", "aaaaa"}


@settings(max_examples=400, deadline=None)
@given(st.text("abcé", max_size=70), st.text("abcé", max_size=12))
def test_edits_in_bits_are_the_tables(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    assert edits(a, b) == row[-1] == edits(b, a)


def test_exact_percentiles_of_a_hot_group_are_numpys(spark):
    r = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in r.normal(size=3000)] + [("small", 1.0), ("small", 3.0), (None, 5.0), ("hot", None), ("hot", float("nan"))] + [("tied", 2.0)] * 50
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"p50": 0.5, "p95": 0.95, "top": 1.0, "low": 0.0}
    got = {x.g: [x[n] for n in shares] for x in exact_quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == {"hot", "small", None, "tied"}
    for g, values in got.items():
        held = [v for k, v in rows if k == g and v is not None and v == v]
        assert values == pytest.approx(list(np.quantile(held, list(shares.values()))))
    assert exact_quantiles(df.limit(0), ["g"], "v", shares).count() == 0


def test_shards_are_bounded_by_rows_too(spark):
    sizes = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(300)], "id int, size int")
    got = fill_containers(sizes, 50, shard_rows=40).collect()
    assert len(got) == 300 and len({x.container >> 36 for x in got}) > 4
