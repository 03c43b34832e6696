import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm.canonical import BKTree, edits, find, grow, map_values
from paperloom.llm.other_names import other_name_table, other_names
from paperloom.llm.mixing import mix_sources, permute
from paperloom.llm.packing import fill_containers, pack
from paperloom.llm.pieces import TOKEN, split_documents, split_text, token_count
from paperloom.llm.quantiles import Sketch, error_bound, exact_quantiles, merge_sketches, read_quantiles, sketch_groups

REFERENCE = [(1, "payment_method", "cash", "Cash"), (2, "payment_method", "card", "Credit or debit card"), (9, "currency", "USD", "US dollar"), (29, "payment_terms", "Net 30", None), (30, "payment_terms", "Net 45", "")]


def spelled(reference):
    """The rows of a list with all the spellings of its entries, as grow wants them."""
    return [(i, f, c, True) for i, f, c, _ in reference] + [(i, f, n, False) for i, f, c, d in reference for n in ([d] if d else []) + other_names(f, c)]


def test_bk_tree_returns_everything_within_the_threshold():
    r = random.Random(1)
    words = {"".join(r.choice("abc") for _ in range(r.randrange(1, 7))) for _ in range(200)}
    tree = BKTree()
    for i, w in enumerate(sorted(words)):
        tree.add(w, i)
    for query in ("abc", "", "aaaaaa", "cab"):
        assert {w for _, w, _ in tree.within(query, 2)} == {w for w in words if edits(query, w) <= 2}


@pytest.mark.parametrize("field,value,ref", [("payment_method", "CAHS.", 1), ("payment_method", "(efectivo)", 1), ("payment_method", "barter", 0), ("currency", "u.s.d.", 9), ("currency", "INR", 0), ("payment_terms", "NET 45 D.", 30), ("payment_terms", "Net 37", 0), ("payment_terms", "thrity days", 29)])
def test_values_map_to_what_they_mean(field, value, ref):
    assert find(*grow(spelled(REFERENCE)), field, value)[0] == ref


def test_map_values_broadcast_and_sharded_agree(spark):
    ref = spark.createDataFrame([(*r, "x") for r in REFERENCE], "ref_id int, field string, canonical string, description string, value string")
    values = [("payment_method", v) for v in ("cash", "csh", "", None, "  ", "Karte", "barter", "z" * 5000)] + [("currency", "US$"), (None, "a"), ("unknown", "a")]
    frame = spark.createDataFrame(values, "field string, value string")
    a = sorted(map(tuple, map_values(frame, ref, other_name_table(ref)).collect()))
    b = sorted(map(tuple, map_values(frame, ref, other_name_table(ref), shards=3).collect()))
    assert a == b and ("payment_method", "Karte", 2, 0) in a and ("unknown", "a", 0, -1) in a
    assert map_values(frame.limit(0), ref).count() == 0 and {r.ref_id for r in map_values(frame, ref.limit(0)).collect()} == {0}


@pytest.mark.parametrize("shape", ["lognormal", "sorted", "ties", "reversed"])
def test_sketch_keeps_its_bound_after_merging(shape):
    rng = np.random.default_rng(4)
    values = np.floor(rng.lognormal(5, 1.5, 400_000))
    values = {"lognormal": values, "sorted": np.sort(values), "ties": values % 7, "reversed": -np.sort(-values)}[shape]
    whole = Sketch()
    for part in np.array_split(values, 37):
        other = Sketch()
        other.add(part)
        whole.merge(Sketch.from_bytes(other.to_bytes()))
    ordered = np.sort(values)
    assert whole.n == len(values) and len(np.concatenate(whole.levels)) < 20_000
    for share in (0.01, 0.5, 0.9, 0.99, 0.999, 0.9999):
        got = whole.quantiles([share])[0]
        low, high = np.searchsorted(ordered, got, "left"), np.searchsorted(ordered, got, "right")
        rank = min(max(share * len(values), low), high)
        assert abs(rank - share * len(values)) <= error_bound() * (1 - share) * len(values) + 1, share


def test_quantiles_of_groups_days_and_nothing(spark):
    rows = [("a", None, d, float(v)) for d in range(3) for v in range(1000)] + [("b", "t", 1, 5.0)] * 3 + [("c", "t", 1, None)]
    df = spark.createDataFrame(rows, "g string, h string, day int, v double")
    shares = {"p50": 0.5, "p95": 0.95}
    merged = merge_sketches(sketch_groups(df, ["day", "g", "h"], "v"), ["g", "h"])
    got = {r.g: r for r in read_quantiles(merged, ["g", "h"], shares).collect()}
    exact = {r.g: r for r in exact_quantiles(df, ["g", "h"], "v", shares).collect()}
    assert set(got) == {"a", "b"} and got["a"].n == 3000 and got["b"].p95 == 5
    assert got["a"].p50_low <= exact["a"].p50 <= got["a"].p50_high and abs(got["a"].p95 - exact["a"].p95) <= 5
    assert sketch_groups(df.limit(0), ["g"], "v").count() == 0


def test_pack_never_overfills_and_leaves_little_room():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 61, 5000)
    where, fills = pack(sizes, 100)
    assert (np.bincount(where, sizes) == fills).all() and fills.max() <= 100
    assert len(fills) <= 1.02 * -(-sizes.sum() // 100)


def test_fill_containers_divides_only_what_is_too_large(spark):
    sizes = [(i, s) for i, s in enumerate([0, None, 10, 100, 101, 350, 99, 1, 1] + [30] * 50)]
    rows = fill_containers(spark.createDataFrame(sizes, "id int, size int"), 100).toPandas()
    assert rows.groupby("container")["size"].sum().max() <= 100
    held = rows.groupby("id")["size"].sum()
    assert all(held[i] == (s or 0) for i, s in sizes) and (rows.groupby("id").size()[[i for i, s in sizes if (s or 0) <= 100]] == 1).all()
    assert len(rows[rows["id"] == 5]) == 4
    assert fill_containers(spark.createDataFrame([], "id int, size int"), 100).count() == 0


def test_permute_is_a_permutation():
    for size in (1, 2, 3, 10, 257, 1000):
        out = permute(np.arange(size), np.full(size, size), np.full(size, 99))
        assert sorted(out) == list(range(size))


def test_mix_caps_repeats_and_reports(spark):
    docs = [(i, "a b c d e f g h " * 40, "big") for i in range(200)] + [(1000 + i, "word " * 100, "small") for i in range(10)] + [(2000, None, "big"), (2001, "", "small"), (2002, "x", None)]
    targets = [("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2), (None, 0.5, 1)]
    d = spark.createDataFrame(docs, "doc_id int, text string, source string")
    selection, report = mix_sources(d, spark.createDataFrame(targets, "source_name string, target_share double, max_repeats int"), block=64)
    rows = {r.source_name: r for r in report.collect()}
    assert not rows["small"].reachable and not rows["absent"].reachable and rows["big"].reachable
    assert rows["small"].size_reached == 3000 and rows["absent"].size_reached == 0
    assert abs(rows["big"].size_reached / rows["big"].size_asked - 1) < 0.15
    used = selection.groupBy("source", "block", "doc_id").count().agg({"count": "max"}).first()[0]
    assert used <= 3
    assert mix_sources(d.limit(0), spark.createDataFrame(targets, "source_name string, target_share double, max_repeats int"))[1].count() == 3


LONG = "One sentence here. " * 30 + "\n\nNext paragraph, with words; and more.\n" * 40 + "x" * 500 + ".,;" * 200 + " ünïcödé 日本語 " * 50


@pytest.mark.parametrize("text", [LONG, "a" * 3000, "!? " * 400, ".-" * 900, "word " * 2000, "\n".join(["l"] * 700)])
def test_pieces_keep_the_limit_and_the_text(text):
    parts = split_text(text, 100, 10)
    assert all(j - i <= 100 for i, j, *_ in parts)
    assert "".join(text[new:end] for *_, new, end in parts) == text
    size = len(TOKEN.findall(text))
    assert (len(parts) > 1) == (size > 100)
    for (_, last, *_), (first, *_) in zip(parts, parts[1:]):
        assert last - first == 10
    assert all(len(TOKEN.findall(text[start:end])) == j - i for i, j, start, _, end in parts)


def test_split_documents_whole_table(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "short text", 0), (4, LONG, 0), (4, LONG, 0)], "doc_id long, text string, piece int")
    rows = split_documents(docs, 100, 10).toPandas()
    assert rows.groupby("doc_id").size()[[1, 2, 3]].tolist() == [1, 1, 1] and rows["size"].max() <= 100
    assert (rows[rows.doc_id == 4].groupby("piece").size() == 2).all()


def test_token_count_agrees_with_the_pattern(spark):
    texts = ["", None, "a_b c-d", "日本語 ünï 12½ …!?", "a b\tc\r\n\x1cd\x85e", "²³ x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t"))).collect()
    assert [r[0] for r in got] == [len(TOKEN.findall(t or "")) for t in texts]
