import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm.names import compare_companies, compare_persons, link_names, name_pairs, parse_company, parse_person
from paperloom.llm.segment_join import banded, probes, segment_join, segments


def levenshtein(a, b, swaps):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if swaps and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(0, 4))
def test_banded_distance_is_exact_within_its_band(a, b, k):
    assert banded(a, b, k) == min(levenshtein(a, b, True), k + 1)


@settings(max_examples=500, deadline=None)
@given(st.text("ab", min_size=4, max_size=12), st.text("ab", min_size=4, max_size=12), st.integers(1, 3))
def test_pigeonhole_probes_lose_no_near_pair(a, b, k):
    if levenshtein(a, b, False) > k:
        return
    short, long = sorted((a, b), key=len)
    index = {(len(short), i, short[at : at + size]) for i, (at, size) in enumerate(segments(len(short), k))}
    assert index & set(probes(long, k, 1)) or any(size == 0 for _, size in segments(len(short), k))


def test_segment_join_finds_all_near_pairs(spark):
    r = random.Random(3)
    words = {"".join(r.choice("abcd") for _ in range(r.randrange(7, 11))) for _ in range(150)}
    words |= {w[:3] + r.choice("abcd") + w[4:] for w in list(words)[:60]}
    rows = [("s", w, 2, w) for w in words]
    got = {tuple(sorted(x)) for x in segment_join(spark.createDataFrame(rows, "space string, key string, k int, rid string")).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(words), 2) if levenshtein(a, b, False) <= 2}
    assert want <= got


def test_parse_company():
    a, b = parse_company("Cuvoketh & Hefowis Ceramics LLC"), parse_company("Cer. CUVOKETH and Hefowis l.l.c.")
    assert a["core"] == b["core"] == ["cuvoketh", "hefowis"] and a["trade"] == ["ceramics"] and compare_companies(a, b) in ("same", "less", "more")
    assert compare_companies(a, parse_company("Cuvoketh & Hefowis Foods LLC")) == ""
    assert compare_companies(a, parse_company("Cuvoketh & Hefowis Ceramics GmbH")) == ""
    assert parse_company("N/A") is None and parse_company("???") is None


def test_parse_person():
    a = parse_person("Concepción Y. Gokehos Xodozath")
    for other in ("GOKEHOS-XODOZATH, CONCHA Y.", "Concepcon Y. Gokehos Xodozath", "Dr. Concepción Y. Gokehos Xodozath"):
        assert compare_persons(a, parse_person(other)) == "same", other
    assert compare_persons(a, parse_person("C. Y. Gokehos Xodozath")) == "more"
    assert compare_persons(a, parse_person("Edward C. Gokehos Xodozath")) == ""


def test_link_names_keeps_relatives_apart_and_survives_dirt(spark):
    names = [
        "Abigail Haxicand", "ABIGAIL HAXICAND", "Abby Haxicand", "Haxicand, Abigail", "Charlotte Haxicand", "C. Haxicand", "Henry Komalo", "Harriet Komalo",
        "H. Lozavut", "Henry Lozavut", "Hans Lozavut", None, "", "  ", "-", "x" * 20000, "Abigail Haxicand",
    ]
    frame = spark.createDataFrame([("submitter", n, 1) for n in names], "kind string, name string, entity int")
    linked = link_names(frame)
    pairs = {(r.name_a, r.name_b) for r in name_pairs(linked).collect()}
    same = ["ABIGAIL HAXICAND", "Abby Haxicand", "Abigail Haxicand", "Haxicand, Abigail"]
    assert set(itertools.combinations(sorted(same), 2)) <= pairs
    assert ("C. Haxicand", "Charlotte Haxicand") in pairs
    assert len(pairs) == 7  # the ambiguous H. Lozavut joins nobody


def test_link_names_of_nothing(spark):
    assert link_names(spark.createDataFrame([], "kind string, name string")).count() == 0
