"""The mixing is run by the queries that rest on it."""

import pytest
from pyspark.sql import functions as F

from paperloom.llm import mixing
from paperloom.llm.mixing import mix_sources, quotas
from paperloom.llm.queries import p9_found


def test_p9_found_runs_the_mixing(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a", "some words here"), (2, "b", "more")], "doc_id int, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", 0.5, 1), ("b", 0.9, 1)], "source_name string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    assert [r.source_name for r in p9_found(spark, str(tmp_path)).collect()] == ["b"]
    drawn = lambda *_: spark.range(1).select(F.raise_error(F.lit("drawn")).cast("bigint").alias("shard"), F.lit("a").alias("source"), F.lit(0).cast("bigint").alias("block"), F.raise_error(F.lit("drawn")).cast("int").alias("repeat"))
    monkeypatch.setattr(mixing, "draw_slots", lambda *a: drawn().where("repeat >= 0"))
    with pytest.raises(Exception, match="drawn"):
        p9_found(spark, str(tmp_path)).collect()


def test_quotas_keep_to_room_and_refill():
    assert quotas([0.5, 0.3, 0.2], [100, 100, 5], 100, False) == [50, 30, 5]
    assert quotas([0.5, 0.3, 0.2], [100, 100, 5], 100, True) == [59, 36, 5]
    assert quotas([0.5, 0.3, 0.2], [10, 20, 5], 100, True) == [10, 20, 5]
    assert quotas([0.5, 0.0], [70, 100], 100, True) == [50, 0] and quotas([], [], 10, True) == []


@pytest.mark.parametrize("refill", [False, True])
def test_shares_are_met_and_no_block_is_used_too_often(spark, refill):
    rows = [(i, "big" if i % 3 else "mid", "word " * 40) for i in range(600)] + [(1000 + i, "tiny", "word " * 40) for i in range(6)] + [(2000, None, "word " * 40), (2001, "big", None)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 3), ("none", 0.0, None)], "source_name string, target_share double, max_repeats int")
    selection, report = mix_sources(docs, targets, block=16, refill=refill)
    by = {r.source_name: r for r in report.collect()}
    assert by["tiny"].size_reached == 3 * 240 and not by["tiny"].reachable and by["none"].size_reached == 0
    if refill:
        assert abs(sum(r.size_reached for r in by.values()) - 607 * 40) < 600
        assert abs(by["big"].size_reached / by["mid"].size_reached - 0.5 / 0.3) < 0.02
    else:
        assert abs(by["big"].share_of_total - 0.5) < 0.005 and abs(by["mid"].share_of_total - 0.3) < 0.005
    used = selection.groupBy("source", "block").agg(F.count_distinct("shard", "repeat").alias("times"), F.max("repeat").alias("last")).groupBy("source").agg(F.max("times").alias("t"), F.max("last").alias("r"))
    assert {r.source: (r.t <= limit and r.r < limit) for r in used.collect() for limit in ({"big": 1, "mid": 2, "tiny": 3}[r.source],)} == {"big": True, "mid": True, "tiny": True}
    reached = {r.source: r.n for r in selection.groupBy("source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("n")).collect()}
    assert reached == {s: r.size_reached for s, r in by.items() if r.size_reached}
