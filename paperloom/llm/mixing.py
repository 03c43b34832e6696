"""Problem 9: mix sources to target shares of the total size, with a cap on repeats.

The texts of a source, in hashed order, are one long row of tokens cut into blocks of fixed length. The
output is a row of slots in shards; each shard draws from a multinomial law how many of its slots each
source gets, running sums over the shards number a source's slots 0, 1, 2, ... and a keyed pseudorandom
permutation of the source's blocks (another one for each round over them) maps slot numbers to blocks, so
slots and blocks meet in a plain equi-join on (source, block). The draws of all shards are then levelled out
to the quota of each source: slots drawn beyond it go to sources that drew too few. No block is used more than
max_repeats times; slots a source cannot fill stay empty, or go to the others, and the report says so.

Texts with null or empty text have no tokens and are never used. Texts of a null or unlisted source count
in the total size only. A listed source without texts gets no slot filled. Negative or null shares are 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.pieces import token_count
from paperloom.session import cut

BLOCK = 512
SHARD_SLOTS = 256
BUCKETS = 1024


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..size-1 for each element: a Feistel network, walked until it lands inside."""
    size = np.maximum(size.astype(np.uint64), 1)
    half = np.uint64(1)
    bits = np.maximum(2, np.ceil(np.log2(size.astype(float) + 1)).astype(np.int64))
    half = ((bits + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, open_ = index.astype(np.uint64).copy(), np.ones(len(index), dtype=bool)
    key = key.astype(np.uint64)
    with np.errstate(over="ignore"):
        while open_.any():
            left, right = out[open_] >> half[open_], out[open_] & mask[open_]
            for turn in range(4):
                mixed = (right + key[open_] + np.uint64(turn * 0x9E3779B9)) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(29)
                mixed *= np.uint64(0x94D049BB133111EB)
                mixed ^= mixed >> np.uint64(32)
                left, right = right, left ^ (mixed & mask[open_])
            out[open_] = (left << half[open_]) | right
            open_[open_] = out[open_] >= size[open_]
    return out.astype(np.int64)


def size_texts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, id, size) of every text, narrow rows; the only step that reads texts."""
    return docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), token_count(F.col(text_col)).cast("long").alias("size"))


def place_in_blocks(sized: DataFrame) -> DataFrame:
    """(source, id, size, start): the place of each text in its source's row of tokens.

    Running sums are taken within (source, bucket of the id's hash) and then over the buckets, so that a
    source with a third of all rows is spread over BUCKETS tasks.
    """
    sized = sized.where("size > 0 and source is not null").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("held")).select("source", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["source", "bucket"]).select("source", "id", "size", (F.col("base") + F.col("offset")).alias("start"))


def quotas(shares: list[float], room: list[int], slots: int, refill: bool) -> list[int]:
    """Slots each source is to fill: its share of all, no more than it has room for.

    With refill, what a source lacks goes to those that have room left, in proportion to their shares, until
    nothing is lacking or no source has room; without, those slots stay empty.
    """
    wanted = [s * slots for s in shares]
    if refill:
        open_, goal = {i for i, s in enumerate(shares) if s > 0}, min(slots * min(1.0, sum(shares)), float(sum(r for r, s in zip(room, shares) if s > 0)))
        while open_:
            left = goal - sum(room[i] for i in range(len(shares)) if shares[i] > 0 and i not in open_)
            scale = left / sum(shares[i] for i in open_)
            full = {i for i in open_ if shares[i] * scale > room[i]}
            if not full:
                wanted = [shares[i] * scale if i in open_ else room[i] if shares[i] > 0 else 0 for i in range(len(shares))]
                break
            open_ -= full
        else:
            wanted = [r if s > 0 else 0 for r, s in zip(room, shares)]
    return [min(round(w), r) for w, r in zip(wanted, room)]


def draw_slots(spark, sources: list[tuple[str, float, int, int]], slots: int, seed: int = 17, shard_slots: int = SHARD_SLOTS, chunk_shards: int = 512, refill: bool = False) -> DataFrame:
    """(shard, source, round, block, repeat): the slots of every source, mapped to its blocks.

    sources: (name, share, blocks, max_repeats). Every shard draws its counts from the multinomial law of the
    shares, in chunks of shards; the running sums over chunks are taken in a window of one row a chunk and
    source. What all shards together drew too much of a source (by chance, or beyond its room) is taken from
    slots picked by a permutation of its own and given to the sources that drew too little.
    """
    shards = -(-slots // shard_slots)
    chunks = max(1, -(-shards // chunk_shards))
    shares = np.array([max(0.0, s[1] or 0.0) for s in sources])
    rest = max(0.0, 1.0 - shares.sum())
    law = np.append(shares, rest) / max(shares.sum() + rest, 1e-300)
    quota = quotas([float(x) for x in law[:-1]], [s[2] * max(0, s[3] or 0) for s in sources], slots, refill)

    def counts(chunk: int) -> np.ndarray:
        """Slots of each source (the last column is nobody's) in each shard of a chunk; the same whenever a task is repeated."""
        first = chunk * chunk_shards
        own = min(chunk_shards, shards - first)
        sizes = np.minimum(shard_slots, slots - (first + np.arange(own)) * shard_slots)
        return np.random.default_rng([seed, chunk]).multinomial(sizes, law)

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(int(c), i, int(n)) for c in batch["chunk"] for i, n in enumerate(counts(int(c)).sum(axis=0))]
            yield pd.DataFrame(rows, columns=["chunk", "number", "drawn"])

    grid = spark.range(chunks).withColumnRenamed("id", "chunk").repartition(min(chunks, 4096))
    drawn = grid.mapInPandas(totals, "chunk bigint, number int, drawn bigint")
    sums = {r["number"]: r["n"] for r in drawn.groupBy("number").agg(F.sum("drawn").alias("n")).collect()}
    got = np.array([sums.get(i, 0) for i in range(len(sources) + 1)], dtype=np.int64)
    want = np.append(quota, 0).astype(np.int64)
    spare, lack = np.maximum(got - want, 0), np.maximum(want - got, 0)
    spare_base, lack_end = np.cumsum(spare) - spare, np.cumsum(lack)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, number, base in zip(batch["chunk"], batch["number"], batch["base"]):
                per_shard = counts(int(chunk))[:, number]
                index = int(base) + np.arange(per_shard.sum())
                shard = np.repeat(int(chunk) * chunk_shards + np.arange(len(per_shard)), per_shard)
                owner = np.full(len(index), number)
                if spare[number]:
                    # a permutation of all its slots picks those given away; their places among all such tell to whom
                    place = permute(index, np.full(len(index), got[number]), np.full(len(index), seed + 7 * number + 1))
                    given = place >= want[number]
                    nth = spare_base[number] + place - want[number]
                    to = np.minimum(np.searchsorted(lack_end, nth, side="right"), len(want) - 1)
                    taken = given & (nth < lack_end[-1])
                    index = np.where(taken, got[to] + nth - (lack_end[to] - lack[to]), place)
                    owner = np.where(taken, to, np.where(given, -1, number))
                for i in np.unique(owner[(owner >= 0) & (owner < len(sources))]):
                    name, _, blocks, repeats = sources[i]
                    own = (owner == i) & (index < blocks * max(0, repeats or 0))
                    turn = index[own] // max(blocks, 1)
                    block = permute(index[own] % max(blocks, 1), np.full(own.sum(), blocks), turn * 1000003 + zlib.crc32(name.encode()) + seed)
                    yield pd.DataFrame({"shard": shard[own], "source": name, "block": block, "repeat": turn.astype("int32")})

    before = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    based = drawn.select("chunk", "number", F.coalesce(F.sum("drawn").over(before), F.lit(0)).alias("base"))
    return based.mapInPandas(expand, "shard bigint, source string, block bigint, repeat int")


def mix_sources(
    docs: DataFrame, targets: DataFrame, block: int = BLOCK, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", refill: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    selection: shard, source, block, repeat, id, from_token, to_token: which tokens of which text stand in
    the slots of each output shard. report: a row for each source of targets with the size it has, the size
    its share asks for, what it reached, its share of the total size and of all that was reached, and whether
    it can reach its share at all. The total size is that of all texts; what a source lacks stays empty, so
    that the others keep their shares of the total, or goes to the others with refill.

    targets (source_name, target_share, max_repeats): the first row of a name counts. One row a listed source
    comes to the driver, never more than the list of targets has.
    """
    spark = docs.sparkSession
    sized = cut(size_texts(docs, id_col, source_col, text_col))
    placed = cut(place_in_blocks(sized))
    total = sized.agg(F.sum("size")).first()[0] or 0
    held = sized.where("size > 0 and source is not null").groupBy("source").agg(F.sum("size").alias("size"))
    asked = targets.where("source_name is not null").groupBy("source_name").agg(F.min(F.struct("max_repeats", "target_share")).alias("t"))
    asked = asked.select("source_name", "t.target_share", "t.max_repeats")
    sizes = cut(asked.join(held, asked["source_name"] == held["source"], "left").select("source_name", "target_share", "max_repeats", F.coalesce("size", F.lit(0)).alias("size")))
    rows = sizes.orderBy("source_name").collect()
    listed = [(r["source_name"], float(r["target_share"] or 0), -(-r["size"] // block), int(r["max_repeats"] or 0)) for r in rows]
    slots = draw_slots(spark, listed, -(-total // block), seed, SHARD_SLOTS, 512, refill)
    spans = placed.select("source", "id", "size", "start", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    spans = spans.select(
        "source",
        "block",
        "id",
        F.greatest(F.col("block") * block - F.col("start"), F.lit(0)).alias("from_token"),
        F.least((F.col("block") + 1) * block - F.col("start"), F.col("size")).alias("to_token"),
    )
    selection = slots.join(spans, ["source", "block"]).select("shard", "source", "block", "repeat", "id", "from_token", "to_token").withColumnRenamed("id", id_col)
    filled = slots.groupBy("source", "block").agg(F.count("*").alias("times"))
    block_size = spans.groupBy("source", "block").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("tokens"))
    reached = filled.join(block_size, ["source", "block"]).groupBy("source").agg(F.sum(F.col("times") * F.col("tokens")).alias("reached"))
    report = sizes.join(reached, sizes["source_name"] == reached["source"], "left").select(
        "source_name",
        "target_share",
        "max_repeats",
        F.col("size").alias("size_held"),
        (F.col("target_share") * total).alias("size_asked"),
        F.coalesce("reached", F.lit(0)).alias("size_reached"),
    )
    share = F.sum("size_reached").over(Window.partitionBy())
    report = report.select(
        "*",
        (F.col("size_reached") / F.lit(max(total, 1))).alias("share_of_total"),
        F.coalesce(F.col("size_reached") / F.nullif(share, F.lit(0)), F.lit(0.0)).alias("actual_share"),
        (F.coalesce(F.col("max_repeats"), F.lit(0)) * F.col("size_held") >= F.coalesce(F.col("target_share"), F.lit(0.0)) * total).alias("reachable"),
    )
    return selection, report
