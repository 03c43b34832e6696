"""Problem 8: fill containers of a fixed number of tokens with texts, leaving little room.

Sum-of-squares packing, online: an item of size s goes where the sum of squares of the numbers of
containers at each fill level grows least. The levels are one array, so an item costs one pass over it
whatever the number of containers. The items are spread over shards by a hash, each large enough that its
few unfinished containers are a negligible part; shards are independent, so lost tasks only redo theirs.

A text larger than a container is cut into full containers and a rest. Null and empty texts have size 0
and go to the first container of their shard.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut

#: The folder of the public tokenizers' vocabularies.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")

# Fixed value: the pattern that splits text before the merges of a rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def count_tokens(docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """(id, size): the number of tokens of each text in a public byte-level BPE (a rank file)."""
    path = vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    id_type = docs.schema[id_col].dataType.simpleString()

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "size": [len(encoder.encode_ordinary(t)) if t else 0 for t in batch["text"]]})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(sized, f"id {id_type}, size int")


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container number of each item, fill of each container); 0 < size <= capacity for every item."""
    counts = np.zeros(capacity + 1, dtype=np.int64)  # unfinished containers at each fill level
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, fills = np.empty(len(sizes), dtype=np.int64), []
    for i, s in enumerate(sizes):
        s = int(s)
        # growth of the sum of squares, for a new container and for each level an item fits on
        best, level = (0 if s == capacity else 2 * counts[s] + 1), 0
        if s < capacity:
            room = capacity - s
            growth = 2 * (counts[s + 1 : capacity + 1] - counts[1 : room + 1]) + 2
            growth[-1] = 1 - 2 * counts[room]  # becomes full
            growth[counts[1 : room + 1] == 0] = np.iinfo(np.int64).max
            # at equal growth the fullest container
            k = len(growth) - 1 - int(np.argmin(growth[::-1]))
            if growth[k] <= best:
                level = k + 1
        if level:
            bin_ = at[level].pop()
            counts[level] -= 1
        else:
            bin_ = len(fills)
            fills.append(0)
        fills[bin_] += s
        where[i] = bin_
        if fills[bin_] < capacity:
            counts[fills[bin_]] += 1
            at[fills[bin_]].append(bin_)
    return where, np.array(fills, dtype=np.int64)


def fill_containers(sizes: DataFrame, capacity: int, shard_tokens: int = 40_000_000, shard_rows: int = 1_000_000) -> DataFrame:
    """(id, part, container bigint, size, from_token): every item, or part of an oversized one, with its container.

    sizes: id, size. Parts count from 1; only an item larger than the capacity has more than one.
    The number of shards follows from the total size and the number of items (shard_tokens, and no more than
    about shard_rows, each).
    """
    sizes = sizes.select("id", F.coalesce("size", F.lit(0)).alias("size"))
    sizes = cut(sizes)
    held = sizes.agg(F.sum(F.col("size").cast("long")).alias("tokens"), F.count("*").alias("rows")).first()
    shards = max(1, -(-(held["tokens"] or 0) // shard_tokens), -(-held["rows"] // shard_rows))
    id_type = sizes.schema["id"].dataType.simpleString()
    columns = ["id", "part", "container", "size", "from_token"]

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        base = int(part["shard"].iloc[0]) << 36
        part = part.sort_values(["mix", "id"])
        rows, items = [], []
        for doc, size in zip(part["id"], part["size"]):
            whole, rest = divmod(int(size), capacity)
            for k in range(whole):
                rows.append((doc, k + 1, None, capacity, k * capacity))
            if rest:
                items.append((doc, whole + 1, rest, whole * capacity))
            elif not whole:
                rows.append((doc, 1, 0, 0, 0))
        where, fills = pack(np.array([x[2] for x in items], dtype=np.int64), capacity)
        out = [(doc, k, base + int(c), size, start) for (doc, k, size, start), c in zip(items, where)]
        free = len(fills)
        for doc, k, c, size, start in rows:
            if c is None:
                c, free = free, free + 1
            out.append((doc, k, base + c, size, start))
        return pd.DataFrame(out, columns=columns)

    mixed = sizes.withColumn("mix", F.xxhash64(F.lit(7), "id")).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return mixed.groupBy("shard").applyInPandas(packed, f"id {id_type}, part int, container bigint, size int, from_token int")
