"""Problem 4: percentiles of very large numeric columns from mergeable relative-rank sketches.

A sketch is a row of compactors. A full compactor sorts its items, protects the largest ones and halves
some of the rest into the next level, where an item stands for twice as many. As the largest values are
never the ones thinned first, the error of a rank is a small multiple of the number of items above it:
high percentiles are nearly exact. Sketches of partitions, buckets or days merge level by level.

Null values and values outside the stated range are left out; a group without values has no sketch.
Nulls in a grouping column form a group of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import cut

#: Items of one section of a compactor; the error of a rank is about 1/K of the items above it.
K = 64


class Sketch:
    """Relative-rank sketch, accurate towards the largest values."""

    def __init__(self, k: int = K) -> None:
        self.k, self.n = k, 0
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.states: list[int] = [0]
        self.low, self.high = np.inf, -np.inf

    def _capacity(self, level: int) -> int:
        sections = max(3, int(np.ceil(np.log2(max(2.0, self.n / (self.k * 2.0**level))))))
        return 2 * self.k * sections

    def add(self, values: np.ndarray) -> None:
        if not len(values):
            return
        for at in range(0, len(values), 1 << 16):
            part = np.asarray(values[at : at + (1 << 16)], dtype=float)
            self.n += len(part)
            self.low, self.high = min(self.low, part.min()), max(self.high, part.max())
            self.levels[0] = np.concatenate([self.levels[0], part])
            self._settle()

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        for level, items in enumerate(other.levels):
            self._grow(level)
            self.levels[level] = np.concatenate([self.levels[level], items])
            self.states[level] |= other.states[level]
        self._settle()

    def _grow(self, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append(np.empty(0))
            self.states.append(0)

    def _settle(self) -> None:
        level = 0
        while level < len(self.levels):
            while len(self.levels[level]) >= (capacity := self._capacity(level)):
                items = np.sort(self.levels[level])
                state = self.states[level]
                trailing = (~state & (state + 1)).bit_length()  # 1 + trailing ones
                keep = max(capacity // 2, capacity - trailing * self.k)
                cut = (len(items) - keep) & ~1
                if cut <= 0:
                    break
                coin = (state * 2654435761 + level * 40503 + self.n) >> 7 & 1
                self._grow(level + 1)
                self.levels[level + 1] = np.concatenate([self.levels[level + 1], items[coin:cut:2]])
                self.levels[level] = items[cut:]
                self.states[level] = state + 1
            level += 1

    def _weighed(self) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(items), 2.0**level) for level, items in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    def quantiles(self, shares: list[float], shift: float = 0.0) -> list[float]:
        """Values at the given shares; shift moves each rank by that part of the items above it (for bounds)."""
        if not self.n:
            return [float("nan")] * len(shares)
        values, cumulated = self._weighed()
        total, out = cumulated[-1], []
        for share in shares:
            share = min(1.0, max(0.0, share + shift * (1 - share)))
            at = int(np.searchsorted(cumulated, max(share * total, 1.0), side="left"))
            out.append(self.high if share >= 1 else float(values[min(at, len(values) - 1)]))
        return out

    def to_bytes(self) -> bytes:
        head = np.array([self.k, self.n, len(self.levels), self.low, self.high], dtype="<f8")
        sizes = np.array([x for items, state in zip(self.levels, self.states) for x in (len(items), state)], dtype="<i8")
        return head.tobytes() + sizes.tobytes() + np.concatenate(self.levels).astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Sketch:
        k, n, count, low, high = np.frombuffer(data, "<f8", 5)
        sketch, count = cls(int(k)), int(count)
        sizes = np.frombuffer(data, "<i8", 2 * count, 40)
        items, at = np.frombuffer(data, "<f8", -1, 40 + 16 * count), 0
        sketch.n, sketch.low, sketch.high = int(n), float(low), float(high)
        sketch.levels, sketch.states = [], []
        for size, state in zip(sizes[::2], sizes[1::2]):
            sketch.levels.append(items[at : at + size].copy())
            sketch.states.append(int(state))
            at += size
        return sketch


def error_bound(k: int = K) -> float:
    """Greatest error of a rank, as a part of the items above it, that the tests hold the sketch to."""
    return 2.0 / k


def sketch_groups(df: DataFrame, groups: list[str], value: str, k: int = K, buckets: int = 32, held: int = 4096) -> DataFrame:
    """(*groups, sketch binary): one sketch a group.

    Each task sketches what it reads (at most `held` groups at a time), then the sketches of a group are
    merged in two rounds, so that no task gets all partitions' sketches of a hot group.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*groups).schema) + ", sketch binary"

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketches: dict[tuple, Sketch] = {}
        flush = lambda: pd.DataFrame([(*key, s.to_bytes()) for key, s in sketches.items()], columns=[*groups, "sketch"])
        for batch in batches:
            for key, part in batch.groupby(groups, dropna=False, sort=False)[value]:
                key = tuple(None if pd.isna(x) else x for x in (key if isinstance(key, tuple) else (key,)))
                sketches.setdefault(key, Sketch(k)).add(part.to_numpy())
            if len(sketches) > held:
                yield flush()
                sketches.clear()
        yield flush()

    local_sketches = df.select(*groups, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value)).mapInPandas(local, schema)
    salted = local_sketches.withColumn("__salt", F.pmod(F.xxhash64("sketch"), F.lit(buckets)))
    return merge_sketches(merge_sketches(salted, [*groups, "__salt"]).drop("__salt"), groups)


def merge_sketches(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """(*groups, sketch): the sketches of each group as one, e.g. those of days as that of all days."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sketches.select(*groups).schema) + ", sketch binary"

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_key, held, out = None, None, []
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                key = tuple(None if pd.isna(x) else x for x in row[:-1])
                if held is None or key != held_key:
                    if held is not None:
                        out.append((*held_key, held.to_bytes()))
                    held_key, held = key, Sketch.from_bytes(row[-1])
                else:
                    held.merge(Sketch.from_bytes(row[-1]))
            if len(out) > 512:
                yield pd.DataFrame(out, columns=[*groups, "sketch"])
                out = []
        if held is not None:
            out.append((*held_key, held.to_bytes()))
        yield pd.DataFrame(out, columns=[*groups, "sketch"])

    return sketches.select(*groups, "sketch").repartition(*groups).sortWithinPartitions(*groups).mapInPandas(merged, schema)


def read_quantiles(sketches: DataFrame, groups: list[str], shares: dict[str, float]) -> DataFrame:
    """(*groups, n, and for each name of shares: name, name_low, name_high): estimates and their bounds."""
    names = list(shares)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sketches.select(*groups).schema) + ", n bigint"
    schema += "".join(f", `{n}` double, `{n}_low` double, `{n}_high` double" for n in names)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch["sketch"]:
                s = Sketch.from_bytes(data)
                bound = error_bound(s.k)
                mid, low, high = (s.quantiles(list(shares.values()), x) for x in (0.0, -bound, bound))
                rows.append([s.n, *(v for three in zip(mid, low, high) for v in three)])
            values = pd.DataFrame(rows, columns=["n", *(c for n in names for c in (n, f"{n}_low", f"{n}_high"))], index=batch.index)
            yield pd.concat([batch[groups], values], axis=1)

    return sketches.select(*groups, "sketch").mapInPandas(read, schema)


def exact_quantiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(*groups, and a column for each name of shares): exact percentiles, interpolated between the two ranks next to them.

    The values are counted first. The different values are then cut into ranges, whose sums tell in which of them
    each rank lies, and only there running sums are taken: no group's values are ever in one task. Groups without
    values have no row; nulls and NaN are left out.
    """
    counted = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*groups, value).agg(F.count("*").alias("__n"))
    ranged = cut(cut(counted).repartitionByRange(*groups, value).withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy(*groups, "__part").agg(F.sum("__n").alias("__held"))
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumns({"__base": F.coalesce(F.sum("__held").over(before), F.lit(0)), "__all": F.sum("__held").over(Window.partitionBy(*groups))})
    wanted = [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), (F.floor if side == 0 else F.ceil)(F.lit(p) * (F.col("__all") - 1)).cast("long").alias("rank")) for name, p in shares.items() for side in (0, 1)]
    ranks = placed.select(*groups, "__part", "__base", "__held", "__all", F.explode(F.array(*wanted)).alias("w")).where("w.rank >= __base and w.rank < __base + __held")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"v.{c}")) for c in (*groups, "__part")]
    inside = Window.partitionBy(*groups, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    needed = ranged.alias("v").join(ranks.select(*groups, "__part").distinct().alias("r"), same, "left_semi").withColumn("__to", F.sum("__n").over(inside))
    hit = F.col("w.rank") - F.col("__base")
    found = ranks.alias("r").join(needed.alias("v"), same).where((F.col("__to") > hit) & (F.col("__to") - F.col("__n") <= hit)).select(*[F.col(f"r.{c}").alias(c) for c in groups], "__all", "w.name", "w.side", F.col(f"v.{value}").cast("double").alias("at"))
    out = []
    for name, p in shares.items():
        low, high = (F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("at"))) for side in (0, 1))
        rest = F.lit(p) * (F.max("__all") - 1) - F.floor(F.lit(p) * (F.max("__all") - 1))
        out.append((low + (high - low) * rest).alias(name))
    return found.groupBy(*groups).agg(*out)
