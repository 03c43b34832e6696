"""Problem 6: map values people typed to the entry of a reference list they mean.

Every entry of the list has spellings: its canonical value, its description and the other names the caller
knows of it. A BK-tree over the spellings (triangle inequality over a true edit metric) is broadcast; each
distinct typed value walks the tree and gets every spelling within its threshold, the nearest entry wins, and
the winners of several trees (shards of a large list) are merged by the least distance.

Null and blank values get no row. A value that is exactly a canonical one maps to it; a value equally
near to two entries, or near to none, maps to 0. Repeated values are looked up once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.segment_join import banded
from paperloom.session import cut

#: Values that meet the tree of one shard in one task.
SHARD_VALUES = 500_000

def tidy(text: str) -> str:
    """Lower case without accents, outer brackets and stops, one space between words, digits of references as 0."""
    text = unicodedata.normalize("NFKC", text).lower()
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    text = re.sub(r"\s+", " ", text).strip()
    while len(text) > 2 and text[0] == "(" and text[-1] == ")" and _encloses(text):
        text = text[1:-1].strip()
    text = text.rstrip(".,;: ") or text
    return re.sub(r"\d{4,}", "0000", text)


def _encloses(text: str) -> bool:
    """Whether the first bracket is closed by the last one."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return i == len(text) - 1
    return False


def places(word: str) -> dict[str, int]:
    """For each letter of a word the places it stands at, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(word):
        out[c] = out.get(c, 0) | 1 << i
    return out


def edits(a: str, b: str, of_a: dict[str, int] | None = None) -> int:
    """Levenshtein distance, a true metric; a whole column of the table is held in the bits of two numbers.

    of_a: places(a), if a is compared with many words.
    """
    if not a:
        return len(b)
    of_a = of_a or places(a)
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = every, 0, len(a)
    for c in b:
        same = of_a.get(c, 0)
        level = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | (every & ~(across | up)), up & across
        distance += bool(more & last) - bool(less & last)
        more, less = (more << 1) | 1, less << 1
        up, down = (less | ~(level | more)) & every, more & level & every
    return distance


class BKTree:
    """Spellings with their entries; a child hangs under its parent by their distance.

    The nodes are a flat list, children being places in it, so that a tree of any depth can be sent to tasks.
    """

    def __init__(self) -> None:
        self.nodes: list[tuple[str, set[int], dict[int, int]]] = []

    def add(self, word: str, entry: int) -> None:
        at = 0 if self.nodes else None
        while at is not None:
            own, entries, children = self.nodes[at]
            d = edits(word, own)
            if d == 0:
                entries.add(entry)
                return
            at = children.setdefault(d, len(self.nodes))
            if at == len(self.nodes):
                break
        self.nodes.append((word, {entry}, {}))

    def within(self, word: str, limit: int) -> list[tuple[int, str, set[int]]]:
        """(distance, spelling, entries) of every spelling within the limit."""
        found, open_, of_word = [], [0] if self.nodes else [], places(word)
        while open_:
            own, entries, children = self.nodes[open_.pop()]
            d = edits(word, own, of_word)
            if d <= limit:
                found.append((d, own, entries))
            open_ += [child for gap, child in children.items() if d - limit <= gap <= d + limit]
        return found


def threshold(word: str) -> int:
    """Edits within which every spelling lies that `meant` may accept: two for each slip, as a swap is two edits.

    Two slips need a spelling of 10 letters, which is at most two letters longer than the word.
    """
    return 0 if len(word) <= 2 else 2 if len(word) < 8 else 4


def _slips(word: str, spelling: str) -> int:
    """Slips of the hand: as edits, but a swap of neighbours or a doubled letter is one."""
    return banded(word, spelling, 3)


def meant(tree: BKTree, word: str) -> tuple[int, int]:
    """(entry or 0, distance). Numbers must agree exactly, and short spellings allow one slip at most.

    Codes of three letters are near each other as they are: in one, a letter put in or two changed places are
    taken for a slip, another letter or a missing one is not.
    """
    best: dict[int, set[int]] = {}
    digits = re.findall(r"\d+", word)
    for d, spelling, entries in tree.within(word, threshold(word)):
        slips = 0 if d == 0 else _slips(word, spelling)
        room = 0 if min(len(spelling), len(word)) <= 2 else 1 if len(spelling) <= 9 else 2
        if len(spelling) == 3 and d and not (sorted(word) == sorted(spelling) or len(word) == 4 or len(spelling.strip("abcdefghijklmnopqrstuvwxyz"))):
            continue
        if slips <= room and re.findall(r"\d+", spelling) == digits and (d == 0 or any(c.isalpha() for c in spelling)):
            best.setdefault(slips, set()).update(entries)
    if not best:
        return 0, -1
    least = min(best)
    return (next(iter(best[least])) if len(best[least]) == 1 else 0), least


def map_values(values: DataFrame, reference: DataFrame, names: DataFrame | None = None, max_entries: int = 20_000, shards: int = 0) -> DataFrame:
    """(field, value, ref_id, distance): every distinct non-blank value with its entry, 0 if none.

    values: field, value. reference: ref_id, field, canonical, description. names: ref_id, name, other names of
    entries. A list of up to max_entries spellings (counted first) makes one tree a field, grown once and
    broadcast. A longer one is cut into shards: each value meets the tree of each shard in a task of its own,
    and the winners of all shards are merged: an exact canonical value first, then the fewest slips.
    """
    spark = values.sparkSession
    distinct = values.select("field", "value").where("field is not null and value is not null and value rlike '[^ \\\\s]'").distinct()
    reference = reference.select("ref_id", "field", "canonical", "description").where("ref_id is not null and field is not null and canonical is not null")
    every = reference.select("ref_id", "field", F.col("canonical").alias("spelling"), F.lit(True).alias("exact"))
    every = every.unionByName(reference.where("description is not null").select("ref_id", "field", F.col("description").alias("spelling"), F.lit(False).alias("exact")))
    if names is not None:
        known = names.where("name is not null").join(reference.select("ref_id", "field"), "ref_id")
        every = every.unionByName(known.select("ref_id", "field", F.col("name").alias("spelling"), F.lit(False).alias("exact")))
    size = every.limit(max_entries + 1).count()
    # few bytes but much work a row: a stated number of partitions, by something the rows are not partitioned by yet,
    # is neither coalesced nor dropped
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if size <= max_entries and not shards:
        held = spark.sparkContext.broadcast(grow([tuple(r) for r in every.collect()]))

        def lookup(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            trees, exact = held.value
            for batch in batches:
                out = [(f, v, *find(trees, exact, f, v)) for f, v in zip(batch["field"], batch["value"])]
                yield pd.DataFrame(out, columns=["field", "value", "ref_id", "distance"])

        return distinct.repartition(spread, F.xxhash64("value", "field")).mapInPandas(lookup, "field string, value string, ref_id int, distance int")

    distinct = cut(distinct)
    parts = shards or -(-every.count() // max_entries)
    salts = max(1, -(-distinct.count() // SHARD_VALUES))
    left = distinct.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int"))
    # spellings of one text stay together, so that what is equal is seen to be
    right = every.withColumn("shard", F.pmod(F.xxhash64("spelling"), F.lit(parts)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def shard_lookup(words: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        trees, exact = grow(list(entries[["ref_id", "field", "spelling", "exact"]].itertuples(index=False, name=None)))
        out = [(f, v, *find(trees, exact, f, v), (f, v) in exact) for f, v in zip(words["field"], words["value"])]
        return pd.DataFrame(out, columns=["field", "value", "ref_id", "distance", "exact"])

    found = left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInPandas(shard_lookup, "field string, value string, ref_id int, distance int, exact boolean")
    rank = F.when(F.col("exact"), -1).when(F.col("distance") >= 0, F.col("distance"))
    winner = found.withColumn("rank", rank).where("rank is not null").groupBy("field", "value", "rank").agg(F.min("ref_id").alias("low"), F.max("ref_id").alias("high"))
    best = winner.groupBy("field", "value").agg(F.min_by(F.struct("rank", "low", "high"), "rank").alias("b"))
    ref_id = F.when((F.col("b.rank") == -1) | (F.col("b.low") == F.col("b.high")), F.col("b.low"))
    return distinct.join(best, ["field", "value"], "left").select(
        "field", "value", F.coalesce(ref_id, F.lit(0)).alias("ref_id"), F.when(F.col("b.rank").isNull(), -1).otherwise(F.greatest(F.col("b.rank"), F.lit(0))).alias("distance")
    )


Trees = tuple[dict[str, BKTree], dict[tuple[str, str], int]]


def grow(rows: list[tuple]) -> Trees:
    """(a tree a field, entries of the exact canonical values) from (ref_id, field, spelling, whether it is canonical)."""
    trees: dict[str, BKTree] = {}
    exact: dict[tuple[str, str], int] = {}
    # in a fixed order, so that the tree is the same wherever it is grown
    for ref_id, field, spelling, canonical in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if canonical:
            exact[field, spelling] = min(int(ref_id), exact.get((field, spelling), int(ref_id)))
        if word := tidy(spelling):
            trees.setdefault(field, BKTree()).add(word, int(ref_id))
    return trees, exact


def find(trees: dict[str, BKTree], exact: dict[tuple[str, str], int], field: str, value: str) -> tuple[int, int]:
    if (field, value) in exact:
        return exact[field, value], 0
    return meant(trees[field], tidy(value)) if field in trees else (0, -1)
