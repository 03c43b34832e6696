"""Edit-distance self-join by the pigeonhole principle.

A key of length n is cut into k + 1 segments. Two keys within edit distance k share at least one whole
segment, found in the other key at a place shifted by at most the edits before and after it. The
segments form an inverted index (an ordinary equi-join in Spark), shifted substrings of the longer key
probe it, and the candidates left are verified with a banded edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """Start and length of the k + 1 near-equal segments of a key of length n (the last ones longer)."""
    base, extra = divmod(n, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = base + (1 if i >= k + 1 - extra else 0)
        out.append((at, size))
        at += size
    return out


def probes(key: str, k: int, least: int, longer: bool = False) -> Iterator[tuple[int, int, str]]:
    """(length, segment number, substring) to look up among keys no longer than this one; with longer, among those too."""
    n = len(key)
    for length in range(n + 1, n + k + 1) if longer else ():
        gap = length - n
        for i, (start, size) in enumerate(segments(length, k)):
            if size:
                for at in range(max(0, start - gap - (k - gap) // 2), min(n - size, start + (k - gap) // 2) + 1):
                    yield length, i, key[at : at + size]
    for length in range(max(least, n - k), n + 1):
        gap = n - length
        for i, (start, size) in enumerate(segments(length, k)):
            if size == 0:
                continue
            low, high = start - (k - gap) // 2, start + gap + (k - gap) // 2
            low, high = max(low, start - i), min(high, start + gap + i) if i < k else high
            for at in range(max(0, low), min(n - size, high) + 1):
                yield length, i, key[at : at + size]


def banded(a: str, b: str, k: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between a and b, or k + 1 if more than k.

    Only the band of 2k + 1 diagonals is filled in, and it stops once a whole row exceeds k.
    """
    if abs(len(a) - len(b)) > k:
        return k + 1
    if a == b:
        return 0
    big = k + 1
    before: dict[int, int] = {}
    row = {j: j for j in range(0, min(len(b), k) + 1)}
    for i in range(1, len(a) + 1):
        new: dict[int, int] = {}
        for j in range(max(0, i - k), min(len(b), i + k) + 1):
            if j == 0:
                new[0] = i
                continue
            cost = min(row.get(j, big) + 1, new.get(j - 1, big) + 1, row.get(j - 1, big) + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, before.get(j - 2, big) + 1)
            new[j] = min(cost, big)
        if min(new.values()) > k:
            return big
        before, row = row, new
    return min(row.get(len(b), big), big)


#: Keys of role s ask those of role f; all others ask their own role. Keys of role r are asked like those of no role, but ask nothing.
OTHER_ROLE = {"s": "f", "f": "s", "r": ""}
_LETTERS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")}


def letter_bits(key: str) -> int:
    """One bit for each letter or digit in the key, and one more for a letter that stands there twice.

    An insertion or deletion changes one bit at most, a replacement two, a swap none.
    """
    bits = 0
    for c in key:
        if (at := _LETTERS.get(c)) is not None:
            if at < 26 and bits >> at & 1:
                at += 36
            bits |= 1 << at
    return bits


def _index_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for space, key, k, role, kinds, rid in zip(*(batch[c] for c in ("space", "key", "k", "role", "kinds", "id"))):
            space += f"|{'' if role == 'r' else role}"
            bits, room = letter_bits(key), 2 * k
            for i, (at, size) in enumerate(segments(len(key), k)):
                if size:
                    out.append((f"{space}|{k}|{len(key)}|{i}|{key[at : at + size]}", bits, room, kinds, rid))
            if k == 1:
                out.append((f"{space}|swap|{key}", bits, room, kinds, rid))
        yield pd.DataFrame(out, columns=["gram", "left_bits", "room", "left_kinds", "left"])


def _probe_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = set()
        for space, key, k, role, kinds, rid in zip(*(batch[c] for c in ("space", "key", "k", "role", "kinds", "id"))):
            if role in ("f", "r"):
                continue
            space += f"|{OTHER_ROLE.get(role, role)}"
            bits = letter_bits(key)
            for length, i, piece in probes(key, k, 1, longer=role == "s"):
                out.add((f"{space}|{k}|{length}|{i}|{piece}", bits, kinds, rid))
            if k == 1:
                for i in range(len(key) - 1):
                    if key[i] != key[i + 1]:
                        out.add((f"{space}|swap|{key[:i]}{key[i + 1]}{key[i]}{key[i + 2 :]}", bits, kinds, rid))
        yield pd.DataFrame(list(out), columns=["gram", "right_bits", "right_kinds", "right"])


def segment_join(keys: DataFrame, rids: DataFrame | None = None, classes: tuple[int, ...] = ()) -> DataFrame:
    """Candidate pairs (left_rid, right_rid), distinct and left_rid <> right_rid, of keys that may be near.

    keys: space string (only keys of one space meet), key string, k int (keys of one space meet within their
    k), rid string, and, if given, role string: keys with the role s ask those with the role f only, whatever
    their lengths, so s is best given to the side that has fewer keys; keys with the role r are found by those
    without a role, but look for none themselves. A record may have several keys. Null or empty keys meet nothing.
    rids: all rid of keys, if they are at hand. classes: bits of the column kinds (long) of keys; records meet only
    if of each class they have a bit in common, so one of unknown kind has all. Every pair of one space whose keys are within k insertions,
    deletions and replacements, and of which the shorter one has more than k letters, is in the result, in one of
    the two directions. With k = 1 so are those one swap of neighbours apart: a swap is
    two replacements, which would need shorter, less telling segments, so its variants are looked up whole.

    What meets on a segment but has other letters is dropped within the join. A record goes through it as a
    number; two records with one number are both candidates. The planner takes what a record is cut into to be as
    small as the record, so the join is one of sorted rows by a hint: neither side is ever sent to the driver.
    """
    if "role" not in keys.columns:
        keys = keys.withColumn("role", F.lit(""))
    if "kinds" not in keys.columns:
        keys = keys.withColumn("kinds", F.lit(-1).cast("bigint"))
    ids = (keys if rids is None else rids).select("rid").distinct().select(F.xxhash64("rid").alias("id"), "rid")
    keys = keys.where("key is not null and key <> '' and space is not null").withColumn("id", F.xxhash64("rid")).drop("rid")
    index = keys.mapInPandas(_index_rows, "gram string, left_bits bigint, room int, left_kinds bigint, left bigint").select(F.xxhash64("gram").alias("g"), "left_bits", "room", "left_kinds", "left")
    probe = keys.mapInPandas(_probe_rows, "gram string, right_bits bigint, right_kinds bigint, right bigint").select(F.xxhash64("gram").alias("g"), "right_bits", "right_kinds", "right")
    near = F.bit_count(F.col("left_bits").bitwiseXOR(F.col("right_bits"))) <= F.col("room")
    for bits in classes:
        near = near & (F.col("left_kinds").bitwiseAND(F.col("right_kinds")).bitwiseAND(F.lit(bits).cast("bigint")) != 0)
    pairs = index.hint("merge").join(probe, "g").where(near & (F.col("left") != F.col("right"))).select("left", "right").distinct()
    side = lambda c: ids.select(F.col("id").alias(c), F.col("rid").alias(f"{c}_rid"))
    return pairs.join(side("left"), "left").join(side("right"), "right").select("left_rid", "right_rid")
