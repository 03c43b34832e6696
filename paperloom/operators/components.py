"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum plus a join, so no neighbour list is ever gathered and a hub with a
third of all edges costs no more than its share of a partial aggregation. The steps end by themselves:
each either lowers an edge's end or leaves all as they are, and the rounds grow with the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node that occurs in an edge; label is the least node of its component.

    Null ends and loops are ignored; repeated edges count once; an empty input gives an empty result.
    """
    pairs = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    pairs = cut(pairs)
    mark = _fingerprint(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        pairs = cut(small)
        now = _fingerprint(pairs)
        if now == mark:
            break
        mark = now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("label"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots).distinct()


def _fingerprint(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]
