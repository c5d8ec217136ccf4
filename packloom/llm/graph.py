"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.runtime import drop_table, materialise

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """DataFrame[node, root] of every node with an edge; root is the smallest
    node of its component. ``edges`` has two long columns, a and b.

    Alternates the large-star and small-star steps: every node links its larger
    (then its smaller) neighbours to the smallest one. The edges stay as many as
    before at most, the minima are aggregated before they are shuffled, and each
    round is written to the shared folder. Nothing is collected but two sums.
    """
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    for _ in range(ROUNDS):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A hub has a large share of all edges. Its minimum is read from a table, so
        # the join takes both sides from plain shuffles, which can be split.
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        last, e = e, materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        drop_table(low)
        drop_table(last)
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
