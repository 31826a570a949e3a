"""Connected components of a table of links, by large-star and small-star steps.

Every step is a grouped minimum (combined on the map side) and a join that adaptive execution can
split, so a node with very many links does not gather in one task. The links are staged in the
shared folder after each round; nothing but two numbers goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequela.llm.common import release, staged


def _fingerprint(links: DataFrame):
    """Number of links and an order-free hash of them."""
    row = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(hash(u, v))")).first()
    return tuple(row)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Columns ``node`` and ``root`` (smallest node reachable) for every node that has a link.

    Loops and repeated links are allowed; links with a null end are left out.
    """
    links = (links.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
             .where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    links = staged(links, "links")
    before = _fingerprint(links)
    while before[0]:
        # Large star: every neighbour above u points to the smallest of u and its neighbours.
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: u and its smaller neighbours point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = staged(joined.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        release(links)
        links, after = small, _fingerprint(small)
        if after == before:
            break
        before = after
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
