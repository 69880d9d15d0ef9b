"""Connected components of a link table, by rounds of joins.

Each round lets every node point its larger neighbours, then its smaller ones,
to the smallest node it sees. Rounds grow with the logarithm of a component's
diameter. Minima are folded before each shuffle and nodes with many links are
split by adaptive execution, so no component is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from skilltrend.plans.checkpoints import discard, staged_at
from skilltrend.plans.stages import Stages


def _pointed(links: DataFrame, larger: bool) -> DataFrame:
    """Links of each node's neighbours to the smallest node that it sees."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))) if larger else links
    least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    seen = both.join(least, "a")
    if larger:
        out = seen.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = seen.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def _mark(links: DataFrame) -> Row:
    """What tells one set of links from another."""
    return links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 7))")).first()


def components(links: DataFrame, a: str = "a", b: str = "b", stages: Stages | None = None) -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) for each node that is not itself a root.

    ``links`` are undirected; repeated links and links of a node to itself count
    for nothing, links with a null end are ignored, and no links give no rows.
    The result's folder goes with the run ``stages`` if there is one.
    """
    spark = links.sparkSession
    whole = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    current = whole.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    current, path = staged_at(current, "links")
    mark = _mark(current)  # stars, as links often are to begin with, need one turn only
    while True:
        # Each link runs from the larger to the smaller node.
        stars = _pointed(_pointed(current, larger=True), larger=False)
        stars, new_path = staged_at(stars, "links")
        new_mark = _mark(stars)
        discard(spark, path)
        current, path = stars, new_path
        if new_mark == mark:
            if stages is not None:
                stages.adopt(current, path)
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = new_mark
