"""Connected components of links between ids, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.scratch import written


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) of all ids in ``links`` (``a, b``).

    Stars in turn: every id hands its larger neighbours, then its smaller ones, to the
    smallest neighbour it knows. The number of links never grows and a chain's length
    is cut by a factor each round, so rounds grow with its logarithm. Each round is
    written, so a lost executor costs one round. Null ids and loops are left out.
    """
    edges = written(
        links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The larger neighbours of an id go to the smallest of its neighbours and itself.
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            edges.join(smallest.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b")).distinct()
        )
        large = written(large, "large-star")
        # The smaller neighbours of an id, and the id, go to the smallest of them.
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(smallest, "a")
            .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        edges = written(small, "small-star")
        state = edges.agg(
            F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.col("a").cast("decimal(20,0)") - F.col("b")), F.lit(0))
        ).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
