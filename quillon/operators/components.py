"""Connected components by alternating large-star and small-star steps.

Each step is a grouped aggregation over the edge table. A vertex's neighbours are never
gathered: a minimum is aggregated (with map-side combine) and joined back, so that a
vertex of very high degree does not land in one task as a list. Lineage is cut every
round by a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.store import Stages

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, component), component being the smallest node that is reachable.

    Edges with a null end are ignored; self-loops make single nodes. Any ordered type
    serves as a node key. An empty edge table gives no rows.
    """
    spark = edges.sparkSession
    stages = Stages(spark, "components")
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    current = stages.keep(
        pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "0"
    )
    nodes = current.select(F.col("u").alias("node")).union(current.select("v")).distinct()
    signature = None
    for step in range(1, MAX_ROUNDS):
        # large star: every larger neighbour of u points at the minimum of u's neighbourhood
        both = current.where("u != v")
        both = both.union(both.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        )
        # small star: u and its smaller neighbours point at the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        following = stages.keep(small, str(step))
        now = following.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        stages.drop(str(step - 1) if step > 1 else "none")
        current = following
        if (now["n"], now["s"]) == signature:
            break
        signature = (now["n"], now["s"])
    else:
        raise RuntimeError("connected components did not settle")
    return (
        nodes.join(current.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left")
        .select("node", F.coalesce("m", "node").alias("component"))
    )
