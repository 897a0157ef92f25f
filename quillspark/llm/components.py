"""Connected components of a graph given by its links, as a few joins per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut


def connected_components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """id and component (least id reachable) for every id in links (a, b: long); links with a null end count for nothing.

    Each round takes the least neighbour of every node and hangs both ends of each link, and what they hung on, on the
    least of the two, until nothing moves; links get flat in about log(length) rounds. Minima are combined before the shuffle, so a node
    with very many links is no hot task. No links give no rows. Raises if max_rounds do not suffice.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        seen = edges.join(least.withColumnRenamed("m", "la"), "a").join(least.select(F.col("a").alias("b"), F.col("m").alias("lb")), "b")
        seen = seen.withColumn("l", F.least("la", "lb")).withColumn("moved", ~((F.col("la") == F.col("b")) & (F.col("lb") == F.col("b"))))
        hung = seen.select("moved", F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col("l").alias("b")) for x in ("a", "b", "la", "lb")])).alias("e"))
        now = cut(hung.select("moved", "e.*").filter("a <> b").groupBy("a", "b").agg(F.max("moved").alias("moved")))
        done = now.filter("moved").isEmpty()
        edges = now.select("a", "b")
        if done:
            break
    else:
        raise RuntimeError(f"components still move after {max_rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
