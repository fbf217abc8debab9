"""Connected components of an edge table by alternating star steps."""

from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node that it reaches.

    Each round is one large-star and one small-star step, with rows in proportion to the edges; the tables are
    written to the shared folder between rounds. Self-loops keep their node in the result.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        # large star: every neighbour above a node goes to the smallest in its neighbourhood
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        # written, so that the join has an exchange on both sides and the rows of a hub can be split
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi > lo")
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct(F.col("hi").alias("x"), F.col("m").alias("y")), F.struct(F.col("lo").alias("x"), F.col("m").alias("y")))).alias("s"))
        e = written(small.select(F.col("s.x").alias("hi"), F.col("s.y").alias("lo")).where("hi > lo").distinct(), "edges")
        state = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return nodes.join(e.select(F.col("hi").alias("node"), F.col("lo").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
