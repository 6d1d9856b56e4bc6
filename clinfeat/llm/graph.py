"""Connected components of a link table, without bringing any of it to the driver."""

from pyspark.sql import DataFrame, functions as F

from clinfeat.llm.shared import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has a link to another.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest one, then its
    smaller ones. Both are a min per node and a join, so a node with very many links is split like any skewed key;
    the rounds grow with the logarithm of the longest chain. Null ends and links to itself count for nothing.
    """
    edges = cut(
        links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") < F.col("v"))).distinct()
    )
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        )
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(lowest, "u").select(F.col("m").alias("x"), F.explode(F.array("u", "v")).alias("y"))
            .where("x < y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct()
        )
        after = cut(small)
        sides = edges.withColumn("side", F.lit(1)).union(after.withColumn("side", F.lit(-1)))
        same = sides.groupBy("u", "v").agg(F.sum("side").alias("d")).where("d <> 0").limit(1).count() == 0
        edges = after
        if same:
            return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).union(
                edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
            )
