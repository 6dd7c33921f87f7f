"""Connected components of a link table, by alternating large and small stars.

No task and no driver ever holds a component: each round is two joins and two
pre-aggregated minima over the links, written to the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (large) or smaller and own (small) neighbours on its smallest one."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    # in ``links`` a > b, so for the small star each node's neighbours b are the smaller ones
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = both.join(least.hint("merge"), "a")  # never gathered in the driver to be broadcast
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a > b").distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, root): root is the smallest node that can be reached.

    Only nodes that have a link appear.  Direction, repeats and loops of links do
    not matter; null ends are ignored.  Stops when a round changes nothing.
    """
    clean = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(clean)
    print_of = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    seen = now.agg(*print_of).first()
    for _ in range(max_rounds if seen[0] else 0):
        after = written(_star(_star(now, True), False))
        drop_written(now)
        now, mark = after, after.agg(*print_of).first()
        if mark == seen:
            break
        seen = mark
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
