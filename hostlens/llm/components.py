"""Connected components by contraction, on shuffles and written tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``v, c``: every vertex of edges ``a, b`` with the smallest vertex of its component.

    Each round sends a vertex to its smallest neighbour, and on to that one's; then the graph of what remains is
    built.  The smallest vertex of a component stays to the end.  Rounds follow the logarithm of the longest path.
    """
    rest = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not rest.isEmpty():
        both = rest.unionAll(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("c"))
        near = near.select("v", F.least("v", "c").alias("c"))
        onward = near.select(F.col("v").alias("c"), F.col("c").alias("root"))
        step = materialize(near.join(onward, "c").select("v", F.col("root").alias("c")), "components")
        maps.append(step)
        left = step.select(F.col("v").alias("a"), F.col("c").alias("ca"))
        right = step.select(F.col("v").alias("b"), F.col("c").alias("cb"))
        moved = rest.join(left, "a").join(right, "b").where("ca <> cb")
        rest = materialize(moved.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "edges")
    if not maps:
        return rest.select(F.col("a").alias("v"), F.col("b").alias("c"))
    found = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = found.select(F.col("v").alias("c"), F.col("c").alias("root"))
        found = earlier.join(later, "c", "left").select("v", F.coalesce("root", "c").alias("c"))
    return found
