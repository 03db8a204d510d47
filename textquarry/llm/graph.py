"""Connected components as a loop of DataFrame contractions.

Each round gives every node a random rank, lets it follow its lowest-ranked
neighbour (or itself), and contracts the edges onto those leaders. The edge list
shrinks by a constant factor on average whatever the shape (chains too), so the
number of rounds grows with the logarithm of the graph. A hub's edges meet only
in aggregates with map-side combine and in joins that AQE can split.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.storage import materialise


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of type long).

    Self-loops, repeated edges and either orientation are fine; an empty edge list
    gives an empty result. ``root`` is some node of the component, the same for all of
    its nodes. Nulls in a or b are ignored.
    """
    live = materialise(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    steps: list[DataFrame] = []
    for n in range(max_rounds):
        if live.isEmpty():
            break
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(n)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        lead = materialise(
            both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["v"].alias("root")),
            "leaders",
        )
        steps.append(lead)
        ends = [lead.select(F.col("node").alias(c), F.col("root").alias("r" + c)) for c in "ab"]
        live = materialise(
            live.join(ends[0], "a").join(ends[1], "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
    else:
        raise RuntimeError("components did not converge")
    if not steps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def onward(found: DataFrame, later: DataFrame) -> DataFrame:
        nxt = later.select(F.col("node").alias("root"), F.col("root").alias("further"))
        return found.join(nxt, "root", "left").select("node", F.coalesce("further", "root").alias("root"))

    return reduce(onward, steps)
