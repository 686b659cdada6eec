"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import written

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang each node's larger (small star: lower) neighbours on the least of its neighbourhood.

    The minimum is a partial aggregate and the way back a join, so a hub of any size is no single group.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = both.join(low, "u")
    if small:
        out = met.select(F.col("v").alias("a"), "m").unionByName(low.select(F.col("u").alias("a"), "m"))
    else:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), "m")
    return out.filter("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the least node of the component; nodes without a link are absent.

    links holds long node numbers; self links and repeated links change nothing. Rounds grow with
    the logarithm of the longest chain; each is written to the shared folder to cut lineage.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = written(pairs)
    state = _state(edges)
    for _ in range(MAX_ROUNDS if state[0] else 0):
        edges = written(_star(_star(edges, small=False), small=True))
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
