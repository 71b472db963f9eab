"""Connected components of an edge table, distributed.

Large-star and small-star steps alternate until the edges are stars around the
smallest node of each component; that takes a logarithmic number of rounds.
Every round is two aggregations and two joins on the edges that are left, joined
by ``common.join_unique`` so that a node with very many neighbours is no hot
task, and is written to the shared folder.  Nothing is collected but two numbers
a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import common as C


def _star(edges: DataFrame, total: int) -> DataFrame:
    """For each ``u`` with its neighbours ``v``: the smallest of them and ``u``, as ``m``."""
    mins = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("degree"))
    return C.join_unique(edges, mins, ["u"], "degree", total, keep_unmatched=False)


def _large(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _star(down, total)
    return found.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node with an edge; the component is its smallest node."""
    now = C.materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")

    def mark(df: DataFrame) -> tuple[int, int]:
        row = df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        return row[0], row[1]

    seen = mark(now)
    while seen[0]:
        wide = C.materialize(_large(now, seen[0]), "large-star")
        now = C.materialize(_small(wide, wide.count()), "small-star")
        if (then := mark(now)) == seen:
            break
        seen = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
