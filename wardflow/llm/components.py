"""Connected components of a graph given as an edge table.

Rounds of contraction: every node takes the smallest node among itself and its
neighbours, edges are renamed accordingly, and edges within one node vanish.
Node numbers should be hashes, so that long chains shrink by a constant factor
a round. Minima are aggregated before the shuffle and tables are written between
steps, so that a hub with very many edges is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.session import settle


def _parents(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return settle(both.groupBy("a").agg(F.min("b").alias("b"))
                  .select(F.col("a").alias("node"), F.least("a", "b").alias("parent")),
                  "parents")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of an edge (columns ``a``, ``b``: long).

    Nodes of one component share the root, one of them. Loops and repeated edges
    do no harm; nodes of loops only, and null ends, are left out.
    """
    edges = settle(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        parents = _parents(edges)
        if roots is None:
            roots = parents.withColumnRenamed("parent", "root")
        else:
            step = parents.withColumnsRenamed({"node": "root", "parent": "_next"})
            roots = settle(roots.join(step, "root", "left")
                           .select("node", F.coalesce("_next", "root").alias("root")), "roots")
        renamed = (edges.join(parents.withColumnsRenamed({"node": "a", "parent": "_a"}), "a")
                   .join(parents.withColumnsRenamed({"node": "b", "parent": "_b"}), "b")
                   .filter("_a <> _b")
                   .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))
        edges = settle(renamed.distinct(), "edges")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
