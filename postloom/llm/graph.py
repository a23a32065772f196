"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.session import materialize


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of an edge, ``root`` being the smallest node that it reaches.

    ``edges`` has columns ``a`` and ``b`` of one orderable type; loops, repeated and reversed edges do no harm. In each
    round every node hands its larger and then its smaller neighbours on to the smallest of them, until
    all edges are stars; a chain of n nodes takes about log n rounds. Neighbours are only reduced to
    their minimum, never gathered, so a node may have any number of them.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = materialize(edges, "edges")
    before = _fingerprint(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = both.join(smallest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        smallest = larger.groupBy("a").agg(F.min("b").alias("m"))
        handed = larger.join(smallest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(handed.unionAll(smallest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
