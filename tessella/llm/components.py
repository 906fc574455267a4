"""Connected components as DataFrame joins: large-star and small-star rounds until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import shared_dir, stage


def _sum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def _lowest(links: DataFrame) -> DataFrame:
    """(u, v) with each u's lowest neighbour, itself included. Pre-aggregated; the join back splits hot nodes."""
    low = links.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return links.join(low, "u")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each node that has an edge, with the smallest node it can reach.

    Edges are undirected pairs in columns `a` and `b`; loops, repeats and nulls
    are fine (a null endpoint links nothing). Each round shrinks paths to stars,
    so the number of rounds grows with the logarithm of the longest path; every
    round is written to the shared folder.
    """
    shared_dir(edges.sparkSession)
    plain = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    nodes = plain.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    now = stage(plain.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    seen = _sum(now)
    while seen[0]:
        both = now.union(now.select("v", "u"))
        large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        # small star: u and all its smaller neighbours point at the smallest of them
        joined = _lowest(large)
        now = stage(
            joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v")).where("u <> v").distinct(), "edges"
        )
        if (then := _sum(now)) == seen:
            break
        seen = then
    label = now.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(label, nodes["node"] == label["u"], "left").select("node", F.coalesce("component", "node").alias("component"))
