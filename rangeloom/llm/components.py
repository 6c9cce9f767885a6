"""Connected components by repeated contraction, as joins and minima over edge tables.

Edges are first contracted task by task, each task over a bounded number of them: what is left joins every vertex to the
smallest of its local component. Then, in rounds, every vertex points at the neighbour (or itself) that comes first in
an order drawn anew from a hash, edges are relabelled by these pointers and those inside one label go. The random orders
make the number of rounds logarithmic also for long chains. The pointers of all rounds are composed backwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialise

#: Edges, and vertices held, in a task of the local contraction.
LOCAL = 100_000


def _stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    def found() -> pd.DataFrame:
        pairs = [(r, x) for x in list(parent) if (r := root(x)) != x]
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    for pdf in frames:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > LOCAL:
            yield found()
            parent.clear()
    yield found()


def _contracted(edges: DataFrame, rows: int) -> DataFrame:
    return materialise(edges.coalesce(1 + rows // LOCAL).mapInPandas(_stars, "a long, b long"), "edges")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id that has an edge to another in ``edges`` (a, b: long); component is the smallest id
    reachable. Self-links and repeated or reversed edges are allowed."""
    with Scratch(edges.sparkSession) as scratch:
        return scratch.result(_components(edges), "components")


def _components(edges: DataFrame) -> DataFrame:
    given = materialise(edges.where(F.col("a") != F.col("b")).select("a", "b"), "edges")
    rows = given.count()
    current = _contracted(given, rows)
    pointers: list[DataFrame] = []
    while rows and (rows := current.count()):
        tasks = 1 + rows // LOCAL
        order = lambda c, r=len(pointers): F.struct(F.xxhash64(c, F.lit(r)).alias("o"), F.col(c).alias("v"))
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(order("b")).alias("n")).select(F.col("a").alias("id"), F.least("n", order("a"))["v"].alias("to"))
        first = materialise(first.coalesce(tasks), "pointers")
        pointers.append(first)
        moved = (
            current.join(first.select(F.col("id").alias("a"), F.col("to").alias("x")), "a")
            .join(first.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
            .where(F.col("x") != F.col("y"))
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
        )
        current = _contracted(moved, rows)
    if not pointers:
        return given.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    root = pointers.pop()
    while pointers:
        later = root.select(F.col("id").alias("to"), F.col("to").alias("end"))
        root = pointers.pop().join(later, "to", "left").select("id", F.coalesce("end", "to").alias("to"))
    root = materialise(root, "roots")
    return root.join(root.groupBy("to").agg(F.min("id").alias("component")), "to").select("id", "component")
