"""Graph operators: connected components of an edge list, by alternating large and small stars.

Every round joins edges to the least neighbour of one end and keeps distinct results, so nothing is
gathered anywhere but the count and checksum that tell whether a round changed anything.  Joins run on
a disguised key on both sides: each side then gets an exchange of its own, which lets adaptive execution
split a hub's rows over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.storage import cut, importable

_MASK = 0x5DEECE66D
#: Edges that are few enough for one task to go through in order.
FEW = 100_000


def own_exchange(c: Column | str) -> Column:
    """An equivalent of a bigint join key that no earlier partitioning satisfies."""
    return (F.col(c) if isinstance(c, str) else c).bitwiseXOR(F.lit(_MASK))


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link the larger (large) or smaller neighbours of each node, and itself, to its least neighbour."""
    near = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(own_exchange("a").alias("k"), F.least("a", "m").alias("m"))
    met = near.withColumn("k", own_exchange("a")).join(least, "k")
    if large:
        made = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        made = met.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return made.filter("a > b").groupBy("a", "b").agg(F.lit(1).alias("_")).drop("_")


def _joined(pairs: DataFrame) -> DataFrame:
    """``components`` of a few edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
        found = [(n, r) for n in list(parent) if (r := root(n)) != n]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["node", "root"])

    importable(pairs.sparkSession)
    return pairs.select("a", "b").repartition(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = 0) -> DataFrame:
    """The least node of each node's component: ``node``, ``root``; nodes that are their own root are left out.

    ``edges`` holds bigint nodes; loops, repeats and either direction are allowed, null ends are ignored.  No more
    than ``few`` different edges are joined in one task, at once or when the rounds have left no more; the result is the same.
    """
    ends = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    pairs = cut(ends.filter(F.col("a") > F.col("b")).distinct())
    seen = None
    while True:
        count = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(count) == seen or not count[0]:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if count[0] <= few:
            return cut(_joined(pairs))
        seen = tuple(count)
        pairs = cut(_star(_star(pairs, True), False))


def component_counts(nodes: DataFrame, edges: DataFrame, group: str, node: str = "node", few: int = FEW) -> DataFrame:
    """How many components the nodes of each group form: ``group, n_components``.

    ``nodes`` has (group, node), ``edges`` (group, a, b) with ends among the group's nodes.  Nodes are numbered, so no
    two are ever taken for one.  Null groups count as one group.
    """
    named = cut(nodes.select(F.col(group).alias("_g"), F.col(node).alias("_n")).distinct().withColumn("k", F.monotonically_increasing_id()))
    met = edges.select(F.col(group).alias("_g"), F.col("a").alias("_a"), F.col("b").alias("_b")).filter("_a != _b")
    for end in ("a", "b"):
        side = named.select(F.col("_g").alias("_h"), F.col("_n").alias("_m"), F.col("k").alias(f"k{end}"))
        met = met.join(side, F.col("_g").eqNullSafe(F.col("_h")) & (F.col(f"_{end}") == F.col("_m"))).drop("_h", "_m")
    roots = components(met.select("ka", "kb"), "ka", "kb", few)
    # A node that some root stands above is no component of its own.
    below = named.join(roots, F.col("k") == F.col("node"), "left")
    return below.groupBy(F.col("_g").alias(group)).agg(F.count_if(F.col("root").isNull()).alias("n_components"))


def _in_order(edges: DataFrame, group: list[str]) -> DataFrame:
    """The members among a few edges, by going through them in order in one task: ``group, x``."""
    kinds = {c: edges.schema[c] for c in [*group, "b"]}
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    fields = StructType([*[kinds[c] for c in group], StructField("x", kinds["b"].dataType)])
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, out = set(), []
        for batch in batches:
            for *of, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a_, b_ = repr((of, a)), repr((of, b))
                if a_ not in members and b_ not in members:
                    members.add(b_)
                    out.append((*of, b))
        columns = list(zip(*out, strict=True)) if out else [[] for _ in arrow]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], names=arrow.names)

    importable(edges.sparkSession)
    # An end is decided once all edges that come to it from before are read: those of a are read before those from a.
    return edges.select(*group, "a", "b").repartition(1).sortWithinPartitions("b", "a").mapInArrow(run, fields)


def first_seeds(edges: DataFrame, group: list[str], few: int = FEW) -> DataFrame:
    """Greedy clusters in order: ``group, node, seed`` of every node that is no seed itself.

    In the order of the nodes each one that no earlier seed is linked to becomes a seed and takes all later ones linked
    to it; a node belongs to the first of its seeds.  ``edges`` has ends ``a`` and ``b`` of any type with an order; either
    direction and repeats are allowed, null ends and groups are ignored.

    In a round all nodes that no undecided earlier one is linked to become seeds at once, and those linked to them
    members; that gives what one pass in order gives, in as many rounds as the longest chain of nodes that wait for
    one another has.  When no more than ``few`` edges are left one task goes through them.
    """
    every = cut(edges.select(*group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).dropna(subset=group).filter("a < b").distinct())
    at = lambda df, end: df.withColumnRenamed("x", end)
    left, members = every, []
    while n := left.count():
        if n <= few:
            members.append(cut(_in_order(left, group)))
            break
        later = left.select(*group, F.col("b").alias("x")).distinct()
        seeds = left.select(*group, F.col("a").alias("x")).distinct().join(later, [*group, "x"], "left_anti")
        taken = cut(left.join(at(seeds, "a"), [*group, "a"], "left_semi").select(*group, F.col("b").alias("x")).distinct())
        members.append(taken)
        # All edges of a seed lead to what it has taken, so they go too.
        left = cut(left.join(at(taken, "b"), [*group, "b"], "left_anti").join(at(taken, "a"), [*group, "a"], "left_anti"))
    of_seeds = every
    for taken in members:
        of_seeds = of_seeds.join(at(taken, "a"), [*group, "a"], "left_anti")
    return of_seeds.groupBy(*group, F.col("b").alias("node")).agg(F.min("a").alias("seed"))
