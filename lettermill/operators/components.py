"""Connected components of an edge table: contraction on the cluster, the small rest in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stage import stage

#: Edges that one task finishes; more are contracted first.
LOCAL_EDGES = 200_000


def _union(name_type: pa.DataType):
    """Union-find over the edges of one partition: (node, component), the component being the least node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        for at in range(0, len(nodes), 10_000):
            part = nodes[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, name_type), pa.array([root(x) for x in part], name_type)], ["node", "component"])

    return run


def _order(node: Column, turn: int) -> Column:
    """Another order of the nodes in each round, so that no chain of names is as many rounds long as it has links."""
    return F.struct(F.xxhash64(F.lit(turn), node).alias("hash"), node.alias("node"))


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); a component is named by its least node.

    In each round a node goes to the least of itself and its neighbours, in an order that changes with the round, and on to
    where that one goes; the edges between the images remain. As the order is a random one, the nodes fall
    to about half at least each time, whatever the graph looks like. Once ``local_edges`` edges or fewer are left, one task joins them.
    Loops, repeated edges and either direction are allowed, null ends are passed over; an empty table gives an empty one.
    """
    edges = stage(edges.select("u", "v").where("u is not null and v is not null").distinct(), "edges")
    kind = dict(edges.dtypes)["u"]
    steps: list[DataFrame] = []
    while edges.limit(local_edges + 1).count() > local_edges:
        turn = len(steps)
        either = edges.union(edges.select(F.col("v"), F.col("u")))
        low = either.groupBy("u").agg(F.min(_order(F.col("v"), turn)).alias("low"))
        images = stage(low.select(F.col("u").alias("node"), F.least("low", _order(F.col("u"), turn))["node"].alias("image")), "images")
        further = images.select(F.col("node").alias("image"), F.col("image").alias("further"))
        images = stage(images.join(further, "image").select("node", F.col("further").alias("image")), "images")
        steps.append(images)
        left, right = (images.select(F.col("node").alias(a), F.col("image").alias(b)) for a, b in (("u", "iu"), ("v", "iv")))
        edges = stage(edges.join(left, "u").join(right, "v").where("iu <> iv").select(F.least("iu", "iv").alias("u"), F.greatest("iu", "iv").alias("v")).distinct(), "edges")
    named = edges.coalesce(1).mapInArrow(_union(pa.int64() if kind == "bigint" else pa.string()), f"node {kind}, component {kind}")
    if not steps:
        return stage(named, "components")
    out = stage(named, "components")
    for images in reversed(steps):  # a node whose image has no edge left is in the image's component
        out = images.join(out.withColumnRenamed("node", "image"), "image", "left").select("node", F.coalesce("component", "image").alias("component"))
    least = (out := stage(out, "components")).groupBy("component").agg(F.min("node").alias("least"))
    return stage(out.join(least, "component").select("node", F.col("least").alias("component")), "components")
