"""Connected components of an edge table, by contraction.

Each round every vertex takes the smallest vertex it touches, pointers are followed twice, and the edges are drawn anew
between what is left; at least half of the touched vertices vanish in a round. Nothing is gathered on the driver but the
number of edges left. Minima are aggregated before they are shuffled, and every join has a plain table on its other
side, so the edges of one hot vertex can be split among tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, shared_dir, staged


def forest(a: list, b: list) -> tuple[list, list]:
    """A star for each component of a few edges: (vertex, smallest vertex)."""
    up: dict = {}

    def root(x):  # noqa: ANN001, ANN202  a long or bytes
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    tops = [(x, root(x)) for x in list(up)]
    return [x for x, r in tops if x != r], [r for x, r in tops if x != r]


def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = forest(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        kind = batch.schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b), longs or binary. Returns (v, label): each vertex that has an edge, with the smallest vertex of its component."""
    spark = edges.sparkSession
    bounded(spark)
    home = shared_dir(spark)
    labels, rounds = None, 0
    kind = edges.schema["a"].dataType.simpleString()
    e = staged(edges.where("a <> b").mapInArrow(thinned, f"a {kind}, b {kind}"), f"{home}/edges-0")
    while labels is None or e.count():
        least = e.select(F.col("a").alias("v"), F.col("b").alias("w")).union(e.select("b", "a")).groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("to"))
        least = staged(least, f"{home}/least-{rounds}")
        for step in range(2):
            far = least.select(F.col("v").alias("to"), F.col("to").alias("far"))
            least = staged(least.join(far, "to").select("v", F.col("far").alias("to")), f"{home}/least-{rounds}-{step}")
        if labels is None:
            labels = least.select("v", F.col("to").alias("label"))
        else:
            labels = staged(labels.join(least.select(F.col("v").alias("label"), "to"), "label", "left").select("v", F.coalesce("to", "label").alias("label")), f"{home}/labels-{rounds}")
        at = lambda c: least.select(F.col("v").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        e = staged(e.join(at("a"), "a").join(at("b"), "b").where("a_to <> b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct(), f"{home}/edges-{rounds + 1}")
        rounds += 1
    return labels
