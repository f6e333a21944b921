"""Connected components as Spark jobs: contraction towards least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", hashed: bool = False) -> DataFrame:
    """(node, label) for every node of an edge between two nodes; label is the least
    node of its component. Edges with a null end, repeated ones and loops do no harm.

    Each round sends every node to the least of itself and its neighbours, and the
    edges with them; those that become loops and repeats go, so a star is done in two
    rounds. Where nodes are in no order that the edges follow, the number of rounds
    grows as the logarithm of the size; hashed=True makes it so for nodes that are not
    hashes themselves. At the end the rounds are read back to front. Joins read written
    tables, which lets adaptive execution split a node with very many edges; minima and
    distinct edges combine before they are shuffled."""
    kind = edges.schema[a].dataType
    key = (lambda c: F.concat(F.lpad(F.hex(F.xxhash64(c)), 16, "0"), c.cast("string"))) if hashed else (lambda c: c)
    pairs = edges.select(key(F.col(a)).alias("a"), key(F.col(b)).alias("b")).where("a <> b")
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    now = materialize(pairs.select(F.inline(ways)).distinct(), "cc-edges")
    rounds: list[DataFrame] = []
    while not rounds or now.limit(1).count():
        to = materialize(now.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "cc-to")
        rounds.append(to)
        half = now.join(to, "a").select(F.col("to").alias("a"), F.col("b"))
        moved = half.join(to.select(F.col("a").alias("b"), F.col("to").alias("to_b")), "b").where("a <> to_b")
        now = materialize(moved.select("a", F.col("to_b").alias("b")).distinct(), "cc-edges")
    labels = rounds.pop()
    while rounds:
        later = labels.select(F.col("a").alias("to"), F.col("to").alias("last"))
        labels = materialize(rounds.pop().join(later, "to", "left").select("a", F.coalesce("last", "to").alias("to")), "cc-labels")
    if not hashed:
        return labels.select(F.col("a").alias("node"), F.col("to").alias("label"))
    named = labels.select(F.substring("a", 17, 1 << 30).cast(kind).alias("node"), "to")
    least = materialize(named.groupBy("to").agg(F.min("node").alias("label")), "cc-least")
    return named.join(least, "to").select("node", "label")
