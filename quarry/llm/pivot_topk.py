"""Exact top-k by inner product with pivot-table elimination (operator 1).

Vectors are whole numbers. Their distances to many pivots are computed once. By the
triangle inequality the greatest difference of two vectors' distances to a pivot is a
lower bound of their own distance, and so an upper bound of their inner product:
(|q|^2 + |v|^2 - d^2) / 2. A query takes its candidates in the order of that bound and
stops, exactly, when no bound left reaches its k-th score.

Candidates are dealt by their nearest pivot into cells of bounded size, of which the least
and greatest distance to every pivot and the greatest norm are kept. A query first takes the
best k of its own cell. The k-th score of these and the same inequality, for the range of
a cell's distances, then tell which other cells may hold better ones; only those cells' rows
are sent to it. Queries go in blocks of neighbouring cells, and a cell is sent once to each
block that has a query for it. All best k then meet in a last ranking, k rows per cell.

How many are skipped depends on the vectors: of clustered ones most, of directions without
clusters in many dimensions few, since all of them are about equally far apart. work() counts
them.

Edge cases: vectors that are null or hold null or non-finite components take no part.
Only vectors of one length are compared. A query's own id is never a candidate, however
often it occurs; other repeated rows count each. Ties go to the smaller id. A query
without candidates gives no rows. Null ids take no part. Scores are exact; components and
scores that do not fit into a long are held at its ends. Other columns are ignored,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, null where the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * scale)))


LONG = (1 << 63) - 1


class Cell:
    """Candidates of one length with their distances to the pivots."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, pivots: np.ndarray):
        self.ids, self.whole, self.v = ids, v, v.astype(np.float64)
        self.pivots = pivots.astype(np.float64)
        self.norm, self.high = (self.v * self.v).sum(axis=1), np.abs(self.v).max()
        self.far = np.array([np.sqrt(((self.v - p) ** 2).sum(axis=1)) for p in self.pivots], np.float32)
        self.evaluated = 0

    def _bounds(self, x: np.ndarray) -> np.ndarray:
        """What no inner product with x exceeds, rounding allowed for."""
        own = np.sqrt(((self.pivots - x) ** 2).sum(axis=1)).astype(np.float32)
        apart = self.far - own[:, None]
        apart = np.abs(apart, out=apart).max(axis=0) - np.float32(4e-7) * max(self.far.max(), own.max())
        apart, norm = np.maximum(apart, 0).astype(np.float64), self.norm + x @ x
        return (norm - apart * apart) / 2 + 1e-9 * norm

    def _scores(self, at: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whole numbers: as doubles while sums are below 2^53, else by Python's integers."""
        self.evaluated += len(at)
        if np.abs(x).max() * self.high * len(x) < 1 << 53:
            # A large share is not gathered first.
            return ((self.v @ x)[at] if 8 * len(at) > len(self.v) else self.v[at] @ x).astype(np.int64)
        return np.array([max(-LONG - 1, min(LONG, sum(int(a) * int(b) for a, b in zip(self.whole[i], q)))) for i in at], np.int64)

    def best(self, query: int, q: np.ndarray, k: int, least: float = -np.inf) -> list[tuple[int, int]]:
        """The k best of one query of a score of `least` or more, as (score, id). Candidates go
        by their bound; none is left out whose bound reaches that or the k-th score."""
        x = q.astype(np.float64)
        bound = self._bounds(x)
        left = np.flatnonzero((self.ids != query) & (bound >= least))
        score, ids = np.empty(0, np.int64), np.empty(0, np.int64)
        step = 4 * k
        while len(left):
            part, left = left, left[:0]
            if len(part) > step:
                order = np.argpartition(-bound[part], step)
                part, left = part[order[:step]], part[order[step:]]
            score, ids = np.concatenate([score, self._scores(part, q, x)]), np.concatenate([ids, self.ids[part]])
            if len(score) > k:
                some = score >= np.partition(score, len(score) - k)[len(score) - k]
                score, ids = score[some], ids[some]
                order = np.lexsort((ids, ~score))[:k]  # ~ turns the order of all longs round
                score, ids = score[order], ids[order]
            if len(score) == k:
                left = left[bound[left] >= score[-1]]
            step = step * 4 if 8 * len(left) < len(self.ids) else len(left)
        order = np.lexsort((ids, ~score))
        return list(zip(score[order].tolist(), ids[order].tolist()))


class Ranges(NamedTuple):
    """Of cells: the least and greatest distances to the pivots (cells x pivots) and greatest
    squared norms."""

    low: np.ndarray
    high: np.ndarray
    norm: np.ndarray

    def may_reach(self, own: np.ndarray, norm: float, least: float) -> np.ndarray:
        """Which cells may hold a score of `least` or more for a query with these distances to
        the pivots and this squared norm; rounding allowed for."""
        gap = np.maximum(self.low - own, own - self.high).max(axis=1) - 4e-7 * np.maximum(self.high.max(axis=1), own.max())
        gap, norm = np.maximum(gap, 0), self.norm + norm
        return (norm - gap * gap) / 2 + 1e-9 * norm >= least


_FOUND = "kind int, dim int, cell int, part int, query_id long, vec_id long, score long, v array<long>, low array<double>, high array<double>, norm double, n long"
#: Kinds of rows: what a cell is, how far a query has come in its own cell, one of its best, how many were evaluated.
CELL, QUERY, BEST, COUNT = 0, 1, 2, 3


_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def _table(out: list[dict], ddl: str) -> pa.Table:
    return pa.Table.from_pylist(out, pa.schema([(name, _KINDS[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))]))


def _vectors(table: pa.Table, column: str, size: int) -> np.ndarray:
    return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _own_cell(k: int, pivots: dict[int, np.ndarray]):
    """A cell's ranges, and the best k of its own queries."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim, number, part = (x.as_py() for x in key)
        place = {"dim": dim, "cell": number, "part": part}
        cell = Cell(table.column("id").to_numpy(), _vectors(table, "v", dim), pivots[dim])
        far = cell.far.astype(np.float64)
        out = [place | {"kind": CELL, "low": far.min(axis=1), "high": far.max(axis=1), "norm": float(cell.norm.max()), "n": len(cell.ids)}]
        for i in np.flatnonzero(table.column("is_query").to_numpy(zero_copy_only=False)):
            query, q = int(cell.ids[i]), cell.whole[i]
            best = cell.best(query, q, k)
            out.append(place | {"kind": QUERY, "query_id": query, "v": q, "score": best[-1][0] if len(best) == k else None})
            out += [place | {"kind": BEST, "query_id": query, "vec_id": v, "score": s} for s, v in best]
        out.append(place | {"kind": COUNT, "n": cell.evaluated})
        return _table(out, _FOUND)

    return run


_NEEDED = "dim int, block int, cell int, part int, query_id long, v array<long>, score long"


def _needed(pivots: dict[int, np.ndarray]):
    """Which cells of a chunk each query of a block needs, besides its own."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim, block = key[0].as_py(), key[1].as_py()
        asks, cells = (table.filter(pc.equal(table.column("kind"), kind)) for kind in (QUERY, CELL))
        out = []
        if len(asks) and len(cells):
            far = pivots[dim].astype(np.float64)
            ranges = Ranges(_vectors(cells, "low", len(far)), _vectors(cells, "high", len(far)), cells.column("norm").to_numpy())
            places = list(zip(cells.column("cell").to_pylist(), cells.column("part").to_pylist()))
            v = _vectors(asks, "v", dim)
            for i, (query, score, *own_place) in enumerate(zip(*(asks.column(c).to_pylist() for c in ("query_id", "score", "cell", "part")))):
                x = v[i].astype(np.float64)
                own = np.sqrt(((far - x) ** 2).sum(axis=1))
                for j in np.flatnonzero(ranges.may_reach(own, x @ x, -np.inf if score is None else score)):
                    if places[j] != tuple(own_place):
                        out.append({"dim": dim, "block": block, "cell": places[j][0], "part": places[j][1], "query_id": query, "v": v[i], "score": score})
        return _table(out, _NEEDED)

    return run


def _other_cell(k: int, pivots: dict[int, np.ndarray]):
    """The best k of a cell for queries of other cells."""

    def run(key: tuple, asks: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if len(asks) and len(rows):
            dim = key[0].as_py()
            cell = Cell(rows.column("id").to_numpy(), _vectors(rows, "v", dim), pivots[dim])
            for query, q, score in zip(asks.column("query_id").to_pylist(), _vectors(asks, "v", dim), asks.column("score").to_pylist()):
                out += [{"kind": BEST, "query_id": query, "vec_id": v, "score": s} for s, v in cell.best(query, q, k, -np.inf if score is None else score)]
            out.append({"kind": COUNT, "dim": dim, "n": cell.evaluated})
        return _table(out, _FOUND)

    return run


def _nearest(pivots: dict[int, np.ndarray]):
    """Rows with the place of their nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, v = batch.column("dim").to_numpy(), batch.column("v")
            cell = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                table, x = pivots[int(dim)].astype(np.float64), v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                # The nearest has the least |p|^2 - 2 x p.
                cell[at] = ((table * table).sum(axis=1) - 2 * (x @ table.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return run


#: Cells whose ranges a query meets at once.
CHUNK = 500


def _search(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, scale: int, number_pivots: int, query_block: int, row_block: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Rows of kind BEST and COUNT; which cells were sent to which blocks of queries; and what
    was found in the queries' own cells. None without queries."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), whole_numbers(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where("id is not null and v is not null and size(v) > 0")
    v = materialize(v.withColumn("dim", F.size("v")), "topk-vectors")
    counts = {r["dim"]: r for r in v.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("q")).where("q > 0").collect()}
    if not counts:
        return None
    v = v.where(F.col("dim").isin(list(counts)))
    # Pivots: a bounded number of distinct vectors of each length, the first by a hash,
    # found in a share of the rows that a hash picks.
    share = F.create_map(*[F.lit(x) for d, r in counts.items() for x in (d, max(1, r["n"] // (number_pivots * 64)))])[F.col("dim")]
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("v"), "v"))
    some = v.where(F.pmod(F.xxhash64("v", F.lit(1)), share) == 0).select("dim", "v").distinct().withColumn("r", rank)
    pivots: dict[int, list] = {}
    for r in some.where(F.col("r") <= number_pivots).select("dim", "v").collect():
        pivots.setdefault(r["dim"], []).append(list(r["v"]))
    table = {d: np.array(pivots.get(d, [[0] * d]), np.int64) for d in counts}

    v = materialize(v.select("id", "v", "is_query", "dim").mapInArrow(_nearest(table), "id long, v array<long>, is_query boolean, dim int, cell int"), "topk-cells")
    # A row for each pivot of each length: how many parts its cell has, and where its queries stand among all.
    sizes = v.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("q"))
    before = F.coalesce(F.sum("q").over(Window.partitionBy("dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    layout = materialize(sizes.select("dim", "cell", F.ceil(F.col("n") / row_block).cast("int").alias("parts"), "q", before.alias("before")), "topk-layout")
    parted = v.join(F.broadcast(layout.select("dim", "cell", "parts")), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int")).drop("parts")
    parted = materialize(parted, "topk-parts")
    found = materialize(parted.groupBy("dim", "cell", "part").applyInArrow(_own_cell(k, table), _FOUND), "topk-own")

    chunks = found.where(F.col("kind") == CELL).groupBy("dim").count().select("dim", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    chunks = F.broadcast(materialize(chunks, "topk-chunks"))
    place = F.col("before") + F.pmod(F.xxhash64("query_id", "v"), F.greatest("q", F.lit(1)))
    asks = found.where(F.col("kind") == QUERY).join(F.broadcast(layout), ["dim", "cell"]).withColumn("block", F.floor(place / query_block).cast("int"))
    grid = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    blocks = F.broadcast(layout.groupBy("dim").agg((F.floor((F.sum("q") - 1) / query_block) + 1).cast("int").alias("blocks")))
    asks = asks.join(chunks, "dim").select("dim", "block", grid(F.col("chunks")).alias("chunk"), "kind", "cell", "part", "query_id", "v", "score")
    cells = found.where(F.col("kind") == CELL).join(chunks, "dim").join(blocks, "dim")
    cells = cells.select("dim", grid(F.col("blocks")).alias("block"), F.pmod(F.xxhash64("cell", "part"), F.col("chunks")).cast("int").alias("chunk"), "kind", "cell", "part", "low", "high", "norm")
    pairs = asks.unionByName(cells, allowMissingColumns=True).groupBy("dim", "block", "chunk").applyInArrow(_needed(table), _NEEDED)
    pairs = materialize(pairs, "topk-needed")
    sent = materialize(pairs.select("dim", "cell", "part", "block").distinct(), "topk-sent")
    rows = parted.join(sent, ["dim", "cell", "part"]).select("dim", "cell", "part", "block", "id", "v")
    keys = ["dim", "cell", "part", "block"]
    others = pairs.select(*[F.col(c).alias(f"of_{c}") for c in keys], "query_id", "v", "score").groupBy(*[f"of_{c}" for c in keys]).cogroup(rows.groupBy(*keys)).applyInArrow(_other_cell(k, table), _FOUND)
    every = found.where(F.col("kind").isin(BEST, COUNT)).unionByName(materialize(others, "topk-others")).select("kind", "query_id", "vec_id", "score", "n")
    return every, sent, found


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, number_pivots: int = 64, query_block: int = 8192, row_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest inner products of each query."""
    done = _search(vectors, is_query, k, id_col, vector_col, scale, number_pivots, query_block, row_block)
    if done is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = done[0].where(F.col("kind") == BEST).withColumn("rank", place)
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def work(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, number_pivots: int = 64, query_block: int = 8192, row_block: int = 4096) -> dict[str, int]:
    """What top_k() with these parameters does: inner products evaluated, of how many pairs of
    a query and a row of its length; and cells sent to blocks of queries, of how many pairs."""
    done = _search(vectors, is_query, k, id_col, vector_col, scale, number_pivots, query_block, row_block)
    if done is None:
        return {"evaluated": 0, "pairs": 0, "sent": 0, "cells": 0}
    every, sent, found = done
    by = found.groupBy("dim").agg(F.sum(F.when(F.col("kind") == CELL, F.col("n"))).alias("n"), F.count_if(F.col("kind") == QUERY).alias("q"), F.count_if(F.col("kind") == CELL).alias("cells"))
    totals = by.agg(F.sum(F.col("n") * F.col("q")).alias("pairs"), F.sum(F.col("cells") * F.ceil(F.col("q") / query_block)).alias("cells")).first()
    return {"evaluated": every.where(F.col("kind") == COUNT).agg(F.sum("n")).first()[0], "pairs": totals["pairs"], "sent": sent.count(), "cells": totals["cells"]}
