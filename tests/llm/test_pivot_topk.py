import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm.pivot_topk import LONG, Cell, top_k, work


def brute(rows, is_query, k):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if is_query(q):
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(b) == len(a))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [{}, {"query_block": 3, "row_block": 20}, {"number_pivots": 2}])
def test_like_brute_force(spark, blocks):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(8)]) for i in range(-30, 150)]
    rows += [(1000 + i, rows[7][1]) for i in range(12)]  # ties
    rows += [(2000, None), (2050, [0.1] * 7 + [None]), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (None, [0.1] * 8), (3000, [0.5] * 3), (3001, [0.25] * 3), (4000, [0.5] * 2), (5000, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, **blocks).collect())
    assert got == brute(rows, lambda i: i % 50 == 0, 5)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.5, 0.5]), (7, [1.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k(df.where("embedding[0] = 1.0"), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 7, 65536), (0, 2, 7, 65536)]
    assert top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert top_k(df, F.lit(None).cast("boolean")).count() == 0


def test_clusters_are_skipped():
    """Of clustered vectors a small share is evaluated, and the result is that of all."""
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 200, (40, 16))
    v = np.floor(middles[rng.integers(0, 40, 4000)] + rng.normal(0, 4, (4000, 16))).astype(np.int64)
    ids, k = np.arange(4000), 5
    cell = Cell(ids, v, np.unique(v, axis=0)[rng.permutation(3000)[:64]])
    for query in range(0, 4000, 100):
        scores = v @ v[query]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != query)[:k]
        assert [(-s, i) for s, i in cell.best(query, v[query], k)] == want
    assert cell.evaluated < 0.25 * 40 * 4000


def test_cells_are_skipped_before_they_are_sent(spark):
    """Clustered vectors through top_k(): less than half of the candidates is evaluated and of the
    cells sent; and of directions without clusters all are that must be."""
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 1, (30, 16))
    clustered = middles[rng.integers(0, 30, 3000)] + rng.normal(0, 0.02, (3000, 16))
    scattered = rng.normal(0, 1, (1000, 16))
    scattered /= np.linalg.norm(scattered, axis=1, keepdims=True)
    for v, share in ((clustered, 0.5), (scattered, 1.0)):
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        sizes = {"query_block": 10, "row_block": 200}
        got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, **sizes).collect())
        assert got == brute([(i, x.tolist()) for i, x in enumerate(v)], lambda i: i % 50 == 0, 5)
        done = work(df, F.col("vec_id") % 50 == 0, **sizes)
        print(done)
        assert done["pairs"] == len(v) * len(range(0, len(v), 50))
        assert done["evaluated"] <= share * done["pairs"] and done["sent"] <= share * done["cells"]


@pytest.mark.parametrize("big", [3e9, 1e15, 1e30])
def test_large_components(spark, big):
    rows = [(0, [big, 1.0]), (1, [big / 2, 3.0]), (2, [7.0, -2.0]), (3, [-big, 5.0]), (4, [big / 2, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = lambda x: max(-LONG - 1, min(LONG, int(np.floor(x * 256))))
    v = {i: [whole(x) for x in e] for i, e in rows}
    want = sorted((-max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(v[0], v[i])))), i) for i in (1, 2, 3, 4))
    for k in (1, 4):
        got = [(-r.score, r.vec_id) for r in top_k(df, F.col("vec_id") == 0, k=k).orderBy("rank").collect()]
        assert got == want[:k]


def test_copies_do_not_take_all_pivots(spark, monkeypatch):
    from quarry.llm import pivot_topk

    seen = {}

    def noted(k, pivots, compare=pivot_topk._own_cell):
        seen.update(pivots)
        return compare(k, pivots)

    monkeypatch.setattr(pivot_topk, "_own_cell", noted)
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(0.5), F.lit(0.5))).when(F.col("id") < 2990, F.array(F.rand(1), F.rand(2))).otherwise(F.array(F.rand(1), F.rand(2), F.lit(0.1))).alias("embedding"))
    top_k(df, F.col("vec_id").isin(0, 2995), number_pivots=8).collect()
    assert sorted(seen) == [2, 3] and len(seen[2]) == len({tuple(x) for x in seen[2].tolist()}) == 8 and len(seen[3]) > 3 and (seen[3] != 0).any()
