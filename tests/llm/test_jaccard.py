"""Components against all pairs, with and without cells that are full."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.jaccard import Bands, SignatureTree, jaccard_components, keys_of, shingle_set


def all_pairs(rows, size, similarity):
    sets = {i: frozenset(shingle_set(t, size).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed):
    rnd, rows = random.Random(seed), []
    for _ in range(20):
        base = [rnd.choice("abcdefghij") + str(rnd.randint(0, 30)) for _ in range(rnd.choice([3, 8, 20, 40, 60, 100]))]
        for _ in range(rnd.choice([1, 2, 5, 30])):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
                words[rnd.randrange(len(words))] = str(rnd.random())[:5]
            if rnd.random() < 0.3:
                words = words[: int(len(words) * rnd.uniform(0.8, 1))]
            rows.append((len(rows) * 3, rnd.choice([" ", "\n"]).join(words)))
    return [*rows, (9001, None), (9002, ""), (9003, " \t"), (9004, "one"), (9005, "ONE"), (9006, "one two"), (9007, "One\x0btwo")]


@pytest.mark.parametrize("size,similarity,limits", [(3, 90, {}), (5, 80, {}), (3, 90, {"cell_rows": 8, "pivots": 1}), (3, 90, {"cell_shingles": 300, "pivots": 2})])
def test_all_links_are_found(spark, size, similarity, limits):
    rows = near_copies(size + len(limits))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(docs, size, similarity, **limits).collect()}
    assert got == all_pairs(rows, size, similarity)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text, 1), (5, text, 2), (3, text, 3), (None, text, 4), (8, text + " more", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grp int")
    assert sorted((tuple(r) for r in jaccard_components(docs, 3, 90).collect()), key=repr) == sorted([(5, 38, 3), (5, 38, 3), (3, 38, 3), (None, 38, None), (8, 39, 3)], key=repr)
    assert jaccard_components(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard_components(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


@pytest.mark.parametrize("limits", [{}, {"cell_rows": 2, "pivots": 1}])
def test_several_texts_of_one_id(spark, limits):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(1, one), (5, one), (5, two), (9, two + " more"), (9, two + " more"), (20, three), (20, None), (20, " "), (12, three + " more"), (30, None), (40, "alone"), (40, three.upper())]
    rows += [(50 + i, two + f" more{i}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(i, len(shingle_set(t, 3)), 30 if i == 30 else 12 if i in (12, 20, 40) else 1) for i, t in rows]
    assert sorted(tuple(r) for r in jaccard_components(docs, 3, 90, **limits).collect()) == sorted(want)


def test_hot_keys_are_dealt_out(spark):
    """A key of many classes is kept without the window, and no other key with it."""
    from quarry.llm import jaccard

    made = {f"t{i}": ([7, 100 + i % 50] if i % 2 else [7, 1000 + i]) for i in range(400)}

    def keys(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield jaccard._key_batch([int(t[1:]) for t in texts], [1] * len(texts), [0] * len(texts), [np.array(made[t], np.uint64) for t in texts], range(0, 2 * len(texts) + 1, 2))

    rows = spark.createDataFrame([(i, i, f"t{i}") for i in range(400)], "id long, t long, text string")
    want = sorted((i, 1, 0, k) for i in range(400) for k in made[f"t{i}"] if k < 1000)
    for one_in, hot in ((1, 64), (2, 16), (1, 2), (1, 10**6)):
        assert sorted(map(tuple, jaccard._shared_keys(rows, keys, one_in, hot).collect())) == want


def test_large_unconnected_component(spark, monkeypatch):
    """Sets of very different sizes that are candidates of one another and mostly not linked: the
    component is dealt into blocks, and only pairs of blocks of near sizes are compared."""
    from quarry.llm import jaccard

    rnd, rows = random.Random(15), []
    for i in range(160):
        n = int(6 * 1.35 ** rnd.uniform(0, 12))
        words = [f"w{i}x{j}" for j in range(n)]
        rows.append((2 * i, " ".join(words)))
        if i % 3 == 0:  # a near copy, for the longer ones close enough to link
            words[rnd.randrange(n)] = "other"
            rows.append((2 * i + 1, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sums = df.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("t"), "text").mapInArrow(jaccard._summaries(3), "id long, t long, n long, h1 long, h2 long")
    calls, pairs, in_pairs = [], [], jaccard._in_block_pairs

    def all_candidates(edges, **how):
        """What the first call finds: that all classes are one candidate component."""
        calls.append(1)
        found = sums.select(F.col("h1").alias("node"), F.lit(0).cast("long").alias("label")).distinct()
        return found if len(calls) == 1 else components(edges, **how)

    def noted(*args):
        out = in_pairs(*args)
        cells = {c for r in out.select("cells").collect() for c in r.cells}
        pairs.append((len(cells), len({b for c in cells for b in c.split("|")})))
        return out

    monkeypatch.setattr(jaccard, "components", all_candidates)
    monkeypatch.setattr(jaccard, "_in_block_pairs", noted)
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(df, 3, 90, cell_rows=12, pivots=4).collect()}
    assert got == all_pairs(rows, 3, 90)
    (compared, blocks), = pairs
    assert blocks > 25 and compared < 0.35 * blocks * (blocks + 1) / 2


def test_block_pairs_are_those_of_near_sizes(spark):
    from quarry.llm import jaccard

    rnd = random.Random(16)
    rows = [(str(i), "g", max(1, int(1.3 ** rnd.uniform(0, 30))), i % 5 == 0) for i in range(2000)]
    large = spark.createDataFrame(rows, "name string, grp string, n long, main boolean")
    got = {r.name: set(r.cells) for r in jaccard._in_block_pairs(large, 80, 100, 10**9).collect()}
    some = rnd.sample(rows, 300)
    for i, (a, _, n, main) in enumerate(some):
        for b, _, m, other in some[:i]:
            if 100 * min(n, m) >= 80 * max(n, m) and not (main and other):
                assert got[a] & got[b], (n, m)
    cells = set().union(*got.values())
    blocks = {b for c in cells for b in c.split("|")}
    assert len(cells) < 0.25 * len(blocks) * (len(blocks) + 1) / 2


def test_keys_meet_whenever_sets_link():
    rng, bands = np.random.default_rng(0), Bands(90)
    for n in (10, 19, 20, 57, 300, 1500):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**64, n, np.uint64))
            drop, more = rng.integers(0, max(1, n // 20) + 1, 2)
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**64, more, np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both < len(a) and 100 * both >= 90 * (len(a) + len(b) - both):
                # In a band of both, each shares as many keys as it must, and one at least.
                ok = []
                for top in set(bands.tops(len(a))) & set(bands.tops(len(b))):
                    (ka, na), (kb, nb) = keys_of(a, top, bands), keys_of(b, top, bands)
                    ok.append(len(set(ka) & set(kb)) >= max(1, na, nb))
                assert any(ok)


def test_tree_with_narrow_bitmaps(monkeypatch):
    from quarry.llm import jaccard

    monkeypatch.setattr(jaccard, "TREE_BITS", 64 * 60)
    rows = [r for r in near_copies(7) if len(shingle_set(r[1], 3))][:60]
    tree = SignatureTree([shingle_set(t, 3) for _, t in rows], 90)
    assert not tree.exact
    want = all_pairs([(i, t) for i, (_, t) in enumerate(rows)], 3, 90)
    assert tree.connect() == [want[i][1] for i in range(len(rows))]


@pytest.mark.parametrize("hashed", [False, True])
def test_components(spark, hashed):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(rnd.randint(200, 400), rnd.randint(200, 400)) for _ in range(120)] + [(None, 3), (7, 7), (1, 2)]
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want, seen = {}, set()
    for start in sorted(near):
        todo = [start] if start not in seen else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                want[x] = start
                todo += near[x]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.label for r in components(df, hashed=hashed).collect()} == want
    assert components(df.limit(0), hashed=hashed).count() == 0


def test_tree_takes_little_beside_its_bitmaps():
    """A cell of the largest size, as many sets as a cell has shingles for: while its tree is
    built, little more than the bitmaps (32 MB), the shingles and their sorted copy is held."""
    import tracemalloc

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 250, np.uint64)
    sets = [np.unique(np.concatenate([base[:240], rng.integers(0, 2**64, 10, np.uint64)])) for _ in range(4000)]
    tracemalloc.start()
    tree = SignatureTree(sets, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tree.exact and [int(x) for x in tree.low[0][:3]] == [250] * 3
    assert peak < 64 << 20


def test_key_rows_are_narrow(spark):
    """What a task sorts to find shared keys has three columns where no key is hot."""
    from quarry.llm import jaccard

    texts = [(i, i, " ".join(f"w{i}x{j // 2}" for j in range(40))) for i in range(20)]
    shared = jaccard._shared_keys(spark.createDataFrame(texts, "id long, t long, text string"), jaccard._keys(5, 80))
    plan = shared._jdf.queryExecution().optimizedPlan()
    while "Window" != plan.nodeName():
        plan = plan.children().apply(0)
    assert plan.children().apply(0).output().size() == 3
