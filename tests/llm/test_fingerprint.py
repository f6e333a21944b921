"""Against hashes made in Python; merging; rows that follow each other."""

import hashlib
import random
import re
import struct

import pytest
import xxhash

from quarry.llm import fingerprint as fp
from quarry.llm.queries import op3_scaled_sketch


def brute(text, words=5, one_in=8):
    """The sketch by a plain loop: Spark's xxhash64 starts from 42 and goes on from what
    came before."""
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[ \t-\r]+", text.lower()) if w]
    every = set()
    for i in range(max(1, len(hashes) - words + 1) if hashes else 0):
        seed = 42
        for h in hashes[i : i + words]:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", h), seed)
        every.add(seed >> 16)
    return sorted(h for h in every if h < (1 << 48) // one_in) or sorted(every)[:1]


def alike(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


@pytest.mark.parametrize("shift", [1, 2, 3, 11])
def test_next_rows(spark, shift):
    rows = [(i * i * 7919 % 100003 - 500, f"t{i}", "c") for i in range(300)] + [(None, "z", "c")]
    df = spark.createDataFrame(rows, "id long, text string, place string")
    got = [tuple(r) for r in fp.with_next(df, ["text"], shift=shift).select("id", "text", "next_text").collect()]
    ids = sorted((i, t) for i, t, _ in rows if i is not None)
    assert sorted(g for g in got if g[0] is not None) == [(i, t, ids[(k + 1) % len(ids)][1]) for k, (i, t) in enumerate(ids)]
    assert [g for g in got if g[0] is None] == [(None, "z", None)]


def test_query(spark, sf_dir):
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: r for r in op3_scaled_sketch(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    prints = {}
    for k, (doc, text) in enumerate(texts):
        after, half, r = texts[(k + 1) % len(texts)][1], len(text) // 2, got[doc]
        edited = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        own, other = brute(text), brute(edited)
        assert (r.fingerprint, r.edited_fingerprint) == tuple("".join(f"{h:012x}" for h in x) for x in (own, other))
        assert abs(r.near_edited - alike(own, other)) < 1e-12 and abs(r.near_next - alike(own, brute(after))) < 1e-12
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.9 * len(got)


def test_estimates(spark):
    words = [f"w{i}" for i in range(6000)]
    whole, part = " ".join(words), " ".join(words[:600])
    df = spark.createDataFrame([(whole, part)], "a string, b string").select(fp.sketch("a").alias("a"), fp.sketch("b").alias("b"))
    r = df.select(fp.containment(df.b, df.a).alias("in_whole"), fp.likeness(df.a, df.b).alias("alike"), (fp.merge(df.a, df.b) == df.a).alias("merged")).first()
    assert r.in_whole == 1 and abs(r.alike - 596 / 5996) < 0.05 and r.merged


def test_merge_is_the_sketch_of_both(spark):
    rnd = random.Random(6)
    texts = ["", "one", "one two three four five six"] + [" ".join(str(rnd.randint(0, 10**6)) for _ in range(rnd.choice([3, 5, 6, 8, 12, 300]))) for _ in range(25)]
    rows = [(a, b) for a in texts for b in texts]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", fp.merge(fp.sketch("a"), fp.sketch("b")).alias("m")).collect()
    for r in got:
        every = {h for t in (r.a, r.b) for h in brute(t, one_in=1)}
        assert r.m == (sorted(h for h in every if h < (1 << 48) // 8) or sorted(every)[:1])


def test_clashing_columns_and_long_texts(spark):
    rows = [(i, f"word{i} " * (200_000 if i == 2 else 3), *[i] * 5) for i in range(4)]
    docs = spark.createDataFrame(rows, "id long, text string, _bucket int, _extra int, _at int, _before int, _place int")
    got = {r.id: r for r in fp.with_next(docs, ["text"]).collect()}
    assert all(r._bucket == r._extra == r._at == r._before == r._place == i and r.next_text.startswith(f"word{(i + 1) % 4} ") for i, r in got.items())
    long = fp.with_edited(fp.fingerprints(docs.withColumnRenamed("id", "doc_id"))).where("id = 2").first()
    assert long.sketch == brute("word2 " * 9) and long.n_chars == 1_200_000


@pytest.mark.parametrize("most", [2, 10, 100_000])
def test_ids_of_very_many_rows(spark, most):
    """Many rows of one id, equal ones too: set apart and as they are."""
    rnd = random.Random(7)
    rows = [(rnd.choice([1, 5, 5, 5, 9, 12]), rnd.choice(["a", "b", "c", "d", None, "a longer one"]), i) for i in range(120)] + [(3, "only", 200), (None, "none", 201), (40, "last", 202)]
    df = spark.createDataFrame(rows, "id long, text string, _value int").repartition(6)
    got = fp.with_next(df, ["text"], most_rows=most)
    assert got.columns == ["id", "text", "_value", "next_text"]
    key = lambda t: (t is not None, t or "")
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], key(r[1])))
    want = sorted((i, key(t), key(order[(k + 1) % len(order)][1])) for k, (i, t, _) in enumerate(order))
    assert sorted((r.id, key(r.text), key(r.next_text)) for r in got.where("id is not null").collect()) == want
    assert sorted(r._value for r in got.collect()) == sorted(r[2] for r in rows)
    assert [r.next_text for r in got.where("id is null").collect()] == [None]


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "one"), (5, "ONE"), (5, "one"), (None, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fp.with_edited(fp.fingerprints(docs)).collect()
    sizes = sorted((r.id or 0, len(r.sketch)) for r in got)
    assert sizes == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (5, 1)]
    assert len({tuple(r.sketch) for r in got if r.sketch}) == 1
    assert fp.with_edited(fp.fingerprints(docs.limit(0))).count() == 0
    assert fp.with_edited(fp.fingerprints(docs.where("doc_id = 4"))).first().near_next == 1
