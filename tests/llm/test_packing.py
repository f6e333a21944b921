"""Every id in exactly one piece, gapless sequences, and the curve itself."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quarry.llm.packing import hilbert_number, pack
from quarry.llm.queries import TOKENIZER, op10_hilbert_packing


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1).T
    numbers = hilbert_number(cells, bits)
    assert sorted(numbers) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(numbers)], axis=0)).sum(axis=1) == 1).all()


def check(pieces, docs, max_len):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for doc, rows in by_doc.items():
        at, got = 0, []
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(docs[doc]) and r.length > 0
            at += r.length
            got += np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert got == docs[doc]
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == max_len or at < max_len and at & (at - 1) == 0


def test_pieces(spark):
    lib = Tokenizer.from_file(TOKENIZER)
    texts = {i: " ".join(["word thing other more"[: 3 + i % 17]] * (i % 60)) for i in range(300)} | {1000: "long text here " * 3000, 1001: None, 1002: ""}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, number int")
    want = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    check(pack(docs, TOKENIZER, max_len=128).collect(), want, 128)
    check(pack(docs, TOKENIZER, number_partitions=1).collect(), want, 2048)
    assert pack(docs.limit(0), TOKENIZER).count() == 0


def test_repeats_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b")], "doc_id long, text string")
    rows = pack(docs, TOKENIZER).collect()
    assert sum(r.length for r in rows) == 9 and {r.doc_id for r in rows} == {None, 4}


def test_query_over_all_documents(spark, sf_dir):
    """Every piece of every document, no padding, and neighbours that are alike."""
    rows = op10_hilbert_packing(spark, sf_dir).collect()
    lib = Tokenizer.from_file(TOKENIZER)
    ids = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pieces, sequences = defaultdict(list), defaultdict(int)
    for r in rows:
        got = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(got.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id] += r.length
    assert set(pieces) == set(ids)
    for doc, found in pieces.items():
        assert sum(n for _, n in found) == len(ids[doc]) and [s for s, _ in sorted(found)] == np.cumsum([0, *[n for _, n in sorted(found)]])[:-1].tolist()
    assert all(n == 2048 or n & (n - 1) == 0 for n in sequences.values())
    full = sum(n == 2048 for n in sequences.values()) * 2048
    assert full > 0.8 * sum(sequences.values())

    def vector(doc):
        counts = np.bincount(np.array(ids[doc]) % 1024, minlength=1024).astype(float)
        return counts / np.sqrt(counts @ counts)

    walk = list(dict.fromkeys(r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))))
    vectors = {d: vector(d) for d in walk}
    alike = np.mean([vectors[a] @ vectors[b] for a, b in zip(walk, walk[1:])])
    mixed = np.random.default_rng(0).permutation(walk).tolist()
    assert alike > 1.2 * np.mean([vectors[a] @ vectors[b] for a, b in zip(mixed, mixed[1:])])


def test_workers_forget_words_once_tokens_are_written(spark):
    """Workers are used again by other stages, beside which a codec and its words would stay."""
    from quarry.llm import packing

    docs = spark.createDataFrame([(i, f"some words and number {i}") for i in range(40)], "doc_id long, text string").repartition(8)
    # As many tasks as partitions: each worker packs after it has tokenised.
    assert packing.pack(docs, TOKENIZER, number_partitions=40).count() >= 40

    def kept(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([len(packing._CODECS)], pa.int64())], ["n"])

    counts = [r.n for r in spark.range(0, 64, 1, 16).mapInArrow(kept, "n long").collect()]
    assert counts == [0] * 16
