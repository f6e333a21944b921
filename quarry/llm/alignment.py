"""Cross-tokenizer alignment by token-byte incidence (operator 11).

A text is tokenised twice, by a byte-level BPE (A, with a space before the text) and by a
sentencepiece model (B, which adds that space itself). The tokens of each are the rows of a
sparse matrix in CSR form whose columns are the text's bytes. Row by row (Gustavson), the
product of A's matrix with the transpose of B's has an entry for each pair of tokens that
share bytes, its value the number of them: the overlap links. Bytes at which tokens of both
end cut the text into groups; the product of the two token-group matrices has the pairs of
tokens of one group. It is counted from its row sizes, and multiplied out only where its
links are asked for.

How often a pair of ids is linked in the corpus is counted over shards: a task works on
texts of about SHARD_CHARS together and writes, besides a row for each text, the shard's
distinct pairs with their numbers. Pairs are summed over shards and joined back to these few
rows, not to every text, and each shard's texts meet their pairs in one group, whose size is
bounded by that of a shard. The highest count of each B id is broadcast: it has a row for
each id of the vocabulary at most.

Edge cases: texts that are null or empty, or whose joined A or B bytes differ from space and
text (B's model normalises some characters), have no tokens: zeros and an empty digest.
Strings of special tokens are plain text. Texts are taken whole; a product is worked out in
blocks of rows. Repeated rows give repeated results and count each time. Columns other than
the id and the text are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import byte_bpe
from quarry.llm.bpe import _byte_alphabet
from quarry.llm.common import materialize

SHARD_CHARS, GROUP_CHARS = 16_000_000, 1_000_000
#: Entries of a product that are worked on together.
BLOCK = 1 << 19
#: A pair of ids as one number: A's id times this, and B's.
SHIFT = 20


class Csr(NamedTuple):
    """The columns of row i's entries (all of value 1) are idx[ptr[i] : ptr[i + 1]]."""

    ptr: np.ndarray
    idx: np.ndarray
    width: int

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def of_bytes(ends: np.ndarray) -> Csr:
    """Tokens by bytes, from where each token ends."""
    size = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([[0], ends]), np.arange(size), size)


def of_groups(group: np.ndarray, groups: int) -> Csr:
    """Tokens by groups, from the group of each token."""
    return Csr(np.arange(len(group) + 1), group, groups)


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.idx, kind="stable")
    return Csr(np.concatenate([[0], np.cumsum(np.bincount(m.idx, minlength=m.width))]), m.row_of()[order], len(m.ptr) - 1)


def product_sizes(a: Csr, bt: Csr) -> np.ndarray:
    """For each row of a, the entries of bt that its entries meet."""
    return np.diff(np.concatenate([[0], np.cumsum(np.diff(bt.ptr)[a.idx])])[a.ptr])


def product(a: Csr, bt: Csr, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) of a times bt, by blocks of whole rows of a of about `block`
    terms. Each entry (i, k) of a contributes the row k of bt to row i; terms of one place
    are added up."""
    upto = np.cumsum(product_sizes(a, bt))
    row_of, first = a.row_of(), 0
    while first < len(upto):
        done = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + block, "right")))
        entries = slice(a.ptr[first], a.ptr[last])
        k = a.idx[entries]
        n = bt.ptr[k + 1] - bt.ptr[k]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row, column = np.repeat(row_of[entries], n), bt.idx[np.repeat(bt.ptr[k], n) + within]
        place = row * bt.width + column
        if len(place) and (np.diff(place) < 0).any():
            order = np.argsort(place, kind="stable")
            row, column, place = row[order], column[order], place[order]
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        yield row[starts], column[starts], np.diff(np.append(starts, len(place)))
        first = last


class Aligned(NamedTuple):
    """Texts side by side: token ids, where each text's tokens begin, where tokens end in
    bytes, and the group of each token."""

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    cuts: np.ndarray

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return product(of_bytes(self.ends_a), transposed(of_bytes(self.ends_b)))

    def group_matrices(self) -> tuple[Csr, Csr]:
        return of_groups(self.group_a, len(self.cuts)), transposed(of_groups(self.group_b, len(self.cuts)))


class Aligner:
    """Both tokenizers, from their files."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.codec_a, self.b = byte_bpe.Codec(_ranks(path_a)), SentencePieceProcessor(model_file=path_b)
        size = self.b.get_piece_size()
        pieces = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(size)))]
        self.bytes_a, self.bytes_b = pa.array(self.codec_a.tokens, pa.binary()), pa.array(pieces, pa.binary())
        ids = [*range(len(self.bytes_a)), *range(size)]
        ends = "|" * len(self.bytes_a) + ";" * size
        self.written = pa.array([f"{i}{c}" for i, end in zip(ids, ends) for c in ("," + end)])

    def align(self, texts: list[str | None]) -> Aligned:
        a, b, empty = [], [], np.zeros(0, np.int64)
        for text in texts:
            ids_a, ids_b = empty, empty
            if text:
                ids_a, ids_b = self.codec_a.encode(" " + text), np.asarray(self.b.encode_as_numpy(text))
                want = (" " + text).encode()
                if any(byte_bpe.joined(table, ids)[0] != want for table, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))):
                    ids_a, ids_b = empty, empty
            a.append(ids_a.astype(np.int64))
            b.append(ids_b.astype(np.int64))
        first_a, first_b = (np.concatenate([[0], np.cumsum([len(x) for x in side])]).astype(np.int64) for side in (a, b))
        a, b = (np.concatenate([empty, *side]) for side in (a, b))
        ends_a, ends_b = (byte_bpe.joined(table, ids)[1][1:].astype(np.int64) for table, ids in ((self.bytes_a, a), (self.bytes_b, b)))
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        return Aligned(a, b, first_a, first_b, ends_a, ends_b, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), cuts)

    def digests(self, x: Aligned) -> list[str]:
        """Of each text's groups, written as `a1,a2|b1;a3|b2,b3`; empty without tokens."""
        code_a = 2 * x.a + (np.diff(x.group_a, append=-1) != 0)
        code_b = 2 * (len(self.bytes_a) + x.b) + (np.diff(x.group_b, append=-1) != 0)
        order = np.argsort(np.concatenate([2 * x.group_a, 2 * x.group_b + 1]), kind="stable")
        data, offsets = byte_bpe.joined(self.written, np.concatenate([code_a, code_b])[order])
        at = offsets[x.first_a + x.first_b].tolist()
        return [hashlib.sha256(data[i : j - 1]).hexdigest() if i < j else "" for i, j in zip(at, at[1:])]


def _ranks(path: str) -> dict[bytes, int]:
    """Ranks of a byte-level BPE file of the tokenizers library, whose merges make the ids in
    their order, so that an id is the rank of its token."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"]
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or made != sorted(set(made)):
        raise ValueError(f"{path} is no plain byte-level BPE whose ids follow its merges")
    of_symbol = {c: b for b, c in _byte_alphabet().items()}
    special = {x["id"] for x in spec["added_tokens"]}
    return {bytes(map(of_symbol.__getitem__, token)): i for token, i in model["vocab"].items() if i not in special}


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each pair of files in a worker."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _groups(ids: list, texts: list, chars: int = GROUP_CHARS) -> Iterator[tuple[list, list]]:
    """Runs of rows of about so many characters."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield ids[first : i + 1], texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield ids[first:], texts[first:]


class _Shard:
    """Rows of texts, and the links between ids in each."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.links: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.chars = 0

    def add(self, one: Aligner, ids: list, texts: list) -> None:
        x = one.align(texts)
        found = []
        for row, column, _ in x.overlaps():
            doc = np.searchsorted(x.first_a, row, "right") - 1
            found.append(doc << 2 * SHIFT | x.a[row] << SHIFT | x.b[column])
        keys = np.concatenate([np.zeros(0, np.int64), *found])
        n_links = np.bincount(keys >> 2 * SHIFT, minlength=len(ids))
        keys, counts = np.unique(keys, return_counts=True)
        n_pairs = np.bincount(keys >> 2 * SHIFT, minlength=len(ids))
        # Groups end where texts end, so a text's groups lie between its cuts.
        size = np.concatenate([[0], x.ends_a])[x.first_a]
        n_groups = np.diff(np.searchsorted(x.cuts, size, "right"))
        n_shared = np.diff(np.concatenate([[0], np.cumsum(product_sizes(*x.group_matrices()))])[x.first_a])
        self.rows += zip(ids, *(v.tolist() for v in (np.diff(x.first_a), np.diff(x.first_b), n_groups, n_links, n_shared)), one.digests(x), n_pairs.tolist())
        self.links.append(keys & (1 << 2 * SHIFT) - 1)
        self.counts.append(counts)
        self.chars += sum(len(t or "") for t in texts)

    def batch(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        """A row for each text, its pairs as places in the shard's sorted pairs; and one row
        with these and their numbers."""
        every, counts = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (self.links, self.counts))
        pairs, place = np.unique(every, return_inverse=True)
        total = np.bincount(place, counts, len(pairs)).astype(np.int64)
        packed, at = [], 0
        for row in self.rows:
            n = row[-1]
            steps = np.diff(place[at : at + n], prepend=0)
            raw = np.concatenate([steps, counts[at : at + n]]).astype("<u4").tobytes()
            packed.append(pa.compress(raw, codec="zstd", asbytes=True) if n else b"")
            at += n
        columns = list(zip(*self.rows)) if self.rows else [[]] * 8
        types = [kind, *[pa.int64()] * 5, pa.string(), pa.int64()]
        arrays = [pa.array([*c, None], t) for c, t in zip(columns, types)]
        lists = [pa.array([None] * len(self.rows) + [v], pa.list_(pa.int64())) for v in (pairs, total)]
        shard = pa.array([number] * (len(self.rows) + 1), pa.int64())
        return pa.RecordBatch.from_arrays([shard, *arrays, pa.array([*packed, None], pa.binary()), *lists], ["shard", "id", *COUNTED, "n_pairs", "links", "pairs", "counts"])


COUNTED = ["n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256"]
_COUNTED = "n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string"


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_shared, groups_sha256, n_best, count_sum) of each
    text: its tokens, groups, overlap links and pairs of tokens that share a group; how many
    links are between ids whose count is the highest of their B id in the corpus; and the
    sum of the counts of all links' id pairs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, shard, number, id_type = aligner(path_a, path_b), _Shard(), TaskContext.get().partitionId() << 33, None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for ids, texts in _groups(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                shard.add(one, ids, texts)
                if shard.chars >= shard_chars:
                    yield shard.batch(number, id_type)
                    shard, number = _Shard(), number + 1
        if shard.rows:
            yield shard.batch(number, id_type)

    schema = f"shard long, id {kind}, {_COUNTED}, n_pairs long, links binary, pairs array<long>, counts array<long>"
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema), "alignment")
    pairs = rows.where("pairs is not null").select("shard", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("counts").alias("n"))))
    counts = materialize(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "alignment-counts")
    b_id = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("highest"))
    told = pairs.join(counts, "pair").withColumn("b", b_id).join(F.broadcast(highest), "b")
    told = told.select(F.col("shard").alias("to_shard"), "pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    texts = rows.where("pairs is null").drop("pairs", "counts")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy(), kind="stable")
        count, best = (np.asarray(right.column(c).to_numpy(zero_copy_only=False))[order].astype(np.int64) for c in ("count", "best"))
        n_best, count_sum = [], []
        for n, raw in zip(left.column("n_pairs").to_pylist(), left.column("links").to_pylist()):
            steps, times = np.frombuffer(pa.decompress(raw, 8 * n, codec="zstd") if n else b"", "<u4").astype(np.int64).reshape(2, n)
            place = np.cumsum(steps)
            n_best.append(int(times @ best[place]))
            count_sum.append(int(times @ count[place]))
        return pa.Table.from_arrays([left.column("id"), *(left.column(c) for c in COUNTED), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], ["id", *COUNTED, "n_best", "count_sum"])

    joined = texts.groupBy("shard").cogroup(told.groupBy("to_shard")).applyInArrow(finish, f"id {kind}, {_COUNTED}, n_best long, count_sum long")
    return joined.withColumnRenamed("id", id_col)


def links(docs: DataFrame, path_a: str, path_b: str, kind: str = "overlap", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a, b, a_id, b_id, weight): the links of each text between its a-th A token and
    its b-th B token, from 0. kind "overlap": those that share bytes, weight their number;
    "group": those of one group, weight 1."""
    id_kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("overlap", "group"):
        raise ValueError(f"unknown kind of links: {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = aligner(path_a, path_b)
        for batch in batches:
            for ids, texts in _groups(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                x = one.align(texts)
                named = pa.array(ids, batch.schema.field("id").type)
                for row, column, weight in x.overlaps() if kind == "overlap" else product(*x.group_matrices()):
                    doc = np.searchsorted(x.first_a, row, "right") - 1
                    values = [row - x.first_a[doc], column - x.first_b[doc], x.a[row], x.b[column], weight]
                    yield pa.RecordBatch.from_arrays([named.take(pa.array(doc)), *(pa.array(v, pa.int64()) for v in values)], ["id", "a", "b", "a_id", "b_id", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_kind}, a long, b long, a_id long, b_id long, weight long").withColumnRenamed("id", id_col)
