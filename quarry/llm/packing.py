"""Packing documents into training sequences along a space-filling curve (operator 10).

1. Every document is tokenised; its tokens are counted in hashed slots, the counts
   are scaled to length one and projected to a few dimensions, and the cell that the
   projection falls into gets its number on a Hilbert curve. Documents of like
   wording have near numbers.
2. The tokenised documents are range-sorted by (number, id). The id keeps copies,
   which all have one number, from meeting in one partition.
3. Each partition is one stream of tokens in that order, cut every max_len tokens.
   What is left at its end is cut into powers of two, which need no padding. A
   partition leaves less than one sequence over, so a task holds one sequence.

The tokenised documents are written to the shared folder between 1 and 2: the range
sort reads its input twice, for its bounds and for its rows.

Edge cases: null text is the empty text, which has the end token alone. A document
longer than a sequence lies in several. Ties in the curve's number go by id, repeated
ids by their tokens. A null id sorts first. An empty table gives no rows. Columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import bpe
from quarry.llm.common import give_back, materialize, partitions

SLOTS, DIMS, BITS = 1024, 4, 10
#: A worker forgets chunks beyond this number, some 70 MB.
MAX_CHUNKS = 400_000
#: Sequence ids are the partition's number times this, and on from there.
STRIDE = 1 << 33


def projection(dims: int = DIMS, slots: int = SLOTS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((slots, dims)).astype(np.float32)


def hilbert_number(cells: np.ndarray, bits: int) -> np.ndarray:
    """Numbers on the Hilbert curve of integer points (n x d, each below 2**bits).

    The coordinates are turned into the curve's transposed form bit plane by bit
    plane from the top, Gray-coded, and their bits interleaved."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        top, low = 1 << level, (1 << level) - 1
        for i in range(d):
            flip = (x[i] & top) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[d - 1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    x ^= turn
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            out = out << 1 | (x[i] >> level & 1)
    return out


def curve_numbers(vectors: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Cells of projected unit vectors: about normal, so three deviations are kept."""
    scaled = (np.clip(vectors, -3, 3) + 3) / 6 * ((1 << bits) - 1)
    return hilbert_number(scaled.astype(np.int64), bits)


class _Ids(bpe._Chunks):
    """Packed ids by chunk; a chunk is encoded the first time that it is looked up."""

    def __init__(self, of_word: Callable[[str], bytes]):
        super().__init__()
        self.of_word = of_word

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            words = [chunk] if chunk.isalpha() else bpe._WORDS.findall(chunk)
            ids = self.of_word(chunk) if words == [chunk] else b"".join([self[w] for w in words])
        self[chunk] = ids
        return ids


class Codec(bpe.Codec):
    """Ids packed as narrow as the vocabulary allows; a word that the worker has not met
    yet goes through the tokenizers library's model, which costs less than the trie where
    prefixes are not asked for."""

    def _prepare(self, model: dict) -> None:
        self._model = self.lib.model.tokenize
        self.kind, self._letter = ("<u2", "H") if self.vocab_size <= 1 << 16 else ("<u4", "I")
        self.chunks = _Ids(self._of_word)

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self._letter}", *ids)

    def _of_word(self, word: str) -> bytes:
        return self.pack([t.id for t in self._model(self._symbols(word))])

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        return {w: self.pack([t.id for t in self._model(w)]) for w in words}

    def _encode_all(self, texts: list[str]) -> list[bytes]:
        if len(self.chunks) > MAX_CHUNKS // 2:
            self.chunks.turn()
        look, unusual = self.chunks.__getitem__, bpe._UNUSUAL.search
        return [self._encode_unusual(t) if "<|" in t or unusual(t) else b"".join(map(look, t.lower().split())) for t in texts]


_CODECS: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    """One codec for each file in a worker; it keeps the words that it has met."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


_KINDS: dict[str, str] = {}


def kind_of(path: str) -> str:
    """How the ids are packed. The worker's codecs go, with the words that they have met: this is
    asked for when tokens are written, and what the worker runs next needs the memory."""
    if path not in _KINDS:
        _KINDS[path] = codec_of(path).kind
    if _CODECS:
        _CODECS.clear()
        give_back()
    return _KINDS[path]


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, number, ids): ids as unsigned 16-bit integers where the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, project = codec_of(tokenizer), projection()
        end = codec.pack([end_id])
        for batch in batches:
            vectors, packed = [], []
            for raw in codec.encode(batch.column("text").to_pylist()):
                counts = np.bincount(np.frombuffer(raw, codec.kind) % SLOTS, minlength=SLOTS).astype(np.float32)
                vectors.append(counts @ project / max(1e-9, np.sqrt(counts @ counts)))
                packed.append(raw + end)
            numbers = curve_numbers(np.array(vectors).reshape(-1, DIMS))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(numbers, pa.int64()), pa.array(packed, pa.binary())], ["id", "number", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, number long, ids binary")


class _Stream:
    """One partition's tokens, cut into sequences."""

    def __init__(self, first: int, max_len: int):
        self.next, self.max_len = first, max_len
        self.waiting: list[tuple] = []  # (id, start, ids, doc_tokens) of the open sequence
        self.used = 0
        self.rows: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while at < n:
            take = min(n - at, self.max_len - self.used)
            self.waiting.append((doc, at, ids[at : at + take], n))
            at += take
            self.used += take
            if self.used == self.max_len:
                self._close(self.waiting)
                self.waiting, self.used = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, n in pieces:
            self.rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), n, self.next, offset))
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        """The open sequence's tokens, cut into powers of two from the largest."""
        pieces = self.waiting[::-1]
        while self.used:
            room = size = 1 << self.used.bit_length() - 1
            part = []
            while room:
                doc, start, ids, n = pieces.pop()
                if len(ids) > room:
                    pieces.append((doc, start + room, ids[room:], n))
                    ids = ids[:room]
                part.append((doc, start, ids, n))
                room -= len(ids)
            self._close(part)
            self.used -= size
        self.waiting = []


def pack(docs: DataFrame, tokenizer: str, max_len: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", number_partitions: int | None = None) -> DataFrame:
    """A row per piece: (id, start, length, ids, doc_tokens, sequence_id, offset), ids
    as binary, little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = kind_of(tokenizer)
        stream = _Stream(TaskContext.get().partitionId() * STRIDE, max_len)
        kind = None

        def flush():
            rows, stream.rows = stream.rows, []
            cols = list(zip(*rows)) if rows else [[]] * 7
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            kind = batch.schema.field("id").type
            for doc, ids in zip(batch.column("id").to_pylist(), batch.column("ids")):
                stream.add(doc, np.frombuffer(ids.as_buffer(), width))
                if len(stream.rows) >= 2000:
                    yield flush()
        if kind is not None:
            stream.finish()
            yield flush()

    tokens = materialize(tokenise(docs, tokenizer, end_id, id_col, text_col), "packing-tokens")
    order = ["number", "id", "ids"]
    return (
        tokens.repartitionByRange(number_partitions or partitions(spark), "number", "id")
        .sortWithinPartitions(*order)
        .select("id", "ids")
        .mapInArrow(run, out)
        .withColumnRenamed("id", id_col)
    )
