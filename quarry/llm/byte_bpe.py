"""Byte-level BPE encoding and decoding with the tiktoken library (operator 13).

The ranks come from a local file. A text of more than LONG code points is cut before it is
encoded, at places where no match of the pattern can reach across: before a space, tab or
line end that comes after something that is no white space. There every match ends, and
none looks behind itself, so the parts' ids are the text's ids. A run of more than RUN white
space characters in such a text, which the library's matcher may have no stack for, is one
match but for its last character where something else follows; it is encoded as that match. Ids decode to
bytes; these are text again as a whole only, as a token may end within a character.

Edge cases: null text encodes as the empty text (0 tokens). Texts are taken whole, strings
of special tokens are plain text, repeated rows give repeated results, an empty table gives
none. Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG, RUN = 100_000, 10_000
#: Fixed value: the white space of the pattern.
_SPACE = "\t-\r \x85\xa0  -     　"
_CUT = re.compile(r"\S(?=[ \t\n])")


def ranks_of(path: str) -> dict[bytes, int]:
    """Ranks by token bytes, of a file with a token in base 64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class Codec:
    """Texts to ids and back, with ranks by token bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, long: int = LONG, run: int = RUN):
        import tiktoken

        self.lib = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.long = long
        self._runs = re.compile(f"[{_SPACE}]{{{run},}}")
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts whose ids follow one another, and whether a part is one match."""
        at = 0
        for m in self._runs.finditer(text):
            yield from self._cut(text, at, m.start())
            at = m.end() - (m.end() < len(text))
            yield text[m.start() : at], True
        yield from self._cut(text, at, len(text))

    def _cut(self, text: str, at: int, end: int) -> Iterator[tuple[str, bool]]:
        while end - at > self.long:
            m = _CUT.search(text, at + self.long, end)
            if not m:
                break
            yield text[at : m.end()], False
            at = m.end()
        if at < end:
            yield text[at:end], False

    def encode(self, text: str | None) -> np.ndarray:
        """The ids, as unsigned 32-bit integers."""
        text = text or ""
        if len(text) <= self.long:
            return np.array(self.lib.encode_ordinary(text), np.uint32)
        one = self.lib._encode_single_piece
        found = [np.array(one(part) if whole else self.lib.encode_ordinary(part), np.uint32) for part, whole in self.parts(text)]
        return np.concatenate([np.zeros(0, np.uint32), *found])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.lib.decode_bytes(ids.tolist())


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """One codec for each file and pattern in a worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(ranks_of(path), pattern)
    return _CODECS[path, pattern]


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def encode(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids as binary, little-endian unsigned 32-bit integers.

    ranks is the path of the rank file, the same on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            ids = [c.encode(x.as_py()).astype("<u4").tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary())], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {_kind(docs, id_col)}, ids binary").select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes) from what encode() gave; null ids decode as no bytes. Cast to string for
    the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            out = [c.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "bytes"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {_kind(encoded, id_col)}, bytes binary").withColumnRenamed("id", id_col)


def roundtrip(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of a text's ids, written as
    decimal numbers with commas between, and of the bytes that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        numbers = pa.array([f"{i}," for i in range(len(c.tokens))])
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column("text"):
                ids = c.encode(text.as_py())
                n.append(len(ids))
                a.append(hashlib.sha256(joined(numbers, ids)[0][:-1]).hexdigest())
                b.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {_kind(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def joined(entries: pa.Array, rows: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The entries of these rows one after the other, as the data of an Arrow array, and
    where each begins, with the end of the last."""
    taken = entries.take(pa.array(rows, pa.int64()))
    offsets = np.frombuffer(taken.buffers()[1], np.int32)[: len(rows) + 1]
    return memoryview(taken.buffers()[2] or b"").cast("B")[: offsets[-1]], offsets
