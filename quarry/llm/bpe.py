"""BPE encoding and decoding by prefix-sharing trie traversal (operator 7).

The distinct words that a task has not met yet go into a trie. A depth-first
walk gives each node one state: the last token of the encoding of the node's
prefix. That is enough, since the encoding of a prefix without its last token is
the encoding of the shorter prefix where that token begins. So a prefix that
many words share is encoded once, and a word's ids are read off by following
last tokens back to the root.

The last token of a prefix is the one token t that ends the prefix and may stand
behind the last token of what is left. Two tokens may stand side by side when no
merge would have joined across their border while both were being built; see
`_Merges.adjacent`.

Edge cases: null text encodes as the empty text (0 tokens). Texts are taken
whole. Repeated rows give repeated results. Columns other than the id and the
text are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A worker forgets its words beyond these counts; bounds its memory.
MAX_CHUNKS = 500_000
MAX_NODES = 300_000
MAX_PAIRS = 150_000
TAIL = 4
#: Texts are worked on in groups of about so many characters.
GROUP_CHARS = 1_000_000

# Fixed values of the tokenizer: what its pattern calls a letter or a number, for
# the code points that the quick path takes.
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")
#: Whatever is not here is normalised and split by the tokenizers library. U+0130
#: is left out since its lower case is two code points.
_UNUSUAL = re.compile("[^\t-\r\x20-\x7e\xa0-\u012f\u0131-\u017f–—‘-”•…€]")


def _byte_alphabet() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for U+0100 and on."""
    out, more = {}, 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out[b] = chr(b)
        else:
            out[b] = chr(more)
            more += 1
    return out


class _Merges:
    """Vocabulary and merge ranks, with the way each token is built."""

    def __init__(self, model: dict):
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.rank: dict[tuple[int, int], int] = {}
        born: dict[int, int] = {}
        parts: dict[int, tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[left, right] = r
            if whole not in born:
                born[whole], parts[whole] = r, (left, right)
        # The border symbols of a token over time: (symbol, born, used up).
        self.right_edge, self.left_edge = {}, {}
        for t in self.ids.values():
            for edge, side in ((self.right_edge, 1), (self.left_edge, 0)):
                spine, x, gone = [], t, 1 << 60
                while True:
                    spine.append((x, born.get(x, -1), gone))
                    if x not in parts:
                        break
                    gone, x = born[x], parts[x][side]
                edge[t] = spine
        self.known: dict[int, bool] = {}
        # A token is reachable when its own text encodes as itself.
        self.sound: dict[int, bool] = {}
        self.order = {t: born.get(t, -1) for t in self.ids.values()}
        self.parts = parts

    def reachable(self, t: int) -> bool:
        got = self.sound.get(t)
        if got is None:
            got = True
            if t in self.parts:
                a, b = self.parts[t]
                got = self.reachable(a) and self.reachable(b) and self.adjacent(a, b, self.order[t])
            self.sound[t] = got
        return got

    def adjacent(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether no merge of a rank below `before` joins across the border of a
        and b while they are built. Merges go by rank; of equal ones the left goes
        first, so a symbol on the left that a merge of the same rank uses up is
        gone, one on the right is still there."""
        rank = self.rank
        for x, x_born, x_gone in self.right_edge[a]:
            for y, y_born, y_gone in self.left_edge[b]:
                r = rank.get((x, y))
                if r is not None and x_born < r < x_gone and y_born < r <= y_gone and r < before:
                    return False
        return True

    def follows(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self.known.get(key)
        if got is None:
            if len(self.known) > MAX_PAIRS:
                self.known.clear()
            got = self.known[key] = self.adjacent(a, b)
        return got


class PrefixTrie:
    """Words as paths of symbols. A node is addressed by its prefix and holds the last
    token of the prefix's encoding and that token's length, as one number."""

    def __init__(self, merges: _Merges):
        self.follows, self.known = merges.follows, merges.known
        self.ends: dict[str, tuple] = {}
        self.ends_word: dict[str, tuple] = {}
        # Tokens by their symbols, the end-of-word mark being part of the last one.
        self.longest = 1
        self.by_text: dict[str, int] = {}
        self.by_text_end: dict[str, int] = {}
        for text, t in merges.ids.items():
            ends = text.endswith(merges.end)
            body = text[: -len(merges.end)] if ends else text
            if merges.reachable(t):
                (self.by_text_end if ends else self.by_text)[body] = t
                self.longest = max(self.longest, len(body))
        self.clear()

    def clear(self) -> None:
        self.nodes: dict[str, int] = {}

    def _ends(self, tail: str, tokens: dict[str, int], ends: dict) -> tuple:
        """Tokens of up to TAIL symbols that end a prefix with this tail, as (size,
        token), shortest first. Which they are is kept for each tail."""
        if len(ends) > MAX_PAIRS:
            ends.clear()
        n = len(tail)
        got = ends[tail] = tuple((size, tokens[tail[n - size :]]) for size in range(1, n + 1) if tail[n - size :] in tokens)
        return got

    def _last(self, prefix: str, tokens: dict[str, int], ends: dict[str, tuple]) -> int:
        """The one token that ends the prefix and may follow the last token of what is
        left, times 256, and its length. Nodes above the prefix are there."""
        nodes, known, n = self.nodes, self.known, len(prefix)
        tail = prefix[-TAIL:]
        for size, t in ends.get(tail) or self._ends(tail, tokens, ends):
            if size == n:
                return t << 8 | size
            pair = nodes[prefix[: n - size]] >> 8 << 20 | t
            ok = known.get(pair)
            if ok if ok is not None else self.follows(pair >> 20, t):
                return t << 8 | size
        for size in range(TAIL + 1, min(n, self.longest) + 1):
            t = tokens.get(prefix[n - size :])
            if t is not None and (size == n or self.follows(nodes[prefix[: n - size]] >> 8, t)):
                return t << 8 | size
        raise ValueError(f"no token ends {prefix!r}")

    def insert_and_encode(self, words: list[str]) -> dict[str, bytes]:
        """Insert the words (in byte symbols) and encode them, packed. In sorted order this
        is a depth-first walk: each word goes on from the longest prefix that is there."""
        nodes, last, by_text, by_text_end, out = self.nodes, self._last, self.by_text, self.by_text_end, {}
        ends, ends_word = self.ends, self.ends_word
        for word in sorted(words):
            n = len(word)
            if not n:
                out[word] = b""
                continue
            depth = n - 1
            while depth and word[:depth] not in nodes:
                depth -= 1
            for d in range(depth + 1, n):
                nodes[word[:d]] = last(word[:d], by_text, ends)
            node = last(word, by_text_end, ends_word)
            ids, at = [node >> 8], n - (node & 255)
            while at:
                node = nodes[word[:at]]
                ids.append(node >> 8)
                at -= node & 255
            ids.reverse()
            out[word] = _packed(ids)
        return out


class _Chunks(dict):
    """Packed ids by chunk. When it is full its content becomes the old one, out of which
    chunks that are met again come back; those that are not are forgotten the next time."""

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()

    def unknown(self, chunks: set[str]) -> set[str]:
        """Those that are neither here nor among the old ones, which come back."""
        new = chunks - self.keys()
        if self.old:
            back = new & self.old.keys()
            self.update(zip(back, map(self.old.__getitem__, back)))
            new -= back
        return new


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Encodes texts as the tokenizers library does with the same file, words by the trie."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = Tokenizer.from_file(path)
        self._normalize, self._split = self.lib.normalizer.normalize_str, self.lib.pre_tokenizer.pre_tokenize_str
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._special = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)))
        self._bytes = _byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.vocab_size = max([*vocab.values(), *self.special.values()]) + 1
        self.chunks = _Chunks()
        self._prepare(spec["model"])

    def _prepare(self, model: dict) -> None:
        self.trie = PrefixTrie(_Merges(model))
        self.tokens = [""] * self.vocab_size
        for text, t in [*model["vocab"].items(), *self.special.items()]:
            self.tokens[t] = text

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of words in byte symbols."""
        if len(self.trie.nodes) > MAX_NODES:
            self.trie.clear()
        return self.trie.insert_and_encode(words)

    def _symbols(self, word: str) -> str:
        return word if word.isascii() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._bytes)

    def _learn(self, new: set[str]) -> None:
        """Ids of chunks (texts without white space)."""
        known = self.chunks
        mixed = {c: _WORDS.findall(c) for c in new if not c.isalpha()}
        words = new - mixed.keys()
        words |= known.unknown({w for ws in mixed.values() for w in ws} - words)
        symbols = {w: self._symbols(w) for w in words}
        ids = self._encode_words(list(symbols.values()))
        known.update((w, ids[s]) for w, s in symbols.items())
        known.update((c, b"".join(map(known.__getitem__, ws))) for c, ws in mixed.items())

    def _encode_unusual(self, text: str) -> bytes:
        out, at = [], 0
        for m in [*self._special.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            if part:
                words = [w for w, _ in self._split(self._normalize(part))]
                ids = self._encode_words(list(set(words)))
                out += [ids[w] for w in words]
            if m:
                out.append(self.pack([self.special[m[0]]]))
                at = m.end()
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Packed ids of each text."""
        group, chars = [], 0
        for text in texts:
            text = text or ""
            group.append(text)
            chars += len(text)
            if chars >= GROUP_CHARS:
                yield from self._encode_group(group)
                group, chars = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        """Chunks that are not known yet are encoded together. Python's search for cycles, which would walk
        all of these again and again, rests meanwhile."""
        resting = gc.isenabled()
        gc.disable()
        try:
            return self._encode_all(texts)
        finally:
            if resting:
                gc.enable()

    def _encode_all(self, texts: list[str]) -> list[bytes]:
        if len(self.chunks) > MAX_CHUNKS // 2:
            self.chunks.turn()
        split = [None if "<|" in t or _UNUSUAL.search(t) else t.lower().split() for t in texts]
        self._learn(self.chunks.unknown(set().union(*(words for words in split if words))))
        look = self.chunks.__getitem__
        return [self._encode_unusual(t) if words is None else b"".join(map(look, words)) for t, words in zip(texts, split)]

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return _packed(ids)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by one space: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each file in a worker; it keeps the words that it has met."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids as binary, little-endian unsigned 32-bit integers.

    tokenizer is the path of the tokenizer file, the same on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in batches:
            ids = list(c.encode(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary())], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary").select(F.col("id").alias(id_col), "ids")


def roundtrip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of a text's ids and of
    what they decode to, without moving either out of the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in batches:
            n, a, b = [], [], []
            for ids in c.encode(batch.column("text").to_pylist()):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(c.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from what encode() gave; null ids decode as the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in batches:
            texts = [c.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
