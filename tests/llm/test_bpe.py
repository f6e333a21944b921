"""Against the tokenizers library, and its own decoding."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe, packing
from quarry.llm.queries import TOKENIZER, op7_bpe_trie

LIB = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def texts():
    rnd = random.Random(1)
    alphabet = "abcdeinthrs aaaa'st0123.,!$<|>éßñüÉÜİΣςσ日本😀́ \u0085\x1c​ǅ²½ªǆƁ\n"
    out = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    out += ["", " ", "<|endoftext|>a<|startoftext|>", "x<|endoftext|", "\x00\x1f a", "thing*** thing,thing", "a" * 5000, "".join(map(chr, range(1, 0x250)))]
    return out + [chr(x) + "a" + chr(x) for x in range(1, 0x800)]


def test_like_the_library():
    codec, cases = bpe.codec(TOKENIZER), texts()
    narrow = packing.codec_of(TOKENIZER)
    assert [np.frombuffer(x, narrow.kind).tolist() for x in narrow.encode(cases)] == [ids(x) for x in codec.encode(cases)]
    for text, raw in zip(cases, codec.encode(cases), strict=True):
        want = LIB.encode(text, add_special_tokens=False).ids
        assert ids(raw) == want, text
        assert codec.decode(raw) == LIB.decode(want, skip_special_tokens=False)


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_CHUNKS", 50)
    monkeypatch.setattr(bpe, "MAX_NODES", 50)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 100)
    codec, cases = bpe.Codec(TOKENIZER), texts()[:800]
    assert [ids(x) for x in codec.encode(cases)] == [LIB.encode(t, add_special_tokens=False).ids for t in cases]


def test_trie_computes_shared_prefixes_once():
    trie = bpe.codec(TOKENIZER).trie
    trie.clear()
    trie.insert_and_encode(["interest", "interested", "interesting"])
    assert len(trie.nodes) == len("interestin") + 1  # one branch: the e of interested


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "Hello World's", "x"), (2, None, "y"), (None, "été", None), (1, "Hello World's", "x"), (2**60, "", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_rows_and_nulls(odd):
    got = sorted((tuple(r) for r in bpe.roundtrip(odd, TOKENIZER).collect()), key=repr)
    want = []
    for doc, text, _ in odd.collect():
        e = LIB.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(e), hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest(), hashlib.sha256(LIB.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.encode(odd.limit(0), TOKENIZER).count() == 0


def test_decode(odd):
    texts = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd, TOKENIZER), TOKENIZER).collect()}
    assert texts[1] == "hello</w> world</w> 's</w>" and texts[2] == texts[2**60] == ""


def test_query_over_all_documents(spark, sf_dir):
    rows = {r.doc_id: tuple(r)[1:] for r in op7_bpe_trie(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for r in docs:
        e = LIB.encode(r.text or "", add_special_tokens=False).ids
        decoded = LIB.decode(e, skip_special_tokens=False)
        assert rows[r.doc_id] == (len(e), hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
