"""Against plain loops over tokens and bytes."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from quarry.llm import alignment
from quarry.llm.queries import ALIGNED, op11_token_alignment

A, B = Tokenizer.from_file(ALIGNED[0]), SentencePieceProcessor(model_file=ALIGNED[1])
A.encode_special_tokens = True


def byte_of():
    """The byte-level alphabet, by its rule: printable bytes first, then the others."""
    printable = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


BYTE = byte_of()


def tokens(text):
    if not text:
        return [], []
    a = [(i, bytes(BYTE[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[1:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(t for _, t in a) == b"".join(t for _, t in b) == whole else ([], [])


def spans(side):
    out, at = [], 0
    for i, t in side:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_shared, groups_sha256, n_best, count_sum) of each text."""
    every = []
    for text in texts:
        a, b = map(spans, tokens(text))
        links = [(x, y) for x, i, j in a for y, k, l in b if i < l and k < j] if len(a) < 400 else near(a, b)
        cuts = sorted({j for _, _, j in a} & {j for _, _, j in b})
        groups, at = [], 0
        for cut in cuts:
            groups.append(([x for x, i, j in a if at < j <= cut], [y for y, k, l in b if at < l <= cut]))
            at = cut
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        every.append((len(a), len(b), len(groups), links, sum(len(x) * len(y) for x, y in groups), hashlib.sha256(written.encode()).hexdigest() if a else ""))
    count = Counter(p for e in every for p in e[3])
    highest = {}
    for (_, y), n in count.items():
        highest[y] = max(n, highest.get(y, 0))
    return [(*e[:3], len(e[3]), *e[4:], sum(count[p] == highest[p[1]] for p in e[3]), sum(count[p] for p in e[3])) for e in every]


def near(a, b):
    out, first = [], 0
    for x, i, j in a:
        while b[first][2] <= i:
            first += 1
        k = first
        while k < len(b) and b[k][1] < j:
            out.append((x, b[k][0]))
            k += 1
    return out


def texts():
    rnd = random.Random(6)
    alphabet = ["a", "b", "the", " ", " ", "ing", "é", "日", "<s>", "1", ".", "'s", "ﬁ", "￼", "😀", "\n", "<|endoftext|>", "<0x41>", "un"]
    out = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 30))) for _ in range(300)]
    return out + ["", None, " ", "  two  spaces ", "a▁b", "tokenization of words", "tokenization of words", "x" * 3000, "\x00\x01"]


@pytest.mark.parametrize("shard_chars", [40, 10_000_000])
def test_like_plain_loops(spark, shard_chars):
    cases = texts()
    rows = [(i, t, "x", i) for i, t in enumerate(cases)] + [(None, "the same", None, 0), (7, "the same", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, id long").repartition(3)
    got = sorted((tuple(r) for r in alignment.align(docs, *ALIGNED, shard_chars=shard_chars).collect()), key=repr)
    want = plain([r[1] for r in rows])
    assert got == sorted(((r[0], *w) for r, w in zip(rows, want)), key=repr)
    assert any(w[5] == "" and r[1] for r, w in zip(rows, want)) and sum(w[0] > 0 for w in want) > 200
    assert alignment.align(docs.limit(0), *ALIGNED).count() == 0


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_product_like_dense_matrices(block):
    rnd = np.random.default_rng(2)
    for _ in range(50):
        a, b = rnd.random((rnd.integers(1, 9), 12)) < 0.3, rnd.random((rnd.integers(1, 9), 12)) < 0.3
        made = [alignment.Csr(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1], 12) for m in (a, b)]
        bt = alignment.transposed(made[1])
        got = np.zeros((len(a), len(b)), int)
        for row, column, value in alignment.product(made[0], bt, block):
            got[row, column] += value
        assert (got == a.astype(int) @ b.astype(int).T).all()
        assert (alignment.product_sizes(made[0], bt) == (a.astype(int) @ b.astype(int).T).sum(1)).all()


def test_links(spark):
    docs = spark.createDataFrame([(1, "tokenization of strings"), (2, None), (3, "unbelievably so")], "doc_id long, text string")
    overlap, group = (sorted(tuple(r) for r in alignment.links(docs, *ALIGNED, kind=k).collect()) for k in ("overlap", "group"))
    want, shared = [], []
    for i, text in ((1, "tokenization of strings"), (3, "unbelievably so")):
        a, b = map(spans, tokens(text))
        cuts = sorted({j for _, _, j in a} & {j for _, _, j in b})
        of = lambda j: next(g for g, cut in enumerate(cuts) if j <= cut)  # noqa: E731,B023
        want += [(i, m, n, x[0], y[0], min(x[2], y[2]) - max(x[1], y[1])) for m, x in enumerate(a) for n, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]]
        shared += [(i, m, n, x[0], y[0], 1) for m, x in enumerate(a) for n, y in enumerate(b) if of(x[2]) == of(y[2])]
    assert overlap == want and group == shared
    with pytest.raises(ValueError):
        alignment.links(docs, *ALIGNED, kind="other")


def test_ids_that_do_not_follow_the_merges(tmp_path):
    with open(ALIGNED[0], encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"][5:7] = spec["model"]["merges"][6:4:-1]
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        alignment.Aligner(str(tmp_path / "other.json"), ALIGNED[1])


def test_very_long_text():
    x = alignment.aligner(*ALIGNED).align(["word and others, " * 60_000, "", "short one"])
    assert sum(len(r) for r, _, _ in x.overlaps()) == sum(len(near(*map(spans, tokens(t)))) for t in ("word and others, " * 60_000, "short one"))


def test_query_over_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in op11_token_alignment(spark, sf_dir).collect()}
    assert got == dict(zip([r.doc_id for r in docs], plain_of_long([r.text for r in docs])))


def plain_of_long(texts):
    """As plain(), with groups found in one walk."""
    every = []
    for text in texts:
        a, b = map(spans, tokens(text))
        both = {j for _, _, j in a} & {j for _, _, j in b}
        groups = [[[], []] for _ in range(len(both))]
        for side, which in ((a, 0), (b, 1)):
            g = 0
            for i, _, j in side:
                groups[g][which].append(i)
                g += j in both
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        every.append((len(a), len(b), len(groups), near(a, b), sum(len(x) * len(y) for x, y in groups), hashlib.sha256(written.encode()).hexdigest() if a else ""))
    count = Counter(p for e in every for p in e[3])
    highest = {}
    for (_, y), n in count.items():
        highest[y] = max(n, highest.get(y, 0))
    return [(*e[:3], len(e[3]), *e[4:], sum(count[p] == highest[p[1]] for p in e[3]), sum(count[p] for p in e[3])) for e in every]
