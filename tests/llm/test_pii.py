"""Base spans against the patterns in Python; what the method adds and takes away."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import pii
from quarry.llm.common import materialize


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c)
        total += (x * 2 - 9 * (x > 4)) if i % 2 else x
    return total % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def redacted(text, spans):
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if out and start < at:
            at = max(at, end)
            continue
        out += [text[at:start], f"[{pii.KINDS[kind].upper()}]"]
        at = end
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    rnd = random.Random(3)
    odd = ["a@b.c_d@e.f", "x@y.z@w.q", "1.2.3.4.5.6.7.8", "é+1 (640) 555-0953é", "256.1.1.1 0001.0255.3.4", "4417744280351547-4417 744280351547", "a@b.c" * 3, "@@a@b.c."]
    odd += ["1 " * 30_000, "7" * 50_000, "a" * 50_000 + "@b", "x@" + "b." * 30_000, "+1" * 100, None, "", "😀 a@b.co 😀 4417744280351547", "a@b.co " * 1000]
    odd += ["".join(rnd.choice("ab.@+-1234567890 ()é%_") for _ in range(rnd.randint(0, 80))) for _ in range(3000)]
    made = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    docs = made.union(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = pii.candidates(docs).cache()
    spans = pii.spans(pii.fit(found))
    return found.select("doc_id", "text", spans.alias("s"), pii.as_text(spans).alias("t"), pii.redact(F.coalesce("text", F.lit("")), spans).alias("r")).collect()


def test_base_spans(rows):
    for r in rows:
        assert [(s.start, s.kind, s.end) for s in r.s if s.base] == base(r.text or ""), (r.text or "")[:80]


def test_text_and_redaction(rows):
    for r in rows:
        assert r.t == ",".join(f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.s)
        assert r.r == redacted(r.text or "", [(s.start, s.kind, s.end) for s in r.s])


def test_labelers_add_and_refuse(spark):
    # Emails and phones written another way, with words that tell; numbers that fail their check.
    good = [(i, f"write to user{i}@mail{i % 5}.example.com or call +1 (640) 555-{1000 + i}") for i in range(60)]
    new = [(100, "contact mail: john (at) mail (dot) com"), (101, "call phone 640-555-0199")]
    bad = [(200 + i, f"number {4963198541998630 + 3 * i} of it") for i in range(40)]
    found = pii.candidates(spark.createDataFrame(good + new + bad, "doc_id long, text string")).cache()
    model = pii.fit(found)
    got = {r.doc_id: r.s for r in found.select("doc_id", pii.spans(model).alias("s")).collect()}
    assert len(got[100]) == 1 and len(got[101]) == 1
    assert all(all(s.base for s in got[i]) for i, _ in bad)
    assert set(model["reliability"]) == set(pii.KINDS)


CANDIDATES = "candidates array<struct<kind:int,start:bigint,end:bigint,base:boolean,shape:int,valid:int,listed:int,near:int,apart:int,size:int>>"


def made_votes(right, n=4000, seed=8):
    """Candidates of one kind with votes that are right so often; (true, row)."""
    rnd, rows = random.Random(seed), []
    for i in range(n):
        true = rnd.random() < 0.5
        votes = [(1 if true else -1) * (1 if rnd.random() < right[v] else -1) for v in pii.LABELERS]
        votes = [max(0, x) if v in ("listed", "near") else x for v, x in zip(pii.LABELERS, votes)]  # these say yes or nothing
        rows.append((true, (3, i, i + 12, true and rnd.random() < 0.3, *votes, 3)))
    return rows


def test_reliabilities_are_recovered(spark):
    right = {"shape": 0.9, "valid": 0.6, "listed": 0.8, "near": 0.7, "apart": 0.85}
    rows = made_votes(right)
    model = pii.fit(spark.createDataFrame([([r],) for _, r in rows], CANDIDATES))
    for j, v in enumerate(pii.LABELERS):
        for c in (0, 1):
            seen = [r[4 + j] for true, r in rows if true == bool(c)]
            for vote in (-1, 0, 1):
                assert abs(model["reliability"]["phone"][v][c][vote + 1] - seen.count(vote) / len(seen)) < 0.06, (v, c, vote)


def plain_em(rows, rounds=50):
    """Reliabilities by loops over candidates and labelers."""
    kinds, labelers, votes = range(len(pii.KINDS)), range(len(pii.LABELERS)), (-1, 0, 1)
    lean = {0: {-1: 4.0, 0: 2.0, 1: 1.0}, 1: {-1: 1.0, 0: 2.0, 1: 4.0}}
    p = [1.0 if r[3] else 0.2 for r in rows]
    for _ in range(rounds):
        trust, prior = {}, {}
        for k in kinds:
            known = sum(1 for r in rows if r[0] == k and r[3])
            held = sum(q for r, q in zip(rows, p) if r[0] == k and not r[3])
            loose = sum(1 for r in rows if r[0] == k and not r[3])
            trust[k], prior[k] = min(1.0, known / max(1e-9, held)), (1 + held) / (5 + loose)
        seen = {(k, j, c, v): 0.0 for k in kinds for j in labelers for c in (0, 1) for v in votes}
        for r, q in zip(rows, p):
            for j in labelers:
                seen[r[0], j, 1, r[4 + j]] += 1.0 if r[3] else q * trust[r[0]]
                seen[r[0], j, 0, r[4 + j]] += 1 - q
        table = {}
        for j in labelers:
            for c in (0, 1):
                every = {v: lean[c][v] + sum(seen[k, j, c, v] for k in kinds) for v in votes}
                for k in kinds:
                    own = {v: seen[k, j, c, v] + 7 * every[v] / sum(every.values()) for v in votes}
                    for v in votes:
                        table[k, j, c, v] = own[v] / sum(own.values())
        for i, r in enumerate(rows):
            if not r[3]:
                yes, no = prior[r[0]], 1 - prior[r[0]]
                for j in labelers:
                    yes *= table[r[0], j, 1, r[4 + j]]
                    no *= table[r[0], j, 0, r[4 + j]]
                p[i] = yes / (yes + no)
    return table


def test_em_like_plain_loops(spark):
    rnd = random.Random(12)
    rows = [r for _, r in made_votes({v: 0.8 for v in pii.LABELERS}, 300)]
    rows += [(rnd.choice([0, 2]), *r[1:]) for _, r in made_votes({v: 0.7 for v in pii.LABELERS}, 200, 9)]
    got, want = pii.fit(spark.createDataFrame([(rows[:250],), (rows[250:],)], CANDIDATES))["reliability"], plain_em(rows)
    for k, kind in enumerate(pii.KINDS):
        for j, labeler in enumerate(pii.LABELERS):
            for c in (0, 1):
                for v in (-1, 0, 1):
                    assert got[kind][labeler][c][v + 1] == pytest.approx(want[k, j, c, v], abs=1e-9)


@pytest.mark.parametrize(
    "kind,text,vote",
    [("email", "a@b.de", 1), ("email", "a@b.museum", 1), ("email", "icon@2x.png", -1), ("email", "a (at) b (dot) com", 1), ("email", "a@b.c_d", 0)]
    + [("ip", x, 1) for x in ("8.8.8.8", "93.184.216.34", "100.128.0.1")]
    + [("ip", x, -1) for x in ("0.1.2.3", "127.0.0.1", "169.254.3.4", "224.0.0.1", "255.255.255.255", "999.1.1.1")]
    + [("ip", x, 0) for x in ("10.0.0.1", "192.168.1.1", "172.20.1.1", "203.0.113.9", "100.64.0.1")]
    + [("card", x, 1) for x in ("4111 1111 1111 1111", "378282246310005", "2221000000000009", "6011000990139424", "30569309025904", "3530111333300000")]
    + [("card", x, -1) for x in ("9999 9999 9999 9999", "37828224631000", "1234567890123456")]
    + [("phone", x, 1) for x in ("+49 30 1234567", "+1 640 555 0199", "640-555-0199", "(640) 555-0199", "+420 123 456 789")]
    + [("phone", x, -1) for x in ("140-555-0199", "640-155-0199", "+0 123 456 7890")],
)
def test_registers(spark, kind, text, vote):
    assert spark.range(1).select(pii._listed(kind, F.lit(text)).alias("v")).first().v == vote


def test_no_labeler_votes_alike_on_all(spark):
    """On the given documents each says different things; of addresses also the register."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    made = [(-1, "host 8.8.8.8 up"), (-2, "net 10.1.2.3"), (-3, "version 0.9.8.1 out")]
    one = pii.candidates(docs.unionByName(spark.createDataFrame(made, "doc_id long, text string"))).select(F.explode("candidates").alias("c")).select("c.*").cache()
    for v in pii.LABELERS:
        assert one.select(v).distinct().count() > 1, v
    assert {r.listed for r in one.where("kind = 1").select("listed").distinct().collect()} == {-1, 0, 1}
    one.unpersist()


def test_two_labelers_outvote_a_third(spark):
    """Whichever the third is, also the check: it is trusted as far as the others bear it out."""
    for weak in ("shape", "valid", "apart"):
        right = {v: 0.5 if v in ("listed", "near") else 0.6 if v == weak else 0.93 for v in pii.LABELERS}
        model = pii.fit(spark.createDataFrame([([r],) for _, r in made_votes(right)], CANDIDATES))
        yes = {v: 0 if v in ("listed", "near") else -1 if v == weak else 1 for v in pii.LABELERS}
        no = {v: -x for v, x in yes.items()}
        ask = [(3, 0, 12, False, *yes.values(), 3), (3, 20, 32, False, *no.values(), 3)]
        got = spark.createDataFrame([(ask,)], CANDIDATES).select(pii.spans(model).alias("s")).first().s
        assert [x.start for x in got] == [0], weak


def test_what_is_added_to_the_given_documents(spark):
    """At sf0.1: whatever is added is a phone number or an email written another way, and
    no number that fails its check."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    found = materialize(pii.candidates(docs), "pii-test")
    rows = found.select("text", F.explode(F.filter(pii.spans(pii.fit(found)), lambda x: ~x["base"])).alias("s")).collect()
    added = [(r.s.kind, r.text[r.s.start : r.s.end]) for r in rows]
    assert len(added) >= 2
    for kind, text in added:
        assert kind in (0, 3) and (kind == 0 or 10 <= len(re.sub("[^0-9]", "", text)) <= 15), text


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, "clean", "c"), (None, None, None)], "doc_id long, text string, candidates string")
    found = pii.candidates(docs)
    assert [r.s for r in found.select(pii.spans(pii.fit(found)).alias("s")).collect()] == [[], []]
    assert pii.candidates(docs.limit(0)).count() == 0


def test_the_fit_is_alike_at_every_size(spark):
    from quarry.llm import pii

    def weights(scale):
        parts = []
        for base, vote, n in ((True, 1, 900), (False, 1, 700), (False, -1, 500), (False, 0, 40)):
            one = F.struct(F.lit(0).alias("kind"), F.lit(base).alias("base"), *[F.lit(vote).alias(v) for v in pii.LABELERS], F.lit(2).alias("size"))
            parts.append(spark.range(n).select(F.array_repeat(one, scale).alias("candidates")))
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        return pii.fit(rows)["weights"]

    assert max(abs(a - b) for a, b in zip(weights(1000), weights(8000))) < 0.01
