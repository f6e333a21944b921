"""Against all edits of short conversations, and shortest ways over written audits."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from quarry.llm import conversation_repair as repair
from quarry.llm.queries import op12_glr_repair

LEGAL = re.compile("(s?(ua)+)?")
ROLE = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(WHITE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def choices(role, fault):
    """(cost, letter, symbol or None) of a row."""
    yield 3, "D", None
    if fault not in ("blank", "duplicate"):
        more = fault == "truncated"
        yield more, "K", role[:1] or "-"
        for c in "ua":
            yield 2 + more, "R", c


def all_edits(rows):
    """The cheapest over everything with up to two rows inserted in a place."""
    gaps = ["", "u", "a", "uu", "ua", "au", "aa"]
    best = None
    kinds = faults(rows)
    for acts in itertools.product(*[list(choices(r, f)) for (r, _), f in zip(rows, kinds)]):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            word = "".join(g + (c or "") for g, (_, _, c) in zip(ins, acts)) + ins[-1]
            if LEGAL.fullmatch(word):
                audit = "".join("I" * len(g) + letter for g, (_, letter, _) in zip(ins, acts)) + "I" * len(ins[-1])
                cost = 2 * sum(map(len, ins)) + sum(a[0] for a in acts)
                if best is None or (cost, audit) < best[:2]:
                    lines = [line for g, a, r in zip(ins, acts, rows) for line in [f"{ROLE[c]}:" for c in g] + ([] if a[1] == "D" else [f"{r[0] if a[1] == 'K' else ROLE[a[2]]}:{r[1]}"])]
                    best = (cost, audit, "\n".join(lines + [f"{ROLE[c]}:" for c in ins[-1]]))
    return best


def after(state, c):
    """A state is what the roles so far can be told by."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "ok", ("ok", "u"): "u"}.get((state, c))


def written(rows):
    """The cheapest by (cost, audit, text), all of them written out, for each state."""
    best = {"": (0, "", ())}
    for (role, text), fault in [*zip(rows, faults(rows)), ((None, None), None)]:
        grown = dict(best)
        for _ in range(4):
            for state, (cost, audit, lines) in list(grown.items()):
                for c in "ua":
                    to = after(state, c)
                    new = (cost + 2, audit + "I", (*lines, f"{ROLE[c]}:"))
                    if to and (to not in grown or new[:2] < grown[to][:2]):
                        grown[to] = new
        if role is None:
            return min((v for k, v in grown.items() if k in ("", "ok")), key=lambda v: v[:2])
        best = {}
        for state, (cost, audit, lines) in grown.items():
            for more, letter, c in choices(role, fault):
                to = after(state, c) if c else state
                line = () if c is None else (f"{role if letter == 'K' else ROLE[c]}:{text}",)
                new = (cost + more, audit + letter, lines + line)
                if to is not None and (to not in best or new[:2] < best[to][:2]):
                    best[to] = new
    return None


def some_rows(rnd, n):
    return [(rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "unknown"]), rnd.choice(["", " ", "Yes.", "No", "Why? ", "a\n", "b.", "c!", "d.", "e."])) for _ in range(n)]


def solved(rows):
    return repair._solve([(r, t, t.rstrip(WHITE)[-1:]) for r, t in rows])


def test_all_edits_of_short_conversations():
    rnd = random.Random(1)
    for n in (0, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 3):
        rows = some_rows(rnd, n)
        cost, audit, text = all_edits(rows)
        assert solved(rows)[4:] == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), rows
        assert written(rows)[:2] == (cost, audit)


def test_longer_conversations():
    rnd = random.Random(2)
    for _ in range(600):
        rows = some_rows(rnd, rnd.randint(0, 30))
        cost, audit, lines = written(rows)
        got = solved(rows)
        assert got[4:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), rows
        kinds = faults(rows)
        assert got[:3] == tuple(kinds.count(k) for k in ("blank", "duplicate", "truncated"))


def test_a_top_has_one_stack():
    """So merging stacks of equal tops loses nothing; and they accept what the grammar has."""
    for word in itertools.chain.from_iterable(itertools.product("sua", repeat=n) for n in range(9)):
        stack = repair.Stack(0, None)
        for c in word:
            stack = stack and repair.after(stack, c)
        assert bool(stack and stack.top in repair.ACCEPT) == bool(LEGAL.fullmatch("".join(word)))
        assert stack is None or stack == repair.STACKS[repair.PLACE[stack.top]]


def test_matrices_give_the_same_way():
    rnd = random.Random(3)
    for _ in range(100):
        codes = [rnd.randrange(12) for _ in range(rnd.randint(1, 40))]
        cut = sorted({0, len(codes), *(rnd.randint(0, len(codes)) for _ in range(5))})
        parts = [codes[i:j] for i, j in zip(cut, cut[1:])]
        ms = [repair.matrix(p) for p in parts]
        m = repair.multiplied([repair.multiplied(ms[:2]), *ms[2:]]) if len(ms) > 2 else repair.multiplied(ms)
        to = repair.finish(m.cost[0], m.order[0])
        edits = [e for p, (start, end) in zip(parts, repair.route(ms, 0, to)) for e in repair.trace(repair.walk(p, start)[2], end)]
        cost, want, _ = repair.repair(codes)
        assert (m.cost[0][to] + repair.ENDS[to][0], edits) == (cost, want)


def plain(rows):
    """All columns, from rows before the damage, in plain Python."""
    by = {}
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        hit = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        made = by.setdefault(conv, [])
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        made += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = []
    for conv, made in by.items():
        made.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in made if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        kept = [r[1:] for r in made]
        kinds = faults(kept)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, lines = written(kept)
        out.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


@cache
def made_rows():
    rnd = random.Random(5)
    rows = [(c, t, *some_rows(rnd, 1)[0]) for c in range(25) for t in range(rnd.randint(1, 9)) if rnd.random() < 0.9]
    rows += [(None, t, "user", f"t{t}.") for t in (None, 3, 3, -2)] + [(90, None, None, None), (91, 4, "user", None), (92, None, "assistant", "x.")]
    rows += [(77, t, rnd.choice(["user", "assistant"]), rnd.choice([f"text {t}.", "again."])) for t in range(300)]
    return rows


@pytest.mark.parametrize("long,block,fan", [(2000, 2000, 500), (0, 3, 2), (5, 7, 3), (50, 1000, 2)])
def test_like_plain_python(spark, long, block, fan):
    """Solved in one group, and as blocks over several levels."""
    rows = spark.createDataFrame([(*r, "x", 0) for r in made_rows()], "conv_id long, turn long, role string, text string, key string, row int").repartition(5)
    got = repair.repair_conversations(rows, long=long, block=block, fan=fan)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(made_rows())


def test_empty(spark):
    rows = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair.repair_conversations(rows).count() == 0


def test_query_over_all_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in op12_glr_repair(spark, sf_dir).collect()), key=repr) == plain(rows)
