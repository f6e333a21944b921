"""Conversation structure repair by a generalised LR parser (operator 12).

Roles must spell `(s?(ua)+)?`, as this grammar has it (initials of system, user, assistant):

    S -> nothing | H        H -> u a | s u a | H u a

The parser's stacks share their tails; rows are read one by one, and before each any number
of rows may be inserted. A row is kept (cost 0) or gets the role user or assistant (2), which
shifts its symbol, or is deleted (3), which leaves the stacks as they are. Shifts are followed
by the reductions that they complete. Stacks of equal tops merge, of which the one of the
least (cost, audit) stays; the audit has a letter for each edit: D, I, K or R. In this grammar
a top has one stack below it, so nothing that tells is lost (a test says so).

Audits are compared without being written: all of them read the same rows and end with a
row's edit, so that none begins another, and the order of two longer ones is that of the
audits they come from, or else of what they add. A stretch of rows is therefore summed up by
a small matrix: for each top before it and after it the cost, and the order of the audits.

Conversations of up to LONG rows are solved where their rows meet. Longer ones, which may be
any share of all rows, are numbered by ranges (quarry.operators.grouping.places), cut into
blocks of BLOCK rows whose matrices are multiplied FAN at a time, level by level; what each
block begins and ends with is handed down the same way, and blocks write out their edits.
Only the digest of a repaired conversation, which SHA-256 defines over its text from front to
back, reads one conversation's rows in one task: sorted, one batch at a time.

Edge cases: a null role or text is one space, and so is a null id or turn where it is
hashed. A null id is a conversation. Rows are taken by turn (nulls first), then role and text.
A role of another initial, or of none, can't be kept. A conversation that the damage leaves no
row of has zeros, an empty audit and the digest of the empty text. Rows that repeat are
duplicates. An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, partitions
from quarry.operators.grouping import places

LONG, LONG_CHARS, BLOCK, FAN = 2000, 16_000_000, 2000, 500
WHITE = " \t\n\x0b\x0c\r"
INSERTED = {"u": "user", "a": "assistant"}

# The LR(0) automaton of the grammar: shifts; how much a complete state pops for H; where H goes.
SHIFT = {0: {"s": 1, "u": 2}, 1: {"u": 4}, 2: {"a": 5}, 3: {"u": 6}, 4: {"a": 7}, 6: {"a": 8}}
REDUCE = {5: 2, 7: 3, 8: 3}
GOTO = {0: 3}
ACCEPT = (0, 3)


class Stack(NamedTuple):
    top: int
    below: Stack | None


def after(stack: Stack, symbol: str) -> Stack | None:
    """The stack with the symbol shifted and all that it completes reduced; None if it can't be."""
    to = SHIFT[stack.top].get(symbol)
    if to is None:
        return None
    stack = Stack(to, stack)
    while stack.top in REDUCE:
        for _ in range(REDUCE[stack.top]):
            stack = stack.below
        stack = Stack(GOTO[stack.top], stack)
    return stack


def _stacks() -> list[Stack]:
    """All stacks that rows can lead to, by their tops."""
    found = {0: Stack(0, None)}
    todo = [0]
    for top in todo:
        for symbol in "sua":
            stack = after(found[top], symbol)
            if stack and stack.top not in found:
                found[stack.top] = stack
                todo.append(stack.top)
    return [found[top] for top in sorted(found)]


STACKS = _stacks()
PLACE = {stack.top: i for i, stack in enumerate(STACKS)}
N = len(STACKS)


class Edit(NamedTuple):
    """What to do before and with a row: roles of inserted rows, and D, K or R with the new role."""

    inserts: tuple[str, ...]
    act: str
    role: str | None

    @property
    def word(self) -> str:
        return "I" * len(self.inserts) + self.act


def _chain(stack: Stack) -> Iterator[tuple[Stack, tuple[str, ...]]]:
    """The stacks that inserted rows lead to, until a top comes again, with these rows. One
    symbol at most can be inserted at each."""
    seen, roles = set(), ()
    while stack.top not in seen:
        yield stack, roles
        seen.add(stack.top)
        symbol = next(c for c in INSERTED if after(stack, c))
        stack, roles = after(stack, symbol), (*roles, INSERTED[symbol])


SYMBOLS = "sua"
PLAIN, TRUNCATED, BAD = 0, 1, 2


def _moves(symbol: str, fault: int) -> list[list[tuple[int, int, str, Edit]]]:
    """For each top after a row, (place of the top before it, cost, word, edit), the best for each
    such top. Rows inserted before a deleted one come no cheaper than after it, and sort later."""
    best: dict[tuple[int, int], tuple[int, str, Edit]] = {}

    def offer(before: Stack, to: Stack | None, cost: int, edit: Edit) -> None:
        if to:
            key, value = (PLACE[before.top], PLACE[to.top]), (cost, edit.word, edit)
            best[key] = min(best.get(key, value), value, key=lambda v: v[:2])

    for stack in STACKS:
        offer(stack, stack, 3, Edit((), "D", None))
        for reached, roles in _chain(stack) if fault != BAD else ():
            cost = 2 * len(roles) + (fault == TRUNCATED)
            if symbol in SYMBOLS:
                offer(stack, after(reached, symbol), cost, Edit(roles, "K", None))
            for c, role in INSERTED.items():
                offer(stack, after(reached, c), cost + 2, Edit(roles, "R", role))
    return [[(p, *best[p, t]) for p in range(N) if (p, t) in best] for t in range(N)]


#: By code: three times the symbol's place (3: any other) and the fault.
MOVES = [_moves(symbol, fault) for symbol in [*SYMBOLS, "?"] for fault in (PLAIN, TRUNCATED, BAD)]


def _ends() -> list[tuple[int, tuple[str, ...]]]:
    """For each top, the rows to insert behind the last one."""
    return [next((2 * len(roles), roles) for reached, roles in _chain(stack) if reached.top in ACCEPT) for stack in STACKS]


ENDS = _ends()
NONE = 1 << 40  # the cost of what can't be


def walk(codes: Iterable[int], start: int = 0, keep: bool = True) -> tuple[list[int], list[int], list[list]]:
    """Costs and order of audits at each top after rows of these codes, from the top at place
    `start`; and for each row and top (the top's place before it, edit), if kept."""
    cost, order, back = [NONE] * N, [0] * N, []
    cost[start] = 0
    for code in codes:
        new, came = [NONE] * N, [None] * N
        keys = [(1 << 40, "", t) for t in range(N)]
        for t, moves in enumerate(MOVES[code]):
            least = None
            for p, c, word, edit in moves:
                if cost[p] < NONE and (least is None or (cost[p] + c, order[p], word) < least):
                    least = (cost[p] + c, order[p], word)
                    came[t] = (p, edit)
            if least:
                new[t], keys[t] = least[0], (least[1], least[2], t)
        cost = new
        for i, (_, _, t) in enumerate(sorted(keys)):
            order[t] = i
        if keep:
            back.append(came)
    return cost, order, back


def finish(cost: list[int], order: list[int]) -> int:
    """The place of the top that the cheapest repair has after the last row."""
    return min((p for p in range(N) if cost[p] < NONE), key=lambda p: (cost[p] + ENDS[p][0], order[p]))


def trace(back: list[list], to: int) -> list[Edit]:
    """The edits that lead to the top at place `to` after the last row."""
    edits = []
    for came in reversed(back):
        to, edit = came[to]
        edits.append(edit)
    return edits[::-1]


def repair(codes: list[int]) -> tuple[int, list[Edit], tuple[str, ...]]:
    """Cost, the edit of each row and the roles inserted at the end."""
    cost, order, back = walk(codes)
    to = finish(cost, order)
    return cost[to] + ENDS[to][0], trace(back, to), ENDS[to][1]


class Matrix(NamedTuple):
    """cost[p][t] and order[p][t] of the way from the top at place p to that at t."""

    cost: list[list[int]]
    order: list[list[int]]


def matrix(codes: list[int]) -> Matrix:
    found = [walk(codes, p, keep=False) for p in range(N)]
    return Matrix([f[0] for f in found], [f[1] for f in found])


def through(cost: list[int], order: list[int], m: Matrix) -> tuple[list[int], list[int], list[int]]:
    """Costs and order after another stretch, and the top before it on the way to each."""
    new, via, keys = [NONE] * N, [0] * N, []
    for t in range(N):
        options = [(cost[p] + m.cost[p][t], order[p], p) for p in range(N) if cost[p] < NONE and m.cost[p][t] < NONE]
        if options:
            new[t], first, via[t] = min(options)
            keys.append((first, m.order[via[t]][t], t))
        else:
            keys.append((1 << 40, 0, t))
    order = [0] * N
    for i, (_, _, t) in enumerate(sorted(keys)):
        order[t] = i
    return new, order, via


def multiplied(ms: list[Matrix]) -> Matrix:
    rows = []
    for p in range(N):
        cost, order = ms[0].cost[p], ms[0].order[p]
        for m in ms[1:]:
            cost, order, _ = through(cost, order, m)
        rows.append((cost, order))
    return Matrix([r[0] for r in rows], [r[1] for r in rows])


def route(ms: list[Matrix], start: int, to: int) -> list[tuple[int, int]]:
    """Where each stretch begins and ends on the best way from start to `to`."""
    cost, order, vias = [NONE] * N, [0] * N, []
    cost[start] = 0
    for m in ms:
        cost, order, via = through(cost, order, m)
        vias.append(via)
    ends = []
    for via in reversed(vias):
        ends.append((via[to], to))
        to = via[to]
    return ends[::-1]


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, conv_id, turn, role, text, copies): rows with faults put in by a hash of
    conversation and turn, copies 0 (dropped), 1 or 2."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20
    made = F.when(hit == 1, "").when(hit == 2, F.translate(space(text), ".!?", "")).otherwise(space(text))
    return rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("key"),
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.when(hit == 4, "user").otherwise(space(role)).alias("role"),
        made.alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"),
    )


def _last(text: Column) -> Column:
    """The last character that is no white space; empty if there is none."""
    return F.substring(F.rtrim(text, F.lit(WHITE)), -1, 1)


def _pair_is_legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _code(initial: str, fault: int) -> int:
    place = SYMBOLS.find(initial) if initial else -1
    return 3 * (place if place >= 0 else len(SYMBOLS)) + fault


def _line(edit: Edit, role: str, text: str) -> list[str]:
    lines = [f"{r}:" for r in edit.inserts]
    if edit.act in ("K", "R"):
        lines.append(f"{edit.role or role}:{text}")
    return lines


def _solve(rows: list[tuple[str, str, str]]) -> tuple:
    """(blank, duplicate, truncated, illegal, cost, audit, digest, repaired) of (role, text, last character)."""
    seen, codes, faults = set(), [], [0, 0, 0]
    for role, text, last in rows:
        repeated = (role, text) in seen
        seen.add((role, text))
        kind = 0 if not last else 1 if repeated else 2 if last not in ".!?" else None
        if kind is not None:
            faults[kind] += 1
        codes.append(_code(role[:1], PLAIN if kind is None else TRUNCATED if kind == 2 else BAD))
    illegal = sum(not _pair_is_legal(a[0][:1], b[0][:1]) for a, b in zip(rows, rows[1:]))
    cost, edits, end = repair(codes)
    lines = [line for edit, (role, text, _) in zip(edits, rows) for line in _line(edit, role, text)] + [f"{r}:" for r in end]
    repaired = "\n".join(lines)
    audit = "".join(e.word for e in edits) + "I" * len(end)
    return *faults, illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest()


SOLVED = ["blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_SOLVED = "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _short(rows: DataFrame) -> DataFrame:
    """Conversations whose rows fit into one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            out = []
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text", "last"))):
                if k != key and group:
                    out.append((key, *_solve(group)))
                    group = []
                key = k
                group.append(row)
            yield pa.RecordBatch.from_pylist([dict(zip(["key", *SOLVED], o)) for o in out], _schema(_SOLVED))
        if group:
            yield pa.RecordBatch.from_pylist([dict(zip(["key", *SOLVED], (key, *_solve(group))))], _schema(_SOLVED))

    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = rows.select("key", "turn", "role", "text", _last(F.col("text")).alias("last")).repartition(partitions(rows.sparkSession), "key")
    return dealt.sortWithinPartitions(*order).drop("turn").mapInArrow(run, _SOLVED)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def _table(ddl: str, rows: list[tuple]) -> pa.Table:
    schema = _schema(ddl)
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_EDITS = "key string, row long, inserts array<string>, act string, role string"
_NODES = "key string, block long, cost array<long>, order array<long>, illegal long, first string, last string"


def _matrices(table: pa.Table) -> list[Matrix]:
    cut = lambda v: [v[i : i + N] for i in range(0, N * N, N)]
    return [Matrix(cut(c), cut(o)) for c, o in zip(table.column("cost").to_pylist(), table.column("order").to_pylist())]


def _node(key: str, block: int, m: Matrix, illegal: int, first: str, last: str) -> pa.Table:
    return _table(_NODES, [(key, block, sum(m.cost, []), sum(m.order, []), illegal, first, last)])


def _long(rows: DataFrame, block: int, fan: int) -> DataFrame:
    """Conversations of any number of rows."""
    placed = places(rows.select("key", "turn", "role", "text"), "key", ["turn", "role", "text"])
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    placed = materialize(placed.select("key", F.col("_row").cast("long").alias("row"), "role", "text", _last(F.col("text")).alias("end"), same.alias("same")), "repair-rows")
    first = materialize(placed.groupBy("key", "same").agg(F.min("row").alias("seen")), "repair-seen")
    kind = F.when(F.col("end") == "", 0).when(F.col("row") > F.col("seen"), 1).when(~F.col("end").isin(".", "!", "?"), 2)
    flagged = placed.drop("text").join(first, ["key", "same"]).select("key", "row", F.floor((F.col("row") - 1) / block).alias("block"), F.substring("role", 1, 1).alias("initial"), kind.alias("kind"))
    flagged = materialize(flagged, "repair-faults")
    counted = flagged.groupBy("key").agg(*[F.sum((F.col("kind") == k).cast("long")).alias(c) for k, c in enumerate(SOLVED[:3])])

    def codes_of(table: pa.Table) -> tuple[pa.Table, list[int]]:
        table = table.sort_by("row")
        fault = {None: PLAIN, 0: BAD, 1: BAD, 2: TRUNCATED}
        return table, [_code(c, fault[k]) for c, k in zip(table.column("initial").to_pylist(), table.column("kind").to_pylist())]

    def summed(table: pa.Table) -> pa.Table:
        table, codes = codes_of(table)
        initials = table.column("initial").to_pylist()
        illegal = sum(not _pair_is_legal(a, b) for a, b in zip(initials, initials[1:]))
        return _node(table.column("key")[0].as_py(), table.column("block")[0].as_py(), matrix(codes), illegal, initials[0], initials[-1])

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        firsts, lasts = table.column("first").to_pylist(), table.column("last").to_pylist()
        illegal = sum(table.column("illegal").to_pylist()) + sum(not _pair_is_legal(a, b) for a, b in zip(lasts, firsts[1:]))
        return _node(table.column("key")[0].as_py(), table.column("block")[0].as_py() // fan, multiplied(_matrices(table)), illegal, firsts[0], lasts[-1])

    levels = [materialize(flagged.groupBy("key", "block").applyInArrow(summed, _NODES), "repair-blocks")]
    while levels[-1].where("block > 0").limit(1).count():
        above = levels[-1].groupBy("key", F.floor(F.col("block") / fan)).applyInArrow(joined, _NODES)
        levels.append(materialize(above, "repair-blocks"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ms, out = _matrices(pa.Table.from_batches([batch])), []
            for m in ms:
                to = finish(m.cost[0], m.order[0])
                out.append((to, m.cost[0][to] + ENDS[to][0]))
            made = [pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("illegal"), *made], ["key", "illegal", "to", "cost"])

    whole = materialize(levels[-1].mapInArrow(best, "key string, illegal long, to long, cost long"), "repair-best")
    ends = "key string, block long, start long, to long"

    def handed(below: pa.Table, above: pa.Table) -> pa.Table:
        below = below.sort_by("block")
        found = route(_matrices(below), above.column("start")[0].as_py(), above.column("to")[0].as_py())
        return _table(ends, [(k, b, *f) for k, b, f in zip(below.column("key").to_pylist(), below.column("block").to_pylist(), found)])

    told = whole.select("key", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("start"), "to")
    for level in levels[-2::-1]:
        above = told.select(F.col("key").alias("of_key"), F.col("block").alias("of_block"), "start", "to")
        told = materialize(level.groupBy("key", F.floor(F.col("block") / fan)).cogroup(above.groupBy("of_key", "of_block")).applyInArrow(handed, ends), "repair-ends")

    def edited(below: pa.Table, above: pa.Table) -> pa.Table:
        table, codes = codes_of(below)
        edits = trace(walk(codes, above.column("start")[0].as_py())[2], above.column("to")[0].as_py())
        keys, numbers = table.column("key").to_pylist(), table.column("row").to_pylist()
        return _table(_EDITS, [(k, n, list(e.inserts), e.act, e.role) for k, n, e in zip(keys, numbers, edits)])

    above = told.select(F.col("key").alias("of_key"), F.col("block").alias("of_block"), "start", "to")
    edits = materialize(flagged.groupBy("key", "block").cogroup(above.groupBy("of_key", "of_block")).applyInArrow(edited, _EDITS), "repair-edits")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, digest, begun = None, [], None, False

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"key": key, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}])

        for batch in batches:
            for k, role, text, inserts, act, new in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text", "inserts", "act", "new"))):
                if digest is None or k != key:
                    if digest is not None:
                        yield close()
                    key, audit, digest, begun = k, [], hashlib.sha256(), False
                edit = Edit(tuple(inserts), act, new)
                audit.append(edit.word)
                for line in _line(edit, role, text):
                    digest.update((b"\n" if begun else b"") + line.encode())
                    begun = True
        if digest is not None:
            yield close()

    # The rows inserted at the end are a row of their own.
    closing = F.array(*[F.array(*map(F.lit, ENDS[p][1])).cast("array<string>") for p in range(N)])
    last = whole.select("key", F.lit((1 << 63) - 1).alias("row"), F.lit("").alias("role"), F.lit("").alias("text"), F.get(closing, F.col("to").cast("int")).alias("inserts"), F.lit("").alias("act"), F.lit(None).cast("string").alias("new"))
    lines = placed.select("key", "row", "role", "text").join(edits.withColumnRenamed("role", "new"), ["key", "row"])
    lines = lines.select(last.columns).unionByName(last)
    dealt = lines.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "row").drop("row")
    texts = dealt.mapInArrow(written, "key string, audit string, repaired_sha256 string")
    return counted.join(whole.drop("to"), "key").join(texts, "key").select("key", *SOLVED)


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", long: int = LONG, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of
    each conversation after its damage, see damaged()."""
    every = damaged(rows, conv, turn, role, text)
    turns = F.when(F.col("copies") > 0, F.col("turn"))
    chars = F.col("copies") * (F.length("text") + F.length("role"))
    sizes = every.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"),
        F.sum("copies").alias("n"),
        F.sum(chars.cast("long")).alias("chars"),
        F.coalesce(F.max(turns) - F.min(turns) + 1 - F.count_distinct(turns), F.lit(0)).alias("gaps"),
    )
    sizes = materialize(sizes, "repair-sizes")
    left = every.where("copies > 0").select("key", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")
    large = sizes.where((F.col("n") > long) | (F.col("chars") > LONG_CHARS)).select("key")
    if large.limit(1).count():
        solved = _short(left.join(large, "key", "left_anti")).unionByName(_long(left.join(large, "key", "left_semi"), block, fan))
    else:
        solved = _short(left)
    zero, nothing = F.lit(0).cast("long"), hashlib.sha256(b"").hexdigest()
    found = sizes.join(solved, "key", "left")
    return found.select(
        F.col("conv_id").alias(conv),
        F.col("gaps").cast("long").alias("gaps"),
        *[F.coalesce(c, zero).alias(c) for c in SOLVED[:5]],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
