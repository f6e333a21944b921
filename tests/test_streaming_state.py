"""Streams with state, over several batches, against plain loops."""

import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quarry.streaming import state

DAY = dt.datetime(2024, 1, 1)
SCHEMA = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64())])


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


def written(folder, batches):
    """A folder of tables, a file for each batch, read in this order."""
    os.makedirs(folder / "events.parquet")
    for i, rows in enumerate(batches):
        path = folder / f"events.parquet/part-{i}.parquet"
        pq.write_table(pa.Table.from_pylist([dict(zip(SCHEMA.names, (*r, 1.0))) for r in rows], SCHEMA), path)
        os.utime(path, (1_700_000_000 + 10 * i,) * 2)
    return str(folder)


# A batch's rows are late by the watermark of the batch before it.
def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made_batches(seed, users=4, n=400, jitter=40):
    """Events a few minutes apart that come up to `jitter` minutes out of order."""
    rnd = random.Random(seed)
    rows = [(i, at(i * 7 + rnd.random()), rnd.randrange(users), rnd.choice(["view", "click", "purchase", "error"])) for i in range(n)]
    rows.sort(key=lambda r: r[1] + dt.timedelta(minutes=rnd.random() * jitter))
    return [rows[i : i + 60] for i in range(0, n, 60)]


def until(batches):
    last = max(r[1] for b in batches for r in b)
    return last.replace(microsecond=last.microsecond // 1000 * 1000) - dt.timedelta(hours=1)


def plain_funnels(rows, hours, settled):
    out, now = [], {}
    for _, ts, user, kind in sorted((r for r in rows if r[1] <= settled), key=lambda r: (r[1], state.STEPS.index(r[3]) if r[3] in state.STEPS else 9)):
        if user in now and ts > now[user][0] + dt.timedelta(hours=hours):
            out.append((user, *now.pop(user), None))
        if user not in now:
            if kind == "view":
                now[user] = (ts, None)
        elif kind == "click" and now[user][1] is None:
            now[user] = (now[user][0], ts)
        elif kind == "purchase" and now[user][1]:
            out.append((user, *now.pop(user), ts))
    out += [(user, *f, None) for user, f in now.items() if f[0] + dt.timedelta(hours=hours) <= settled]
    return sorted(((u, s, c, p, p or s + dt.timedelta(hours=hours)) for u, s, c, p in out), key=repr)


@pytest.mark.parametrize("hours", [1, 6])
def test_funnels_over_batches(spark, tmp_path, hours):
    batches, progress = made_batches(hours), []
    got = rows_of(state.funnels(spark, written(tmp_path, batches), hours, files_per_batch=1, progress=progress))
    want = plain_funnels([r for b in batches for r in b], hours, until(batches))
    assert got == want and any(r[3] for r in want) and any(not r[3] for r in want)
    # Of 400 events no more than the watermark's delay and a funnel for each user are kept.
    kept = [p.stateOperators[0].numRowsTotal for p in progress]
    assert len(progress) > 6 and max(kept) < 150 and sum(p.stateOperators[0].numRowsDroppedByWatermark for p in progress) == 0


def test_funnels_drop_late_rows_and_time_out(spark, tmp_path):
    batches = [[(1, at(0), 1, "view"), (2, at(0), 2, "view")], [(3, at(300), 3, "error")], [(8, at(301), 3, "error")], [(4, at(10), 1, "click"), (5, at(250), 2, "click")], [(6, at(255), 2, "purchase"), (7, at(900), 3, "error")]]
    got = rows_of(state.funnels(spark, written(tmp_path, batches), 5, files_per_batch=1))
    assert got == [(1, at(0), None, None, at(300)), (2, at(0), at(250), at(255), at(255))]


def test_funnels_take_an_event_at_the_watermark(spark, tmp_path):
    batches = [[(1, at(0), 1, "view"), (2, at(10), 1, "click"), (3, at(240), 1, "purchase"), (4, at(160), 2, "error")], [(5, at(300), 2, "error")]]
    got = rows_of(state.funnels(spark, written(tmp_path, batches), 5, files_per_batch=1))
    assert got == [(1, at(0), at(10), at(240), at(240))]


def test_funnels_set_timers_by_users_not_by_events(spark, tmp_path):
    rnd, progress = random.Random(5), []
    rows = [(i, at(i * 0.2 + rnd.random()), int(i % 300 == 0), rnd.choice(["view", "click", "purchase"])) for i in range(state.PACKED + 2_000)]
    rnd.shuffle(rows)
    batches = [rows, [(-1, at(len(rows) * 0.2 + 60), 2, "error")]]
    got = rows_of(state.funnels(spark, written(tmp_path, batches), 1, files_per_batch=1, progress=progress))
    assert got == plain_funnels(rows, 1, until(batches)) and {r[0] for r in got} == {0, 1} and len(got) > 100
    # For each of two values of many events and each rest one timer, and one for an open funnel.
    timers = [p.stateOperators[0].customMetrics for p in progress]
    assert 2 <= sum(m["numRegisteredTimers"] for m in timers) <= 12
    assert sum(m["numExpiredTimers"] for m in timers) <= 12


def plain_pairs(rows, settled):
    hour, out = dt.timedelta(hours=1), []
    for i, ts, user, kind in rows:
        if kind == "click":
            found = [(j, t) for j, t, u, k in rows if k == "purchase" and u == user and ts < t <= ts + hour]
            out += [(i, user, ts, j, t) for j, t in found]
            if not found and ts + hour <= settled:
                out.append((i, user, ts, None, None))
    return sorted(out, key=repr)


def test_join_over_batches_and_eviction(spark, tmp_path):
    batches, progress = made_batches(3), []
    got = rows_of(state.click_purchases(spark, written(tmp_path, batches), files_per_batch=1, progress=progress))
    assert got == plain_pairs([r for b in batches for r in b], until(batches))
    assert {r[3] is None for r in got} == {True, False}
    ops = [p.stateOperators[0] for p in progress]
    assert sum(o.numRowsRemoved for o in ops) > 100 and max(o.numRowsTotal for o in ops) < 100
    assert ops[-1].numRowsTotal <= 20  # clicks of the last two hours, purchases of the last


def test_join_drops_late_rows(spark, tmp_path):
    batches = [[(1, at(0), 1, "click")], [(2, at(300), 2, "error")], [(7, at(301), 2, "error")], [(3, at(30), 1, "purchase"), (4, at(301), 2, "click")], [(5, at(330), 2, "purchase"), (6, at(700), 3, "error")]]
    got = rows_of(state.click_purchases(spark, written(tmp_path, batches), files_per_batch=1))
    assert got == [(1, 1, at(0), None, None), (4, 2, at(301), 5, at(330))]


def test_repeats_within_and_beyond_the_watermark(spark, tmp_path):
    progress = []
    batches = [[(1, at(0), 1, "view"), (1, at(0), 1, "view")], [(1, at(30), 1, "view"), (2, at(50), 1, "view")], [(3, at(500), 1, "view")], [(3, at(500), 1, "view")], [(1, at(501), 1, "view"), (3, at(505), 1, "view"), (4, at(20), 1, "view")], [(5, at(900), 1, "view")]]
    folder = written(tmp_path, batches)
    got = rows_of(state.distinct_events(spark, folder, files_per_batch=1, progress=progress))
    # 1 comes again long after it was forgotten; 4 is too late.
    assert [(r[0], r[3]) for r in got] == [(1, at(0)), (1, at(501)), (2, at(50)), (3, at(500)), (5, at(900))]
    assert progress[-1].stateOperators[0].numRowsTotal == 1
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in progress) == 1


def test_sessions_that_a_later_batch_joins(spark, tmp_path):
    batches = [[(1, at(0), 1, "view"), (2, at(50), 1, "view")], [(3, at(25), 1, "view"), (4, at(60), 2, "view")], [(5, at(400), 2, "view")], [(8, at(401), 2, "view")], [(6, at(1), 1, "view"), (7, at(900), 2, "view")]]
    got = rows_of(state.sessions(spark, written(tmp_path, batches), files_per_batch=1))
    # 0, 25 and 50 are one session of three rows; the late row of minute 1 is dropped.
    assert got == [(1, at(0), at(50), 3), (2, at(60), at(60), 1), (2, at(400), at(401), 2)]


@pytest.mark.parametrize("f", [state.funnels, state.click_purchases, state.distinct_events, state.sessions])
def test_empty_and_null(spark, tmp_path, f):
    assert rows_of(f(spark, written(tmp_path / "empty", [[]]))) == []
    nothing = [(1, None, 1, "view"), (2, at(3), None, "view"), (3, None, None, None)]
    got = rows_of(f(spark, written(tmp_path / "nulls", [nothing, [(9, at(900), 5, "error")]]), files_per_batch=1))
    assert [r[0] for r in got] == ([2, 9] if f is state.distinct_events else [])
