"""The fold over streams: order, restarts, size of its state, timers and TTL; and the fold's index of failures against a plain search."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from braidline.operators.trace_fold import TraceFold, completes, operation_key
from braidline.sources import trajectories
from braidline.streaming.traces import stream_traces

SCHEMA = "session_id string, ordinal bigint, message string"
ARGUMENTS = [{"id": 1}, {"id": 2}, {"id": 1, "note": "x"}, {"zip": "", "city": "b"}, {"zip": "9", "city": "b"}, {"zip": None, "city": "b", "n": 1}, {"city": "b", "zip": "9", "n": True}, {"deep": {"key": 1.0, "gap": ""}}, {"deep": {"key": 1, "gap": "y"}}, {}]


def story(seed, exchanges):
    """Calls and results of two tools, with failures, repeated and missing results, and results without a call."""
    draw, out, asked = random.Random(seed), [{"role": "system", "content": "be kind"}, {"role": "user", "content": "go"}], []
    for i in range(exchanges):
        out.append({"role": "assistant", "content": draw.choice([None, "next"]), "tool_calls": [{"id": f"c{i}", "name": draw.choice(["look", "set_it"]), "arguments": draw.choice(ARGUMENTS)}]})
        asked.append(f"c{i}")
        for _ in range(draw.choice([0, 1, 1, 1, 2])):
            bad = draw.random() < 0.4
            out.append({"role": "tool", "id": draw.choice([asked[-1], asked[-1], draw.choice(asked[-6:]), "?" if i % 5 == 0 else asked[-1]]), "content": "error: no" if bad else '{"ok": true}'})
    return out


def rows_of(sessions, exchanges=40):
    return [(s, i, json.dumps(m)) for n, s in enumerate(sessions) for i, m in enumerate(story(n, exchanges), 1)]


def run(spark, source, state, out, until=None, **more):
    """What is in the folder goes through the query, one file a micro-batch; a state folder that was used before is gone on with.

    until: with timers there is no end, so the query runs until this holds.
    """
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
    writer = stream_traces(stream, **more).writeStream.format("json").option("path", out).option("checkpointLocation", state)
    query = (writer.trigger(availableNow=True) if until is None else writer.trigger(processingTime="200 milliseconds")).start()
    if until is None:
        assert query.awaitTermination(120)
    else:
        end = time.time() + 60
        while not until(query):
            assert query.isActive and time.time() < end
            time.sleep(0.5)
        query.stop()
    assert query.exception() is None
    return query


@pytest.fixture
def stream_session(spark):
    """Few state stores: each costs a start."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def put(spark, source, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(source)


def traced(spark, folder):
    frame = spark.read.schema(trajectories.TRACE).json(folder)
    return sorted(tuple(map(str, r)) for r in frame.collect())


def test_out_of_order_batches_and_a_restart_equal_batch(stream_session, tmp_path):
    spark, draw = stream_session, random.Random(7)
    rows = rows_of("pqr")
    mixed = draw.sample(rows, len(rows))
    source, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    third = len(mixed) // 3
    put(spark, source, mixed[:third])
    put(spark, source, mixed[third : 2 * third])
    run(spark, source, state, out)
    some = traced(spark, out)
    put(spark, source, mixed[2 * third :])
    run(spark, source, state, out)  # a new query over the same checkpoint
    want = sorted(tuple(map(str, r)) for r in trajectories.traces(spark.createDataFrame(rows, SCHEMA)).collect())
    assert len(some) < len(want) and traced(spark, out) == want
    put(spark, source, mixed[:3])  # messages that come again change nothing
    run(spark, source, state, out)
    again = [r for r in traced(spark, out) if r[1] == "late"]
    assert len(again) == 3 and [r for r in traced(spark, out) if r[1] != "late"] == want


def test_state_stays_flat_over_many_exchanges(stream_session, tmp_path):
    """10,000 exchanges in five micro-batches: with a horizon the keys held do not grow, and batch with the same horizon agrees."""
    spark = stream_session
    rows = [("s", i, json.dumps(m)) for i, m in enumerate(story(3, 10_000), 1)]
    source, size = str(tmp_path / "in"), len(rows) // 5 + 1
    for i in range(0, len(rows), size):
        put(spark, source, rows[i : i + size])
    query = run(spark, source, str(tmp_path / "state"), str(tmp_path / "out"), horizon=100)
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators and p.numInputRows]
    assert len(held) == 5 and max(held[1:]) < 1.2 * held[0] and max(held) < 20_000, held
    want = trajectories.traces(spark.createDataFrame(rows, SCHEMA), horizon=100)
    assert traced(spark, str(tmp_path / "out")) == sorted(tuple(map(str, r)) for r in want.collect())


def test_gaps_ends_and_ttl(stream_session, tmp_path):
    spark = stream_session
    source, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    call = lambda i: {"role": "assistant", "tool_calls": [{"id": f"c{i}", "name": "look", "arguments": {"id": 1}}]}
    answer = lambda i: {"role": "tool", "id": f"c{i}", "content": '{"ok": true}'}
    nodes = lambda q: {r.ordinal for r in spark.read.schema(trajectories.TRACE).json(out).where("kind = 'node'").collect()}
    times = {"wait": 3000, "idle": 3_600_000, "ttl": 1}
    put(spark, source, [("g", 1, json.dumps(call(1))), ("g", 2, json.dumps(answer(1))), ("g", 4, json.dumps(call(2))), ("g", 5, json.dumps(answer(2)))])
    seen = []

    def until(query):
        if (tmp_path / "out").exists():
            seen.append(nodes(query))
        return {4, 5} <= (seen or [set()])[-1]

    run(spark, source, state, out, until, **times)
    assert {1, 2} in seen and seen[-1] == {1, 2, 4, 5}  # the rest waited for the third message
    assert spark.read.schema(trajectories.TRACE).json(out).where("edge_type = 'superseded_by'").isEmpty()  # the first success was forgotten
    put(spark, source, [("g", 3, json.dumps(call(9)))])
    late = lambda q: [r.ordinal for r in spark.read.schema(trajectories.TRACE).json(out).where("kind = 'late'").collect()]
    run(spark, source, state, out, lambda q: late(q) == [3], **times)


def test_idle_sessions_end(stream_session, tmp_path):
    spark = stream_session
    source, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    put(spark, source, rows_of("z", 5))
    held = lambda q: [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    query = run(spark, source, state, out, lambda q: held(q) and held(q)[-1] == 0, idle=2000)
    assert max(held(query)) > 10


class Plain:
    """The rules for retries by looking through all open failures."""

    def __init__(self):
        self.open, self.calls = [], {}

    def call(self, call_id, tool, arguments):
        signature = [tool, json.dumps(arguments, sort_keys=True)]
        key = operation_key(tool, arguments)
        for kind, fits in (("exact_signature", lambda f: f[1] == signature), ("structural_operation", lambda f: f[2] == key), ("argument_completion", lambda f: f[1][0] == tool and completes(f[3], arguments))):
            found = next((f for f in reversed(self.open) if fits(f)), None)
            if found:
                break
        self.calls[call_id] = (call_id, signature, key, arguments, found)
        return (found[0], call_id, kind) if found else None

    def result(self, call_id, negative):
        me = self.calls[call_id]
        if me[4]:
            self.open = [f for f in self.open if f[0] != me[4][0]]
        if negative:
            self.open = [f for f in self.open if f[1] != me[1]] + [me[:4]]


@pytest.mark.parametrize("seed", range(6))
def test_index_of_failures_equals_a_search(seed):
    draw, fold, plain, of, asked = random.Random(seed), TraceFold("s"), Plain(), {}, []
    got, want = [], []
    for i in range(400):
        if asked and draw.random() < 0.5:
            c, negative = draw.choice(asked[-5:]), draw.random() < 0.6
            fold.feed(2 * i, {"role": "tool", "id": c, "content": "x"}, negative, "negative" if negative else "positive")
            plain.result(c, negative)
        else:
            tool, arguments = draw.choice("ab"), draw.choice(ARGUMENTS)
            asked.append(f"c{i}")
            nodes, edges = fold.feed(2 * i, {"role": "assistant", "tool_calls": [{"id": f"c{i}", "name": tool, "arguments": arguments}]})
            of[next(n[0] for n in nodes if n[1] == "tool_call")] = f"c{i}"
            got += [(of[e[0]], of[e[1]], e[4]) for e in edges if e[2] == "retried_by"]
            want += filter(None, [plain.call(f"c{i}", tool, arguments)])
    assert got == want and len({g[2] for g in got}) == 3
