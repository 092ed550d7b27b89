"""Typed flattening and the replay under tool effects, against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from braidline.functions.flatten import deepest, flat_rows, flattened, nesting
from braidline.operators import replay

TEXTS = ['{"b":{"z":1,"a":[1,2.50,{"q":null,"p":"x"}]},"a.b":"{[","t":true,"e":{},"l":[]}', "[1,[2,[3]]]", '"s"', "7", "1e3", "null", "not json", None, '{"k":"a \\" ] b"}', "{}", "", '{"big":12345678901234567890123,"f":1.0,"i":-1}']


def by_hand(value, way, path=""):
    if isinstance(value, dict):
        return [x for k in sorted(value) for x in by_hand(value[k], way, f"{path}.{k}" if path else k)]
    if isinstance(value, list):
        return [(path, "list", json.dumps(value, separators=(",", ":")).replace("2.50", "2.5"))] if way == "arguments" else [x for i, v in enumerate(value) for x in by_hand(v, way, f"{path}[{i}]")]
    if value is None:
        return [] if way == "scalars" else [(path, "null", "null")]
    kind = "boolean" if isinstance(value, bool) else "integer" if isinstance(value, int) else "number" if isinstance(value, float) else "string"
    return [(path, kind, str(value) if kind in ("number", "string") else json.dumps(value))]


@pytest.mark.parametrize("way", ["arguments", "scalars", "leaves"])
def test_flattened_by_hand(spark, way):
    """Document order with sorted keys; what is no JSON gives null, and rows without entries none."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, j string")
    got = {r.i: r.f for r in df.select("i", flattened(F.col("j"), way, deepest(df, "j")).alias("f")).collect()}
    for i, text in enumerate(TEXTS):
        try:
            value = json.loads(text or "")
        except ValueError:
            assert got[i] is None, text
            continue
        sort = lambda v: {k: sort(v[k]) for k in sorted(v)} if isinstance(v, dict) else [sort(x) for x in v] if isinstance(v, list) else v
        assert [tuple(x) for x in got[i]] == by_hand(sort(value), way), text
    assert flat_rows(df.where("i = 9"), "j", way, "i").count() == 0


def test_nesting_ignores_brackets_in_strings(spark):
    rows = [('{"a":"[[[{{"}', 1), ("[[],[[]]]", 3), ("x", 0), (None, 0), ('"\\"[["', 0), ('{"k":"\\\\","l":[]}', 2)]
    for r in spark.createDataFrame(rows, "t string, n int").select("t", "n", nesting(F.col("t")).alias("got")).collect():
        assert r.got == r.n, r.t


def test_registry_faults(spark):
    effects = spark.createDataFrame([("a", "read", "x", [], [], [], "complete", False, []), ("b", "write", "x", [], [], [], "none", False, []), ("c", "sing", "x", [], [], [], "whole", True, []), ("a", "query", "x", [], [], [], "none", False, [])], replay.EFFECTS)
    assert sorted(tuple(r) for r in replay.registry_faults(effects).collect()) == [("a", "tool is there twice"), ("b", "a write or handoff keeps its receipt"), ("c", "unsupported effect: sing"), ("c", "unsupported snapshot: whole")]


def leaves(v):
    return [x for y in (v.values() if isinstance(v, dict) else v) for x in leaves(y)] if isinstance(v, (dict, list)) else [v]


def replayed(calls, effects, referenced):
    """The rules, one session at a time and by looking at every later call."""
    of, out = {e[0]: e for e in effects}, {}
    for session in {c[0] for c in calls}:
        rows = sorted((c for c in calls if c[0] == session), key=lambda c: c[1])
        versions = {}

        def key(c):
            e, given = of.get(c[3]), json.loads(c[4]) if c[4] else {}
            return "" if e is None or not e[3] or any(given.get(k) in (None, "") for k in e[3]) else json.dumps([[k, given[k]] for k in e[3]])

        def named(a, b):
            return a[3] in of and b[3] in of and of[a[3]][2] == of[b[3]][2] and key(a) == key(b) and (not of[a[3]][3] or key(a) != "")

        for i, c in enumerate(rows):
            later, e = rows[i + 1 :], of.get(c[3])
            first = lambda keep: next((x for x in later if keep(x)), None)  # noqa: B023, E731
            if e is None or c[5] is None:
                out[c[:2]] = ("uncertain", "unknown", None, [])
                continue
            seen = versions.setdefault((e[2], key(c)), {})
            at = [f"{f}:v{seen.get(f, 0)}" for f in e[4]]
            if (session, c[2]) in referenced:
                out[c[:2]] = ("live_critical", "active", None, at)
            elif e[7] or c[7]:
                for f in e[5]:
                    seen[f] = seen.get(f, 0) + c[6]
                out[c[:2]] = ("live_critical", "audit_required", None, at)
            elif not c[6]:
                r = first(lambda x: x[3] == c[3] and key(x) == key(c) and x[6])  # noqa: B023
                out[c[:2]] = ("safe_to_evict", "resolved", r[1], at) if r else ("live_critical", "active", None, at)
            else:
                try:
                    value = json.loads(c[5])
                except ValueError:
                    value = c[5]
                value = next(iter(value.values())) if isinstance(value, dict) and len(value) == 1 else value
                scalar = value if isinstance(value, (str, int, float)) and not isinstance(value, bool) else None
                used = None if scalar is None else first(lambda x: scalar in leaves(json.loads(x[4])) if x[4] else False)  # noqa: B023
                new = first(lambda x: x[3] == c[3] and named(c, x) and x[6] and e[6] == "complete")  # noqa: B023
                wrote = first(lambda x: x[3] in of and of[x[3]][1] == "write" and x[6] and named(c, x) and ("*" in e[4] or set(e[4]) & set(of[x[3]][8])))  # noqa: B023
                if used:
                    out[c[:2]] = ("safe_to_evict", "consumed", used[1], at)
                elif new:
                    out[c[:2]] = ("safe_to_evict", "superseded", new[1], at)
                elif wrote and "*" not in e[4] and set(e[4]) <= set(of[wrote[3]][8]):
                    out[c[:2]] = ("safe_to_evict", "invalidated", wrote[1], at)
                elif wrote:
                    out[c[:2]] = ("uncertain", "unknown", wrote[1], at)
                else:
                    out[c[:2]] = ("live_noncritical", "active", None, at)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_by_hand(spark, seed):
    draw = random.Random(seed)
    fields = ["f", "g", "h"]
    some = lambda: draw.sample(fields, draw.randint(0, 3))
    effects = [(f"t{i}", draw.choice(["read", "lookup", "write", "write"]), draw.choice(["u", "o"]), draw.choice([[], ["id"], ["id", "n"]]), draw.choice([some(), ["*"]]), some(), draw.choice(["complete", "partial"]), draw.random() < 0.3, some()) for i in range(7)]
    values = [1, 2, "1", True, None, "", 1.5, {"id": 1}, [2, "x"]]
    calls = [
        (s, o, f"s{s}.{o}", draw.choice([e[0] for e in effects] + ["none"]), draw.choice([json.dumps({k: draw.choice(values) for k in draw.sample(["id", "n", "z"], 2)}), "{}"]), draw.choice([None, "1", '"x"', "x", '{"a":1.5}', '{"a":1,"b":2}', '{"a":[1]}', "true", '{"a":"1"}']), draw.random() < 0.7, draw.random() < 0.1)
        for s in range(12)
        for o in range(1, 16)
    ]
    referenced = {(c[0], c[2]) for c in calls if draw.random() < 0.05}
    table = spark.createDataFrame(calls, "session_id long, ordinal long, span_id string, tool_name string, arguments string, result string, successful boolean, side_effect boolean")
    out = replay.replay(table, spark.createDataFrame(effects, replay.EFFECTS), spark.createDataFrame(sorted(referenced), "session_id long, span_id string"))
    assert {(r.session_id, r.ordinal): (r.disposition, r.reason, r.target, r.versions) for r in out.collect()} == replayed(calls, effects, referenced)


def test_replay_of_nothing(spark):
    empty = spark.createDataFrame([], "session_id long, ordinal long, span_id string, tool_name string, arguments string, result string, successful boolean, side_effect boolean")
    assert replay.replay(empty, spark.createDataFrame([], replay.EFFECTS)).collect() == []
