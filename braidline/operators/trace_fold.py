"""Exact derivation of a trace from messages, one session at a time.

A session's messages in order are folded into nodes and edges. What a message means depends on which failures
are still open, so this is a state machine and not a join. Its state is keyed (calls by id; open failures by
signature, by operation and by an argument; latest successes by operation), each message touches a few keys whatever the
session holds, and a store decides where keys live: in dictionaries for a batch, in a state store for a stream. A
later message never changes what an earlier one gave.
"""

from __future__ import annotations

import json
import re
from typing import Any

from braidline.functions.text import ACTING
from braidline.schema import NEGATIVE_OUTCOMES

# Arguments that identify or only control an operation.
IDENTIFYING = re.compile(r"(^id$|_id$|^ids$|_ids$|number$|reference$|confirmation_code$|email$|username$)")
CONTROL = frozenset(("confirm", "confirmation", "confirmed", "confirmation_status", "dry_run", "force", "page", "page_size", "limit", "offset"))

NODE_FIELDS = ("node_id", "node_type", "content", "step_id", "ordinal", "token_count", "tool_name", "operation_key", "call_id", "semantic_outcome", "side_effect")
EDGE_FIELDS = ("source", "target", "edge_type", "confidence", "match_type")


# Made once: json.dumps makes one for each call that asks for anything but its defaults.
_SORTED = json.JSONEncoder(ensure_ascii=False, sort_keys=True, default=str)
_AS_IS = json.JSONEncoder(ensure_ascii=False, default=str)


def dump(value: Any) -> str:
    return _SORTED.encode(value)


def parsed(content: Any) -> Any:
    """JSON text as its value, other text as it is."""
    if isinstance(content, str) and content.lstrip()[:1] in ("{", "[", '"'):
        try:
            return json.loads(content)
        except ValueError:
            return content
    return content


def tokens(value: Any) -> int:
    text = value if isinstance(value, str) else "" if value is None else _AS_IS.encode(value)
    return (len(text.encode()) + 3) // 4


def paths(arguments: dict[str, Any]) -> list[tuple[str, Any]]:
    """(path, value) of everything in nested objects that is not itself one, sorted by path; lists are values."""
    found, todo = [], [((), arguments)]
    while todo:
        names, value = todo.pop()
        if isinstance(value, dict):
            todo += [((*names, str(k)), v) for k, v in value.items()]
        else:
            found.append((".".join(names), value))
    return sorted(found, key=lambda x: x[0])


def operation_key(tool: str, arguments: dict[str, Any]) -> str:
    """What an operation is about, by the first of these that there are: identifying arguments, identifying ones further in, whatever does not merely control it."""
    name = lambda path: path.rpartition(".")[2].lower()
    inner = paths(arguments) if arguments else []
    tiers = (
        [(k, arguments[k]) for k in sorted(arguments) if IDENTIFYING.search(k.lower())],
        [x for x in inner if IDENTIFYING.search(name(x[0]))],
        [x for x in inner if name(x[0]) not in CONTROL],
    )
    return dump({"tool_name": tool.lower(), "identity": next(filter(None, tiers), [])})


def completes(before: dict[str, Any], after: dict[str, Any]) -> bool:
    """Whether after keeps all that before gives, something at least, and otherwise only fills gaps."""
    gap = lambda v: v is None or v == "" or v == [] or v == {}
    old, new = dict(paths(before)), dict(paths(after))
    given = {k: v for k, v in old.items() if not gap(v)}
    filled = {k for k, v in new.items() if not gap(v)} - given.keys()
    kept = all(k in new and new[k] == v for k, v in given.items())
    still = all(k in old and k in new and old[k] == new[k] for k in (old.keys() | new.keys()) - given.keys() - filled)
    return bool(given) and bool(filled) and kept and still


def given(arguments: dict[str, Any]) -> list[str]:
    """A text for each argument that has a value, the same for equal values; sorted by path."""

    def like(v: Any) -> Any:  # 1, 1.0 and true are equal
        return [like(x) for x in v] if isinstance(v, list) else {k: like(x) for k, x in v.items()} if isinstance(v, dict) else float(v) if isinstance(v, (bool, int, float)) and abs(v) < 2**53 else v

    return [dump([path, like(v)]) for path, v in paths(arguments) if v not in (None, "", [], {})]


class Memory:
    """Keyed state of a session in dictionaries: maps of text keys, and lists."""

    def __init__(self) -> None:
        self.maps: dict[str, dict[str, Any]] = {}
        self.lists: dict[str, list] = {}

    def get(self, name: str, key: str) -> Any:
        return self.maps.get(name, {}).get(key)

    def put(self, name: str, key: str, value: Any, fresh: bool = False) -> None:
        self.maps.setdefault(name, {})[key] = value

    def drop(self, name: str, key: str) -> None:
        self.maps.get(name, {}).pop(key, None)

    def items(self, name: str) -> list:
        return self.lists.get(name, [])

    def append(self, name: str, value: Any) -> None:
        self.lists.setdefault(name, []).append(value)

    def clear(self, name: str) -> None:
        self.lists.pop(name, None)

    def size(self) -> int:
        return sum(map(len, self.maps.values())) + sum(map(len, self.lists.values()))


#: Maps and lists of a session's state.
MAPS, LISTS = ("at", "calls", "turns", "failed", "open", "by_key", "by_argument", "ok"), ("constraints", "recent")


class TraceFold:
    """feed() takes messages in order and returns the (nodes, edges) that each adds.

    horizon: a call is forgotten once so many calls and results have come since it was made or last answered, and a still later result of it
    counts as one whose call was not recorded; without a horizon none is forgotten. Batch and stream agree if they have the same.
    """

    def __init__(self, session: str, store: Memory | None = None, horizon: int | None = None) -> None:
        self.session, self.s, self.horizon = session, store or Memory(), horizon

    def _id(self, kind: str, ordinal: int, index: int = 0) -> str:
        return f"{self.session}:{ordinal}:{kind}:{index}"

    def _count(self, name: str) -> int:
        """The next number of a counter, from 1."""
        n = (self.s.get("at", name) or 0) + 1
        self.s.put("at", name, n)
        return n

    def feed(self, ordinal: int, message: dict[str, Any], failed: bool = False, meaning: str = "inconclusive") -> tuple[list[tuple], list[tuple]]:
        """failed, meaning: of a result, whether its transport failed and what it says, see functions.text."""
        nodes: list[tuple] = []
        edges: list[tuple] = []
        s, step = self.s, int(message.get("turn_idx") or ordinal)
        role, content = str(message.get("role") or "").lower(), message.get("content")

        def node(kind: str, value: Any, cost: int | None = None, index: int = 0, **more: Any) -> str:
            made = self._id(kind, ordinal, index)
            row = {"node_id": made, "node_type": kind, "content": value if isinstance(value, str) else dump(value), "step_id": step, "ordinal": ordinal, "token_count": tokens(value) if cost is None else cost, "side_effect": False} | more
            nodes.append(tuple(map(row.get, NODE_FIELDS)))
            return made

        def edge(source: str, target: str, kind: str, confidence: float = 1.0, match: str | None = None) -> None:
            edges.append((source, target, kind, confidence, match))

        if role == "system":
            if content:
                s.append("constraints", node("constraint", content))
            return nodes, edges
        if role == "user":
            turn = self._count("users")
            if content:
                node("subgoal" if turn > 1 else "goal", content)
        calls = message.get("tool_calls") or []
        if role in ("assistant", "agent") and (content or calls):
            made = node("decision", content if content is not None else {"tool_calls": calls})
            for result, negative in s.items("recent"):
                edge(result, made, "blocks" if negative else "supports", 0.5)
            s.clear("recent")
            s.put("at", "decision", made)
        for i, call in enumerate(calls):
            self._call(call, i, step, node, edge)
        if role == "tool":
            self._result(message, node, edge, failed, meaning)
        return nodes, edges

    def _call(self, call: dict[str, Any], i: int, step: int, node, edge) -> None:
        s = self.s
        function = call.get("function") or {}
        tool = str(call.get("name") or function.get("name") or "unknown_tool")
        arguments = parsed(call.get("arguments", function.get("arguments") or {}))
        arguments = arguments if isinstance(arguments, dict) else {"value": arguments}
        call_id = str(call.get("id") or f"turn_{step}_call_{i}")
        acts, key = tool.lower().startswith(ACTING), operation_key(tool, arguments)
        made = node("tool_call", {"tool_name": tool, "arguments": arguments, "call_id": call_id}, tokens(arguments), i, tool_name=tool, operation_key=key, call_id=call_id, side_effect=acts)
        signature = dump([tool, dump(arguments)])
        failure, kind, confidence = self._retried(tool, signature, key, arguments)
        if failure:
            edge(failure["call"], made, "retried_by", confidence, kind)
            self._hold(failure["call"])
        self._forget(call_id)
        self._keep(call_id, {"call": made, "tool": tool, "signature": signature, "key": key, "arguments": arguments, "retries": failure and failure["call"], "retried": failure and failure["signature"], "turn": None})
        if decision := s.get("at", "decision"):
            edge(decision, made, "leads_to")
        if acts:
            for c in s.items("constraints"):
                edge(c, made, "blocks", 0.5)

    def _retried(self, tool: str, signature: str, key: str, arguments: dict[str, Any]) -> tuple[dict | None, str, float]:
        """The open failure that a call tries again: the same call, else the latest of the same operation, else the latest that it completes."""
        s = self.s
        latest = lambda signatures: max((s.get("open", x) for x in signatures), key=lambda f: f["number"], default=None)
        if same := s.get("open", signature):
            return same, "exact_signature", 1.0
        if same := latest(s.get("by_key", key) or []):
            return same, "structural_operation", 0.8
        near = {x for g in given(arguments) for x in s.get("by_argument", dump([tool, g])) or []}
        return latest(x for x in near if completes(s.get("open", x)["arguments"], arguments)), "argument_completion", 0.9

    def _places(self, failure: dict[str, Any]) -> list[tuple[str, str]]:
        """Where an open failure is indexed: by its operation, and by the first argument that a completing call has to repeat."""
        first = given(failure["arguments"])[:1]
        return [("by_key", failure["key"]), *[("by_argument", dump([failure["tool"], g])) for g in first]]

    def _open(self, failure: dict[str, Any]) -> None:
        s = self.s
        self._close(failure["signature"])
        s.put("open", failure["signature"], failure | {"number": self._count("failures")})
        for name, place in self._places(failure):
            s.put(name, place, [*(s.get(name, place) or []), failure["signature"]])
        self._hold(failure["call"])

    def _close(self, signature: str, call: str | None = None) -> None:
        """The signature's failure is no longer open; with a call, only if it is that call's."""
        s, failure = self.s, self.s.get("open", signature)
        if failure is None or call not in (None, failure["call"]):
            return
        s.drop("open", signature)
        for name, place in self._places(failure):
            if left := [x for x in s.get(name, place) or [] if x != signature]:
                s.put(name, place, left)
            else:
                s.drop(name, place)
        self._release(failure["call"])

    def _hold(self, call: str) -> None:
        """A call's failures are needed once more: by its record, by its being open, by a call that tries it again."""
        held = self.s.get("failed", call) or {"holds": 0, "results": []}
        self.s.put("failed", call, held | {"holds": held["holds"] + 1})

    def _release(self, call: str) -> None:
        held = self.s.get("failed", call)
        if held and held["holds"] > 1:
            self.s.put("failed", call, held | {"holds": held["holds"] - 1})
        elif held:
            self.s.drop("failed", call)

    def _keep(self, call_id: str, call: dict[str, Any]) -> None:
        """Store the record of a call; it takes the last turn of those that are remembered, and the one beyond the horizon goes."""
        s = self.s
        if self.horizon is not None:
            if call["turn"]:
                s.drop("turns", str(call["turn"]))
            call["turn"] = self._count("turns")
            s.put("turns", str(call["turn"]), call_id, fresh=True)
        s.put("calls", call_id, call)
        if self.horizon is not None and (old := s.get("turns", str(call["turn"] - self.horizon))) is not None:
            self._forget(old)

    def _forget(self, call_id: str) -> None:
        """The record of a call goes, and what only it needed."""
        call = self.s.get("calls", call_id)
        if call is None:
            return
        self.s.drop("calls", call_id)
        if call["turn"]:
            self.s.drop("turns", str(call["turn"]))
        if call.get("failing"):
            self._release(call["call"])
        if call["retries"]:
            self._release(call["retries"])

    def _result(self, message: dict[str, Any], node, edge, failed: bool, meaning: str) -> None:
        s, content = self.s, message.get("content")
        call_id = str(message.get("id") or message.get("tool_call_id") or "")
        call = s.get("calls", call_id)
        if call is None:  # a result whose call was not recorded
            made = node("tool_call", {"tool_name": "unknown_tool", "arguments": {}, "call_id": call_id}, 1, tool_name="unknown_tool", call_id=call_id)
            call = {"call": made, "tool": "unknown_tool", "signature": dump(["unknown_tool", "{}"]), "key": operation_key("unknown_tool", {}), "arguments": {}, "retries": None, "retried": None, "turn": None}
        payload = parsed(content)
        negative = meaning in NEGATIVE_OUTCOMES
        made = node("error" if failed else "observation", payload, tool_name=call["tool"], call_id=call_id, semantic_outcome=meaning)
        edge(call["call"], made, "failed_with" if failed else "produces")
        before = s.get("failed", call["retries"]) if call["retries"] else None
        if before:
            for prior in before["results"]:
                ends = "superseded_by" if negative and not prior["ended"] else "resolved_by" if not negative and (prior["error"] or meaning == "positive") else None
                if ends:
                    edge(prior["result"], made, ends)
                    prior["ended"] = True
            s.put("failed", call["retries"], before)
            self._close(call["retried"], call["retries"])
        if negative:
            if not call.get("failing"):
                self._hold(call["call"])
                call["failing"] = True
            held = s.get("failed", call["call"])
            s.put("failed", call["call"], held | {"results": [*held["results"], {"result": made, "error": failed, "ended": False}]})
            self._open({k: call[k] for k in ("call", "tool", "signature", "key", "arguments")})
        else:
            if latest := s.get("ok", call["key"]):
                edge(latest, made, "superseded_by")
            s.put("ok", call["key"], made)
        s.append("recent", [made, failed or negative])
        self._keep(call_id, call)
