"""Points where a user's own code comes in: vectorised functions of six kinds, policies, and a table function for spans.

What is made here is an ordinary column function: pass it to the operator that asks for one, or register it and name it in SQL text. Each gets
Arrow batches, never single rows, and its result is checked for length. Rows that have no value where a kind needs one
are not passed on; their result is null, or false for a predicate.

========== ========================================= ============ =======================================
kind       gets                                      gives        asked for by
========== ========================================= ============ =======================================
counter    a Series of texts                         counts       sources.graphs.retokenized
scorer     a frame of the columns named              scores       operators.context.scored
relevance  a frame of the columns named              booleans     operators.lifecycle.infer_profiles
archive    a Series of digests                       payloads     readable()
backend    a Series of prompts                       answers      any DataFrame of prompts
evaluator  a frame of the columns named              rewards      operators.runs
========== ========================================= ============ =======================================

Risk models are columns of a frame too: pass a scorer's column as the probability of checks.risk_mask. A policy is a function of
(nodes, budget) that gives a view; policies() lists those of the library and the user's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row

#: The type that a kind gives, whether it gets a frame, and what rows without a value give.
KINDS = {"counter": ("long", False), "scorer": ("double", True), "relevance": ("boolean", True), "archive": ("string", False), "backend": ("string", False), "evaluator": ("double", True)}


def vectorised(kind: str, f: Callable) -> Callable[..., Column]:
    """A column function of a user's code. Counters, archives and backends take one column; the others any number, which arrive as a frame
    under their own names."""
    result, framed = KINDS[kind]

    def checked(given, out):
        out = pd.Series(out)
        if len(out) != len(given):
            raise ValueError(f"a {kind} gave {len(out)} values for {len(given)} rows")
        out.index = given.index
        return out

    if framed:

        def over(rows: pd.DataFrame) -> pd.Series:
            out = checked(rows, f(rows)) if len(rows) else pd.Series([], dtype=object)
            return out.fillna(False).astype(bool) if kind == "relevance" else out.astype("float64")
    else:

        def over(values: pd.Series) -> pd.Series:
            some = values[values.notna()]
            # Equal values of a batch are asked for once.
            once = some.drop_duplicates()
            found = dict(zip(once, checked(once, f(once)), strict=True)) if len(once) else {}
            return pd.Series([found[v] if there else None for v, there in zip(values, values.notna(), strict=True)], dtype=object)

    made = F.pandas_udf(over, result)

    def call(*columns: Column | str) -> Column:
        columns = tuple(F.col(c) if isinstance(c, str) else c for c in columns)
        if not framed:
            (one,) = columns
            return made(one)
        return made(F.struct(*columns))

    call.udf = made
    return call


def register(spark: SparkSession, name: str, kind: str, f: Callable) -> Callable[..., Column]:
    """vectorised(), known to SQL text by that name too; kinds that get a frame are given a named_struct there."""
    call = vectorised(kind, f)
    spark.udf.register(name, call.udf)
    return call


def readable(archive: DataFrame, read: Callable[..., Column]) -> DataFrame:
    """The digests (digest, `sha256:` and hex) whose payload an archive reader gives back unharmed: what liveness.analyze takes as its archive."""
    return archive.where(F.concat(F.lit("sha256:"), F.sha2(read("digest"), 256)) == F.col("digest")).select("digest").distinct()


_POLICIES: dict[str, Callable[[DataFrame, int | None], DataFrame]] = {}


def policy(name: str) -> Callable[[Callable], Callable]:
    """Decorator: a context policy of the user's, under a name that is not taken."""

    def add(f: Callable[[DataFrame, int | None], DataFrame]) -> Callable:
        if name in policies():
            raise ValueError(f"policy {name} is there already")
        _POLICIES[name] = f
        return f

    return add


def policies() -> dict[str, Callable[[DataFrame, int | None], DataFrame]]:
    from braidline.operators import context

    return context.POLICIES | _POLICIES


class SpanGroups:
    """A table function: the spans of a session, from its nodes in order of their messages.

    Rows: session_id, node_id, node_type, ordinal, and call, the node of the call that a result answers. A message is given out as soon as it is
    complete, so what a partition holds is its calls and the messages whose result came before its call, not the session.
    """

    CALLS, RESULTS = ("tool_call", "mcp_call"), ("observation", "error")

    def __init__(self) -> None:
        self.session, self.at, self.ordinal = None, {}, None
        self.message: list[tuple] = []
        self.early: list[list[tuple]] = []

    def eval(self, row: Row) -> Iterator[tuple]:
        self.session = row["session_id"]
        if row["ordinal"] is None:
            if row["call"] is not None and row["node_type"] in self.RESULTS:
                self.early.append([(row["node_id"], row["node_type"], None, row["call"])])
            else:
                yield self._row("unmapped_event", row["node_id"], row["node_id"])
            return
        if row["ordinal"] != self.ordinal:
            yield from self._given()
            self.ordinal = row["ordinal"]
        self.message.append((row["node_id"], row["node_type"], row["ordinal"], row["call"]))
        if row["node_type"] in self.CALLS:
            self.at[row["node_id"]] = row["ordinal"]

    def terminate(self) -> Iterator[tuple]:
        yield from self._given()
        for message in self.early:
            yield from self._spans(message)

    def _given(self) -> Iterator[tuple]:
        message, self.message = self.message, []
        if any(kind in self.RESULTS and call is not None and call not in self.at for _, kind, _, call in message):
            self.early.append(message)
        else:
            yield from self._spans(message)

    def _spans(self, message: list[tuple]) -> Iterator[tuple]:
        """A message belongs to the exchange of each of its calls and of the call of each of its results; without any it is its own."""
        found = {ordinal for _, kind, ordinal, _ in message if kind in self.CALLS} | {self.at[call] for _, kind, _, call in message if kind in self.RESULTS and call in self.at}
        for node, _, ordinal, _ in message:
            for at in sorted(found):
                yield self._row("tool_exchange", at, node)
            if not found:
                yield self._row("message", ordinal, node) if ordinal is not None else self._row("unmapped_event", node, node)

    def _row(self, kind: str, at, node: str) -> tuple:
        text = "\x1f".join((kind, str(self.session), str(at)))
        return self.session, "span_" + hashlib.sha256(text.encode()).hexdigest()[:24], kind, node


def register_span_groups(spark: SparkSession, name: str = "span_groups", session: str = "bigint") -> None:
    """`SELECT * FROM span_groups(TABLE(...) PARTITION BY session_id ORDER BY ordinal)`: (session_id, span_id, span_type, node_id)."""
    spark.udtf.register(name, F.udtf(SpanGroups, returnType=f"session_id {session}, span_id string, span_type string, node_id string"))
