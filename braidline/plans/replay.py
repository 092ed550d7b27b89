"""Queries of typed flattening and of the replay under tool effects, over calls whose JSON is made of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidline.functions.flatten import flat_rows
from braidline.operators import graph, replay
from braidline.plans.exchanges import EX
from braidline.plans.registry import Registry
from braidline.sources.adapters import event_exchanges

R = Registry()

#: Nested arguments of an event: gaps, lists in objects and objects in lists.
_JSON = """'{"id":' || k || ',"note":"' || tool_name || '","opt":' || CASE k % 4 WHEN 0 THEN 'null' WHEN 1 THEN '{}' WHEN 2 THEN '[]' ELSE '""' END || ',"who":{"user":' || session_id || ',"tags":["' || tool_name || '",' || k || '.5,{"deep":[' || ordinal || ',true]}]}}'"""
_TREE = f"""{EX}, j AS (SELECT session_id, ordinal, {_JSON} AS j FROM ex),
tr AS (SELECT session_id, ordinal, regexp_replace(t.fullkey, '^\\$\\.?', '') AS path, t.type AS kind, t.value AS v FROM j, json_tree(CAST(j AS JSON)) AS t),
ty AS (SELECT session_id, ordinal, path, CASE kind WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'null' END AS type, CASE WHEN kind = 'VARCHAR' THEN v ->> '$' WHEN kind = 'NULL' OR v IS NULL THEN 'null' ELSE CAST(v AS VARCHAR) END AS value FROM tr)"""


def _json(t):
    return event_exchanges(t("events")).selectExpr("session_id", "ordinal", f"{_JSON} AS j")


@R.add("flat_arguments", f"WITH {_TREE} SELECT * FROM ty WHERE type <> 'object' AND NOT contains(path, '[')")
def flat_arguments(t):
    """Objects gone into, lists whole."""
    return flat_rows(_json(t), "j", "arguments", "session_id", "ordinal")


@R.add("flat_scalars", f"WITH {_TREE} SELECT * FROM ty WHERE type IN ('string', 'integer', 'number', 'boolean')")
def flat_scalars(t):
    """List members by index; no nulls, no empty containers."""
    return flat_rows(_json(t), "j", "scalars", "session_id", "ordinal")


@R.add("flat_leaves", f"WITH {_TREE} SELECT * FROM ty WHERE type NOT IN ('object', 'list')")
def flat_leaves(t):
    """As scalars, with nulls."""
    return flat_rows(_json(t), "j", "leaves", "session_id", "ordinal")


@R.add(
    "typed_first_use",
    f"""WITH {_TREE}, d AS (SELECT DISTINCT session_id, type AS kind, value, ordinal FROM ty WHERE path = 'who.tags[2].deep[0]' OR path = 'who.tags[1]'), u AS (SELECT session_id, type AS kind, value, ordinal FROM ty WHERE path IN ('id', 'who.user') OR path = 'who.tags[1]')
SELECT d.session_id, d.kind, d.value, d.ordinal, min(u.ordinal) AS used_at FROM d LEFT JOIN u ON u.session_id = d.session_id AND u.kind = d.kind AND u.value = d.value AND u.ordinal > d.ordinal GROUP BY ALL""",
)
def typed_first_use(t):
    """Use and definition over flattened leaves: what a call returns deep in a list, and the first later call that names it with the same type."""
    leaves = flat_rows(_json(t), "j", "scalars", "session_id", "ordinal").withColumnRenamed("type", "kind")
    number, deep = F.col("path") == "who.tags[1]", F.col("path") == "who.tags[2].deep[0]"
    return graph.first_use(leaves.where(number | deep), leaves.where(number | F.col("path").isin("id", "who.user")))


#: tool, effect, entity type, its keys, fields read, fields written, snapshot, receipt, fields that a write invalidates.
EFFECTS = [
    ("click", "read", "account", ["account"], ["name", "email"], [], "complete", False, []),
    ("view", "lookup", "account", ["account"], ["balance", "email"], [], "partial", False, []),
    ("scan", "query", "account", ["account"], ["*"], [], "partial", False, []),
    ("purchase", "write", "account", ["account"], ["balance"], ["balance", "email"], "none", True, ["balance", "email"]),
    ("signup", "write", "account", ["account"], [], ["name"], "none", True, ["name"]),
    ("error", "read", "system", [], ["state"], [], "complete", False, []),
]
_CALLS = {
    "tool_name": "CASE WHEN event_id % 23 = 0 THEN 'mystery' WHEN tool_name = 'view' AND event_id % 5 = 0 THEN 'scan' ELSE tool_name END",
    "arguments": """'{"account":' || CASE WHEN event_id % 19 = 0 THEN 'null' WHEN event_id % 13 = 0 THEN '"' || k % 5 || '"' ELSE k % 5 || '' END || ',"refs":[' || k || ',"r' || k || '",' || CASE WHEN event_id % 17 = 0 THEN 'true' ELSE 'null' END || ']}'""",
    "result": """CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 7 = 0 THEN '{"token":' || (k + 1) || '}' WHEN event_id % 7 = 1 THEN 'r' || (k + 2) WHEN event_id % 7 = 2 THEN '{"token":{"inner":' || k || '}}' ELSE '{"a":1,"b":[2]}' END""",
    "successful": "event_id % 11 <> 0",
}
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
_EF = "ef(tool_name, effect, entity_type, entity_keys, read_scope, write_scope, snapshot, receipt, invalidation) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {_LIST(d)}, {_LIST(e)}, {_LIST(f)}, '{g}', {str(h).lower()}, {_LIST(i)})" for a, b, c, d, e, f, g, h, i in EFFECTS) + ")"
#: The eight rules in SQL, over later calls of the same session.
_REPLAY = f"""{EX}, {_EF},
c AS (SELECT session_id, ordinal, 'x' || event_id AS span_id, side_effect AND event_id % 3 = 0 AS side_effect, event_id % 31 = 0 AS referenced, {", ".join(f"{v} AS {k}" for k, v in _CALLS.items())} FROM (SELECT * FROM ex)),
x AS (SELECT c.*, ef.* EXCLUDE (tool_name), effect IS NOT NULL AND result IS NOT NULL AS known,
  CASE WHEN effect IS NULL OR len(entity_keys) = 0 OR json_extract(arguments, '$.account') IS NULL OR CAST(json_extract(arguments, '$.account') AS VARCHAR) IN ('null', '""') THEN '' ELSE '["account"]' || CAST(json_extract(arguments, '$.account') AS VARCHAR) END AS entity,
  CASE WHEN result LIKE 'r%' THEN 's' || result WHEN json_type(result, '$.token') IN ('UBIGINT', 'BIGINT') THEN 'n' || CAST(CAST(json_extract_string(result, '$.token') AS DOUBLE) AS VARCHAR) END AS scalar,
  ['n' || CAST(CAST(json_extract_string(arguments, '$.refs[0]') AS DOUBLE) AS VARCHAR), 's' || json_extract_string(arguments, '$.refs[1]'), CASE WHEN json_extract_string(arguments, '$.refs[2]') = 'true' THEN 'n1.0' END,
   CASE json_type(arguments, '$.account') WHEN 'VARCHAR' THEN 's' || json_extract_string(arguments, '$.account') WHEN 'NULL' THEN NULL ELSE 'n' || CAST(CAST(json_extract_string(arguments, '$.account') AS DOUBLE) AS VARCHAR) END] AS uses
  FROM c LEFT JOIN ef ON ef.tool_name = c.tool_name),
y AS (SELECT x.*, (entity <> '' OR len(entity_keys) = 0) AS named FROM x),
p AS (SELECT a.session_id, a.ordinal,
  min(b.ordinal) FILTER (b.effect IS NOT NULL AND b.tool_name = a.tool_name AND b.entity = a.entity AND b.successful) AS retry,
  min(b.ordinal) FILTER (list_contains(b.uses, a.scalar)) AS consumer,
  min(b.ordinal) FILTER (a.named AND b.tool_name = a.tool_name AND b.entity = a.entity AND b.successful AND a.snapshot = 'complete' AND b.snapshot = 'complete') AS replacement,
  min(b.ordinal) FILTER (a.named AND b.effect = 'write' AND b.successful AND b.entity_type = a.entity_type AND b.entity = a.entity AND (list_contains(a.read_scope, '*') OR list_has_any(a.read_scope, b.invalidation))) AS invalidator
  FROM y a JOIN y b ON b.session_id = a.session_id AND b.ordinal > a.ordinal GROUP BY a.session_id, a.ordinal),
v AS (SELECT r.session_id, r.ordinal, string_agg(r.field || ':v' || r.n, ',' ORDER BY r.pos) AS versions FROM (SELECT a.session_id, a.ordinal, f.pos, a.read_scope[f.pos] AS field,
  (SELECT count(*) FROM y b WHERE b.session_id = a.session_id AND b.ordinal < a.ordinal AND b.known AND NOT b.referenced AND (b.receipt OR b.side_effect) AND b.successful AND b.entity_type = a.entity_type AND b.entity = a.entity AND list_contains(b.write_scope, a.read_scope[f.pos])) AS n
  FROM y a, unnest(range(1, len(a.read_scope) + 1)) AS f(pos) WHERE a.known) r GROUP BY ALL),
z AS (SELECT y.*, retry, consumer, replacement, invalidator, coalesce(versions, '') AS versions, i.invalidation AS covers FROM y LEFT JOIN p USING (session_id, ordinal) LEFT JOIN v USING (session_id, ordinal) LEFT JOIN y i ON i.session_id = y.session_id AND i.ordinal = p.invalidator),
w AS (SELECT *, CASE WHEN NOT known THEN 1 WHEN referenced THEN 2 WHEN receipt OR side_effect THEN 3 WHEN NOT successful AND retry IS NULL THEN 4 WHEN NOT successful THEN 5 WHEN consumer IS NOT NULL AND scalar IS NOT NULL THEN 6 WHEN replacement IS NOT NULL THEN 7
  WHEN invalidator IS NOT NULL AND NOT list_contains(read_scope, '*') AND list_has_all(covers, read_scope) THEN 8 WHEN invalidator IS NOT NULL THEN 9 ELSE 10 END AS step FROM z),
verdict AS (SELECT *, ['uncertain', 'live_critical', 'live_critical', 'live_critical', 'safe_to_evict', 'safe_to_evict', 'safe_to_evict', 'safe_to_evict', 'uncertain', 'live_noncritical'][step] AS disposition,
  ['unknown', 'active', 'audit_required', 'active', 'resolved', 'consumed', 'superseded', 'invalidated', 'unknown', 'active'][step] AS reason, CASE step WHEN 5 THEN retry WHEN 6 THEN consumer WHEN 7 THEN replacement WHEN 8 THEN invalidator WHEN 9 THEN invalidator END AS target FROM w)"""


def calls(t):
    """(calls, effects, referenced spans)."""
    rows = event_exchanges(t("events")).selectExpr("session_id", "ordinal", "event_id", "'x' || event_id AS span_id", "side_effect AND event_id % 3 = 0 AS side_effect", *[f"{v} AS {k}" for k, v in _CALLS.items()])
    effects = rows.sparkSession.createDataFrame(EFFECTS, replay.EFFECTS)
    return rows.drop("event_id"), effects, rows.where("event_id % 31 = 0").select("session_id", "span_id")


@R.add("effect_replay", f"WITH {_REPLAY} SELECT session_id, ordinal, span_id, disposition, reason, target, entity, versions FROM verdict")
def effect_replay(t):
    """All eight rules, with partial invalidation, wildcards, entities that cannot be told and references."""
    out = replay.replay(*calls(t))
    return out.select("session_id", "ordinal", "span_id", "disposition", "reason", "target", "entity", F.array_join("versions", ",").alias("versions"))


@R.add(
    "offline_projection",
    f"""WITH {_REPLAY}, g AS (SELECT session_id, (ordinal - 1) // 2 AS group_id, bool_and(disposition = 'safe_to_evict') AS goes, count(*) FILTER (disposition = 'safe_to_evict') AS safe, count(*) AS n, sum(length(arguments) + coalesce(length(result), 0)) AS chars FROM verdict GROUP BY ALL)
SELECT session_id, CAST(coalesce(sum(n) FILTER (goes), 0) AS BIGINT) AS evicted, CAST(coalesce(sum(safe) FILTER (NOT goes), 0) AS BIGINT) AS deferred, CAST(coalesce(sum(chars) FILTER (NOT goes), 0) AS BIGINT) AS chars_left FROM g GROUP BY session_id""",
)
def offline_projection(t):
    """What contexts would cost without the exchanges that are safe: two calls share a message, and go together or not at all."""
    rows, effects, referenced = calls(t)
    verdicts = replay.replay(rows, effects, referenced)
    group = F.floor((F.col("ordinal") - 1) / 2)
    messages = rows.select("session_id", "ordinal", F.concat(F.col("arguments"), F.coalesce("result", F.lit(""))).alias("message"))
    spans = rows.select("session_id", group.alias("group_id"), "span_id", F.array(group * 2 + 1, group * 2 + 2).alias("ordinals"))
    stay, report = replay.forbidden_projection(messages, spans, verdicts)
    left = stay.where("never_send_to_provider").groupBy("session_id").agg(F.sum(F.char_length("message")).alias("chars_left"))
    return report.join(left, "session_id", "left").select("session_id", F.size("evicted").cast("bigint").alias("evicted"), F.size("deferred").cast("bigint").alias("deferred"), F.coalesce("chars_left", F.lit(0)).alias("chars_left"))
