"""Replay of exchanges under a registry of tool effects: what became of each, by the first of eight rules that holds.

Entities are what a tool's arguments name; fields are what it reads, writes or invalidates. Everything that asks for a first
later event is a minimum over the frame that follows in a window, over exchanges exploded to the fields or values they touch: no row is joined to what
comes after it. All windows are keyed by session first, so a session is the most that one task has to sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidline.functions.flatten import deepest, flattened, value_text, variant_type

EFFECTS = "tool_name string, effect string, entity_type string, entity_keys array<string>, read_scope array<string>, write_scope array<string>, snapshot string, receipt boolean, invalidation array<string>"
KINDS, SNAPSHOTS = ("read", "lookup", "query", "write", "handoff"), ("complete", "partial", "none")


def registry_faults(effects: DataFrame) -> DataFrame:
    """(tool_name, fault) of a registry: unknown effects and snapshots, writes that keep no receipt, tools that are there twice."""
    effects = effects.withColumn("twice", F.count("*").over(Window.partitionBy("tool_name")) > 1)
    faults = F.array(
        F.when(~F.coalesce(F.col("effect").isin(*KINDS), F.lit(False)), F.concat(F.lit("unsupported effect: "), F.coalesce("effect", F.lit("none")))),
        F.when(~F.coalesce(F.col("snapshot").isin(*SNAPSHOTS), F.lit(False)), F.concat(F.lit("unsupported snapshot: "), F.coalesce("snapshot", F.lit("none")))),
        F.when(F.col("effect").isin("write", "handoff") & ~F.coalesce("receipt", F.lit(False)), F.lit("a write or handoff keeps its receipt")),
        F.when(F.col("twice"), F.lit("tool is there twice")),
    )
    return effects.select("tool_name", F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("fault")).distinct()


def entity_key(arguments: Column, keys: Column) -> Column:
    """The named arguments as JSON, key by key; an empty text if one is missing, null or empty, or if no key is asked for."""
    given = F.try_parse_json(arguments).try_cast("map<string,variant>")
    values = F.transform(keys, lambda k: F.to_json(F.try_element_at(given, k)))
    whole = F.forall(values, lambda v: F.coalesce(~v.isin("null", '""'), F.lit(False)))
    named = F.zip_with(keys, values, lambda k, v: F.concat(F.to_json(F.array(k)), v))
    return F.when(F.coalesce(whole, F.lit(False)) & (F.size(keys) > 0), F.array_join(named, ",")).otherwise("")


def _equal(kind: Column, value: Column) -> Column:
    """What two values have in common if they are equal: numbers and booleans compare as numbers, text as text."""
    number = F.when(kind == "boolean", F.when(value == "true", 1.0).otherwise(0.0)).otherwise(value.try_cast("double"))
    return F.when(kind == "string", F.concat(F.lit("s"), value)).otherwise(F.concat(F.lit("n"), number.cast("string")))


def _scalar(result: Column) -> Column:
    """A result's one value: a bare string or number, or that of an object of one key; text that is no JSON is a string itself."""
    bare = F.try_parse_json(result)
    inner = bare.try_cast("map<string,variant>")
    only = F.when(F.size(inner) == 1, F.try_element_at(F.map_values(inner), F.lit(1))).otherwise(bare)
    kind = variant_type(only)
    return F.when(bare.isNull(), F.concat(F.lit("s"), result)).when(kind.isin("string", "integer", "number"), _equal(kind, value_text(only, kind)))


def exchanges(calls: DataFrame, effects: DataFrame) -> DataFrame:
    """calls with their effect, entity, scalar and the values of their arguments.

    calls: (session_id, ordinal, span_id, tool_name, arguments, result, successful, side_effect): one call with its result, in order; the result
    is null where there is not exactly one. effects: EFFECTS, one row a tool: it is broadcast, as a registry is written by hand.
    """
    depth = deepest(calls, "arguments")
    rows = calls.join(F.broadcast(effects), "tool_name", "left")
    rows = rows.withColumn("known", F.col("effect").isNotNull() & F.col("result").isNotNull())
    rows = rows.withColumn("entity", F.when(F.col("effect").isNotNull(), entity_key(F.col("arguments"), F.col("entity_keys"))))
    uses = F.array_distinct(F.transform(F.filter(flattened(F.col("arguments"), "leaves", depth), lambda n: n["type"] != "null"), lambda n: _equal(n["type"], n["value"])))
    return rows.withColumn("scalar", _scalar(F.col("result"))).withColumn("uses", F.coalesce(uses, F.array().cast("array<string>")))


def _named() -> Column:
    """Whether the entity can be told from others: it has a key, or its tool needs none."""
    return (F.col("entity") != "") | (F.size("entity_keys") == 0)


def field_versions(rows: DataFrame) -> DataFrame:
    """(session_id, ordinal, versions): for each field that an exchange reads, how often it was written before with success and a receipt.

    rows: exchanges() with `referenced`. A write counts once the exchange has its receipt kept; one that is referenced explicitly is kept as such.
    """
    retained = F.col("known") & ~F.col("referenced") & (F.col("receipt") | F.col("side_effect"))
    touched = F.concat(
        F.transform(F.col("read_scope"), lambda f: F.struct(f.alias("field"), F.lit(True).alias("reads"), F.lit(0).alias("writes"))),
        F.when(retained & F.col("successful"), F.transform(F.col("write_scope"), lambda f: F.struct(f.alias("field"), F.lit(False).alias("reads"), F.lit(1).alias("writes")))).otherwise(F.array()),
    )
    fields = rows.where("known").select("session_id", "ordinal", "entity_type", "entity", F.posexplode(touched).alias("at", "t")).select("session_id", "ordinal", "entity_type", "entity", "at", "t.*")
    before = Window.partitionBy("session_id", "entity_type", "entity", "field").orderBy("ordinal").rangeBetween(Window.unboundedPreceding, -1)
    fields = fields.withColumn("version", F.coalesce(F.sum("writes").over(before), F.lit(0))).where("reads")
    named = F.transform(F.array_sort(F.collect_list(F.struct("at", "field", "version"))), lambda f: F.concat_ws(":v", f["field"], f["version"]))
    return fields.groupBy("session_id", "ordinal").agg(named.alias("versions"))


def invalidations(rows: DataFrame) -> DataFrame:
    """(session_id, ordinal, invalidator): the first later successful write on the entity that invalidates a field which the exchange reads.

    Reads and writes are exploded to (entity, field); a read of `*` meets every write. The first write after a read is then a minimum
    over what follows in the field's own window, and the exchange's the least of its fields'.
    """
    writes = (F.col("effect") == "write") & F.col("successful")
    reads = F.transform(F.array_distinct("read_scope"), lambda f: F.struct(f.alias("field"), F.lit(True).alias("reads")))
    covers = F.transform(F.array_distinct(F.concat("invalidation", F.array(F.lit("*")))), lambda f: F.struct(f.alias("field"), F.lit(False).alias("reads")))
    # The entity that is read must be told from others; a write without a key of its own meets those that need none.
    touched = F.concat(F.when(_named(), reads).otherwise(F.array()), F.when(writes, covers).otherwise(F.array()))
    fields = rows.where(F.col("effect").isNotNull()).select("session_id", "ordinal", "entity_type", "entity", F.explode(touched).alias("t")).select("session_id", "ordinal", "entity_type", "entity", "t.*")
    after = Window.partitionBy("session_id", "entity_type", "entity", "field").orderBy("ordinal").rangeBetween(1, Window.unboundedFollowing)
    fields = fields.withColumn("at", F.min(F.when(~F.col("reads"), F.col("ordinal"))).over(after)).where("reads")
    return fields.groupBy("session_id", "ordinal").agg(F.min("at").alias("invalidator"))


def consumptions(rows: DataFrame) -> DataFrame:
    """(session_id, ordinal, consumer): the first later exchange whose arguments hold the exchange's scalar, by one sort of definitions and uses."""
    uses = F.transform("uses", lambda u: F.struct(u.alias("value"), F.lit(True).alias("is_use")))
    made = F.when(F.col("known") & F.col("successful") & F.col("scalar").isNotNull(), F.array(F.struct(F.col("scalar").alias("value"), F.lit(False).alias("is_use")))).otherwise(F.array())
    both = rows.select("session_id", "ordinal", F.explode(F.concat(made, uses)).alias("t")).select("session_id", "ordinal", "t.*")
    after = Window.partitionBy("session_id", "value").orderBy("ordinal").rangeBetween(1, Window.unboundedFollowing)
    return both.withColumn("consumer", F.min(F.when(F.col("is_use"), F.col("ordinal"))).over(after)).where(~F.col("is_use")).select("session_id", "ordinal", "consumer")


def replay(calls: DataFrame, effects: DataFrame, referenced: DataFrame | None = None) -> DataFrame:
    """A row for each exchange: session_id, ordinal, span_id, disposition, reason, target, verifier, confidence, entity_type, entity, field_scope, obligations, versions.

    The rules in order: (1) an unknown tool or a span without one call and one result is uncertain; (2) one that is referenced explicitly
    (session_id, span_id of `referenced`) is critical; (3) receipts and side effects are kept; (4) a failure is resolved by the first later success of the same
    tool and entity, else kept for a retry; (5) a result of one value that a later call uses is consumed; (6) a complete snapshot replaces an earlier one; (7) a
    later write on the entity invalidates: wholly, if its scope covers all that was read, else the verdict fails closed; (8) what is left stays, uncritically.
    target is the ordinal of the exchange that decided.
    """
    rows = exchanges(calls, effects)
    if referenced is None:
        rows = rows.withColumn("referenced", F.lit(False))
    else:
        rows = rows.join(referenced.select("session_id", "span_id").distinct().withColumn("referenced", F.lit(True)), ["session_id", "span_id"], "left").withColumn("referenced", F.coalesce("referenced", F.lit(False)))
    after = lambda *keys: Window.partitionBy("session_id", *keys).orderBy("ordinal").rangeBetween(1, Window.unboundedFollowing)
    # A later success counts whether or not its own call and result are whole.
    won = F.when(F.col("effect").isNotNull() & F.col("successful"), F.col("ordinal"))
    rows = rows.withColumns(
        {
            "retry": F.min(won).over(after("tool_name", "entity")),
            "replacement": F.when(_named() & (F.col("snapshot") == "complete"), F.min(F.when(F.col("snapshot") == "complete", won)).over(after("tool_name", "entity"))),
        }
    )
    key = ["session_id", "ordinal"]
    rows = rows.join(field_versions(rows), key, "left").join(invalidations(rows), key, "left").join(consumptions(rows), key, "left")
    # The scope of the write that decided; its tool's row of the registry says it.
    scopes = rows.select("session_id", F.col("ordinal").alias("invalidator"), F.col("invalidation").alias("covers"))
    rows = rows.join(scopes, ["session_id", "invalidator"], "left")
    wholly = ~F.array_contains("read_scope", "*") & (F.size(F.array_except("read_scope", "covers")) == 0)
    nothing, none = F.lit(None).cast("bigint"), F.array().cast("array<string>")

    def rule(disposition: str, reason: str, verifier: str, target: Column = nothing, confidence: float = 1.0, obligations: Column = none) -> Column:
        return F.struct(F.lit(disposition).alias("disposition"), F.lit(reason).alias("reason"), target.alias("target"), F.lit(verifier).alias("verifier"), F.lit(confidence).alias("confidence"), obligations.alias("obligations"))

    must = lambda *names: F.array(*[F.lit(n) for n in sorted(names)])
    ruled = (
        F.when(~F.col("known"), rule("uncertain", "unknown", "unknown_or_ambiguous_tool_span_fail_closed_v1", confidence=0.0))
        .when(F.col("referenced"), rule("live_critical", "active", "explicit_query_reactivation_v1", obligations=must("audit")))
        .when(F.col("receipt") | F.col("side_effect"), rule("live_critical", "audit_required", "side_effect_receipt_retention_v1", obligations=must("receipt", "audit")))
        .when(~F.col("successful") & F.col("retry").isNull(), rule("live_critical", "active", "unresolved_retry_retention_v1", obligations=must("retry")))
        .when(~F.col("successful"), rule("safe_to_evict", "resolved", "successful_retry_resolution_v1", F.col("retry")))
        .when(F.col("consumer").isNotNull(), rule("safe_to_evict", "consumed", "complete_scalar_use_def_consumption_v1", F.col("consumer")))
        .when(F.col("replacement").isNotNull(), rule("safe_to_evict", "superseded", "complete_snapshot_supersession_v1", F.col("replacement")))
        .when(F.col("invalidator").isNotNull() & wholly, rule("safe_to_evict", "invalidated", "complete_field_invalidation_v1", F.col("invalidator")))
        .when(F.col("invalidator").isNotNull(), rule("uncertain", "unknown", "partial_invalidation_fail_closed_v1", F.col("invalidator"), 0.0))
        .otherwise(rule("live_noncritical", "active", "no_terminal_relation_found_v1"))
    )
    scope = F.when(F.size("read_scope") > 0, F.col("read_scope")).otherwise(F.col("write_scope"))
    return rows.select("session_id", "ordinal", "span_id", ruled.alias("d"), F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"), F.coalesce("entity", F.lit("")).alias("entity"), F.coalesce(scope, none).alias("field_scope"), F.coalesce("versions", none).alias("versions")).select("session_id", "ordinal", "span_id", "d.*", "entity_type", "entity", "field_scope", "versions")


def forbidden_projection(messages: DataFrame, spans: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a context would cost without the exchanges that are safe to evict: never to be sent.

    messages: (session_id, ordinal, message); spans: (session_id, group_id, span_id, ordinals): the call spans of each protocol group and the
    message ordinals of that group; verdicts: replay(). A group goes only if every call in it is safe. Returned are the messages that stay,
    each marked never_send_to_provider, and (session_id, evicted, deferred): span ids that go, and safe ones that stay with their group.
    """
    safe = verdicts.where("disposition = 'safe_to_evict'").select("session_id", "span_id", F.lit(True).alias("safe"))
    marked = spans.join(safe, ["session_id", "span_id"], "left").withColumn("safe", F.coalesce("safe", F.lit(False)))
    groups = marked.groupBy("session_id", "group_id").agg(F.min("safe").alias("goes"), F.first("ordinals").alias("ordinals"), F.collect_set("span_id").alias("all"), F.collect_set(F.when(F.col("safe"), F.col("span_id"))).alias("safe"))
    gone = groups.where("goes").select("session_id", F.explode("ordinals").alias("ordinal")).distinct()
    stay = messages.join(gone, ["session_id", "ordinal"], "left_anti").withColumn("never_send_to_provider", F.lit(True))
    ids = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    report = groups.groupBy("session_id").agg(ids(F.when(F.col("goes"), F.col("all"))).alias("evicted"), ids(F.when(~F.col("goes"), F.col("safe"))).alias("deferred"))
    return stay, report
