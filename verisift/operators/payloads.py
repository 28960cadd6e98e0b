"""Event types and their payloads' schemas as data: a table says which paths a type's version has, and events are held against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.functions.parse import strict_json
from verisift.operators.documents import kind, nodes

#: Rules up to which the registry is broadcast; above it the join is shuffled.
BROADCAST_RULES = 100_000
TYPE = ["event_type", "event_version"]


def type_name(node: Column) -> Column:
    """text, integer, number, boolean or null of a scalar; object or array of an empty one."""
    k = kind(node)
    names = {"STRING": "text", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "BOOLEAN": "boolean", "VOID": "null"}
    out = F.lower(k)
    for known, name in names.items():
        out = F.when(k == known, name).otherwise(out)
    return out


def violations(events: DataFrame, registry: DataFrame, key: str = "event_id", payload: str = "payload") -> DataFrame:
    """(key, gate, path) of what events(key, event_type, event_version, payload) break of registry(event_type, event_version, path, type, required).

    type_unknown: no rule has the event's type and version; payload_invalid: not JSON; missing:
    a required path isn't there or is null; type: a path has a value of another type, whole
    numbers being numbers too; unexpected: a path that no rule has. Places in lists are written
    [], and each is held against the rule. Versions of one type stand side by side. Keys must be unique.
    """
    rules = registry.select(*TYPE, "path", F.col("type").alias("_type"), "required")
    rules = F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules
    none, types = F.lit(None).cast("string").alias("path"), rules.select(*TYPE).distinct()
    unknown = events.join(types, TYPE, "left_anti").select(key, F.lit("type_unknown").alias("gate"), none)
    known = events.join(types, TYPE, "left_semi")
    invalid = known.filter(strict_json(F.col(payload)).isNull()).select(key, F.lit("payload_invalid").alias("gate"), none)
    asked = known.filter(strict_json(F.col(payload)).isNotNull())

    place = F.regexp_replace("path", r"\[[0-9]+\]", "[]")
    held = nodes(asked, key, payload, open_fields=True).select(key, place.alias("path"), type_name(F.col("node")).alias("_held")).filter("path <> ''")
    held = held.groupBy(key, "path").agg(F.collect_set("_held").alias("_held"))
    wanted = asked.select(key, *TYPE).join(rules, TYPE).select(key, "path", "_type", "required")
    both = wanted.join(held, [key, "path"], "full")
    values = F.filter("_held", lambda x: x != "null")
    fits = lambda x: (x == F.col("_type")) | ((x == "integer") & (F.col("_type") == "number"))
    broken = (
        F.when(F.col("_type").isNull(), "unexpected")
        .when(F.col("required") & (F.col("_held").isNull() | (F.size(values) == 0)), "missing")
        .when(F.coalesce(F.exists(values, lambda x: ~fits(x)), F.lit(False)), "type")
    )
    return both.select(key, broken.alias("gate"), "path").filter("gate IS NOT NULL").unionByName(unknown).unionByName(invalid)


def divided(events: DataFrame, registry: DataFrame, key: str = "event_id", payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """The events that keep to the registry, and those that don't, with their violations as an array."""
    told = violations(events, registry, key, payload).groupBy(key).agg(F.sort_array(F.collect_set(F.struct("gate", "path"))).alias("violations"))
    return events.join(told, key, "left_anti"), events.join(told, key)
