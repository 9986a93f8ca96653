"""Chat formatting with linked tool calls.

Assistant turns may hold calls as JSON between ``<tool_call>`` and ``</tool_call>``; turns of the role ``tool`` hold a
result as JSON with the identifier of its call. Calls and results are hash-joined by conversation and
identifier, ordered so that each result follows its call, checked against the tools'
schemas and serialised as canonical JSON.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALL = r"(?s)<tool_call>(.*?)</tool_call>"
KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value) -> str:
    """Keys sorted, no spaces, no escapes but those JSON needs; not-a-number is refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def faults(value, schema: Mapping, path: str = "$") -> list[str]:
    """What a JSON value breaks of a schema (type, enum, required, properties, additionalProperties, items)."""
    kinds = schema.get("type")
    names = [kinds] if isinstance(kinds, str) else kinds or []
    fits = lambda k: isinstance(value, KINDS[k]) and not (isinstance(value, bool) and k in ("integer", "number"))
    if names and not any(fits(k) for k in names):
        return [f"{path}: not {'/'.join(names)}"]
    out = [f"{path}: not one of the values"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += faults(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unknown")
    if isinstance(value, list) and isinstance(schema.get("items"), Mapping):
        for i, x in enumerate(value):
            out += faults(x, schema["items"], f"{path}[{i}]")
    return out


def _parsed(raw, schemas: Mapping[str, Mapping] | None):
    """id, name, canonical JSON and fault of a call (with schemas) or result."""
    try:
        value = json.loads(raw)
    except (TypeError, ValueError):
        return None, None, None, "not JSON"
    if not isinstance(value, dict):
        return None, None, None, "not an object"
    ident = value.get("id") if schemas is not None else value.get("id", value.get("tool_call_id"))
    ident = None if ident is None else str(ident)
    name = value.get("name") if isinstance(value.get("name"), str) else None
    problem = None
    if schemas is not None:
        if name is None:
            problem = "no name"
        elif name not in schemas:
            problem = "unknown tool"
        else:
            problem = "; ".join(faults(value.get("arguments", {}), schemas[name])) or None
    if ident is None and problem is None:
        problem = "no identifier"
    try:
        return ident, name, canonical(value), problem
    except ValueError:
        return ident, name, None, "not canonical"


FIELDS = "struct<id:string,name:string,json:string,fault:string>"


def _reader(schemas: Mapping[str, Mapping] | None):
    def read(raw):
        import pandas as pd

        return pd.DataFrame([_parsed(x, schemas) for x in raw], columns=["id", "name", "json", "fault"], dtype=object)

    return F.pandas_udf(read, FIELDS)


KEY = ["conv", "turn", "role", "mark", "nth"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """The columns that count. ``conv`` is the conversation as text, ``mark`` a hash of the text and ``nth`` the
    number of a row among equal ones; together they name a row."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.withColumns({"conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "turn": F.coalesce(F.col("turn"), F.lit(2**62)), "mark": F.xxhash64("text")})


def with_calls(turns: DataFrame) -> DataFrame:
    """Rows that make calls or hold results, numbered where they are equal."""
    some = turns.where((F.col("role") == "tool") | ((F.col("role") == "assistant") & F.contains("text", F.lit("<tool_call>"))))
    return some.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "turn", "role", "mark").orderBy(F.lit(1))))


def links(turns: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """Calls and results of ``with_calls``, linked: ``conv, id, a_*`` (row and place of the call), ``b_*`` (row of the
    result), ``call``, ``result``, ``fault``.

    The n-th call of an identifier in a conversation is linked to its n-th result. A call without result and a
    result without call stay, with a fault; so do those that are not JSON or break their tool's schema.
    """
    calls = turns.where("role = 'assistant'").select(*KEY, F.posexplode(F.regexp_extract_all("text", F.lit(CALL), 1)).alias("at", "raw"))
    calls = calls.withColumn("c", _reader(dict(schemas))("raw")).select(*[F.col(k).alias(f"a_{k}") for k in KEY], "at", "raw", F.col("c.id").alias("id"), F.col("c.json").alias("call"), F.col("c.fault").alias("a_fault"))
    results = turns.where("role = 'tool'").withColumn("r", _reader(None)("text")).select(*[F.col(k).alias(f"b_{k}") for k in KEY], F.col("r.id").alias("id"), F.col("r.json").alias("result"), F.col("r.fault").alias("b_fault"))
    a = calls.withColumn("k", F.row_number().over(Window.partitionBy("a_conv", "id").orderBy("a_turn", "at", "call", "a_mark", "a_nth"))).alias("a")
    b = results.withColumn("k", F.row_number().over(Window.partitionBy("b_conv", "id").orderBy("b_turn", "result", "b_mark", "b_nth"))).alias("b")
    joined = a.join(b, (F.col("a_conv") == F.col("b_conv")) & (F.col("a.id") == F.col("b.id")) & (F.col("a.k") == F.col("b.k")), "full")
    fault = F.concat_ws("; ", "a_fault", "b_fault", F.when(F.col("b_turn").isNull(), F.lit("no result")), F.when(F.col("a_turn").isNull(), F.lit("no call")), F.when(F.col("b_turn") <= F.col("a_turn"), F.lit("result before call")))
    return joined.select(F.coalesce("a.id", "b.id").alias("id"), *[f"{x}_{k}" for x in "ab" for k in KEY], "at", "raw", "call", "result", F.when(fault != "", fault).alias("fault"))


def quoted(c: str) -> Column:
    """A string column as JSON; null stays null."""
    wrapped = F.to_json(F.struct(F.col(c).alias("x")))
    return F.when(F.col(c).isNotNull(), F.substring(wrapped, F.lit(6), F.length(wrapped) - 6))


def fields(**values: Column) -> Column:
    """A JSON object with sorted keys; null values are left out."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(values.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def format_chats(conversations: DataFrame, schemas: Mapping[str, Mapping] | None = None) -> DataFrame:
    """``conv_id, turn, place, role, n_calls, n_linked, message``: one row per row of ``conversations``.

    ``message`` is canonical JSON: ``content`` and ``role``; calls are taken out of an assistant's content
    into ``tool_calls`` (each with its ``id``, ``call`` and, where there is one, ``fault``), a result has its ``tool_call_id``,
    canonical content and ``fault``. Sorted by ``turn, place, role, message`` a conversation is in topological order: a result found
    before its call is moved behind it (its turn becomes the call's). Conversations are not gathered, so a hot one is
    no more work for a task than others; ``whole_chats`` puts bounded stretches together.
    Null roles and texts are empty, a null turn comes last (as null), a null conversation is one of its own, repeated rows are
    kept and numbered, extra columns are not read. Empty table: no rows.
    """
    turns = turns_of(conversations)
    special = with_calls(turns)
    linked = links(special, schemas or {})
    ok = F.col("a_turn").isNotNull() & F.col("b_turn").isNotNull()
    item = fields(id=quoted("id"), call=F.coalesce("call", quoted("raw")), fault=quoted("fault"))
    per_call = linked.where("a_turn is not null").groupBy(*[F.col(f"a_{k}").alias(k) for k in KEY]).agg(
        F.sort_array(F.collect_list(F.struct("at", item.alias("item")))).alias("items"), F.count(F.lit(1)).alias("n_calls"), F.sum(ok.cast("long")).alias("n_linked"))
    per_result = linked.where("b_turn is not null").select(*[F.col(f"b_{k}").alias(k) for k in KEY], F.col("id").alias("call_id"), "result", "fault", "a_turn")
    noted = special.join(per_call, KEY, "left").join(per_result, KEY, "left")
    late = F.col("a_turn") >= F.col("turn")
    shown = noted.withColumn("content", F.when(F.col("role") == "assistant", F.regexp_replace("text", CALL, "")).otherwise(F.col("text"))).select(
        "conv_id", F.when(late, F.col("a_turn")).otherwise(F.col("turn")).alias("turn"), F.when(late, 1).otherwise(0).alias("place"), "role",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_linked", F.col("a_turn").isNotNull().cast("long")).alias("n_linked"),
        fields(content=F.coalesce("result", quoted("content")), role=quoted("role"), tool_call_id=quoted("call_id"), fault=F.when(F.col("role") == "tool", quoted("fault")),
               tool_calls=F.when(F.col("items").isNotNull(), F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]")))).alias("message"))
    rest = turns.where(~((F.col("role") == "tool") | ((F.col("role") == "assistant") & F.contains("text", F.lit("<tool_call>")))))
    plain = rest.select("conv_id", "turn", F.lit(0).alias("place"), "role", F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_linked"), fields(content=quoted("text"), role=quoted("role")).alias("message"))
    return plain.unionByName(shown).withColumn("turn", F.when(F.col("turn") < 2**62, F.col("turn")))


def whole_chats(messages: DataFrame, turns: int = 64) -> DataFrame:
    """``conv_id, stretch, messages``: the messages of ``turns`` turns of a conversation as a JSON array."""
    stretch = F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / turns)
    ordered = F.sort_array(F.collect_list(F.struct(F.col("turn").isNull().alias("last"), "turn", "place", "role", "message")))
    return messages.groupBy("conv_id", stretch.alias("stretch")).agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["message"]), ","), F.lit("]")).alias("messages"))
