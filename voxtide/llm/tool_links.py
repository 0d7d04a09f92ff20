"""Chat formatting: links recogniser (tool) calls to their results, orders them and writes canonical JSON.

The library's sessions hold responses (``session_id, seq, text``) and no calls, so calls and results are tables of
their own here, keyed in the same way.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.session import cut_lineage

TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: (isinstance(v, int) and not isinstance(v, bool)) or (isinstance(v, float) and v.is_integer()),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}


def violations(value: Any, schema: Mapping[str, Any], at: str = "$") -> list[str]:
    """What a JSON value breaks of a schema: type, enum, minimum, maximum, required, properties, additionalProperties, items."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(TYPES[k](value) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if TYPES["number"](value):
        found += [f"{at}: {k}" for k, out in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if out]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                found += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        found += [x for i, v in enumerate(value) for x in violations(v, schema["items"], f"{at}[{i}]")]
    return found


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spare characters; whole floats as integers, other characters than ASCII as they are."""

    def plain(v: Any) -> Any:
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1 << 53 else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def strict(text: str | None) -> Any:
    """JSON without NaN, infinities and repeated keys; an error for all else."""

    def once(pairs: list[tuple[str, Any]]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def never(name: str) -> Any:
        raise ValueError(name)

    return json.loads(text or "", object_pairs_hook=once, parse_constant=never)


def judged(tool: str | None, arguments: str | None, schemas: Mapping[str, Mapping[str, Any]]) -> tuple[Any, list[str]]:
    """Arguments as a value (text where they are no JSON), and what is wrong with them."""
    try:
        value = strict(arguments)
    except (ValueError, RecursionError):
        return arguments, ["$: no JSON"]
    return value, violations(value, schemas[tool]) if tool in schemas else ["unknown tool"]


def call_order(calls: DataFrame) -> DataFrame:
    """``session_id, call_id, seq, after`` (one row per call) to ``session_id, call_id, rank, level, cyclic, dangling``.

    Sorted by ``rank, level, seq, call_id``, every call comes after those in ``after``. Logs are mostly in order: then rank
    is ``seq`` and level 0, found by one join. A call before one that it needs takes that one's rank, and so on;
    calls that share a rank and need each other get levels, a layer a round. What no round frees lies on a
    cycle or behind one, and has no level. A call without ``seq`` has the greatest rank of what it needs, if any.
    ``dangling`` counts needed calls that the session lacks.
    """
    heads = calls.select("session_id", "call_id", "seq")
    needs = calls.select("session_id", "call_id", F.explode(F.array_distinct("after")).alias("need")).filter("need IS NOT NULL")
    there = heads.select("session_id", F.col("call_id").alias("need"), F.lit(True).alias("known"))
    edges = cut_lineage(needs.join(there, ["session_id", "need"], "left"))
    missing = edges.filter("known IS NULL").groupBy("session_id", "call_id").agg(F.count(F.lit(1)).alias("dangling"))
    edges = edges.filter("known").select("session_id", "call_id", "need")
    ranks = cut_lineage(heads.withColumn("rank", F.col("seq")))
    while True:
        need = ranks.select("session_id", F.col("call_id").alias("need"), F.col("rank").alias("need_rank"))
        raised = edges.join(need, ["session_id", "need"]).groupBy("session_id", "call_id").agg(F.max("need_rank").alias("least"))
        higher = F.col("least").isNotNull() & (F.col("rank").isNull() | (F.col("least") > F.col("rank")))
        new = ranks.join(raised, ["session_id", "call_id"], "left").withColumn("up", higher)
        new = cut_lineage(new.select("session_id", "call_id", "seq", F.when(F.col("up"), F.col("least")).otherwise(F.col("rank")).alias("rank"), "up"))
        ranks = new.drop("up")
        if new.filter("up").isEmpty():
            break
    own, other = (ranks.select("session_id", F.col("call_id").alias(c), F.col("rank").alias(r)) for c, r in (("call_id", "r1"), ("need", "r2")))
    left = cut_lineage(edges.join(own, ["session_id", "call_id"]).join(other, ["session_id", "need"]).filter("r1 <=> r2").select("session_id", "call_id", "need"))
    levels, level = None, 0
    while not left.isEmpty():
        waiting = left.select("session_id", "call_id").distinct()
        free = left.join(waiting.withColumnRenamed("call_id", "need").withColumn("_w", F.lit(True)), ["session_id", "need"], "left")
        # Free in this round: needs nothing that waits itself.
        ready = free.groupBy("session_id", "call_id").agg(F.max(F.coalesce("_w", F.lit(False))).alias("w")).filter("not w").select("session_id", "call_id")
        level += 1
        ready = cut_lineage(ready.withColumn("level", F.lit(level)))
        if ready.isEmpty():
            stuck = waiting.withColumn("level", F.lit(None).cast("int")).withColumn("cyclic", F.lit(True))
            levels = stuck if levels is None else levels.union(stuck)
            break
        done = ready.withColumn("cyclic", F.lit(False))
        levels = done if levels is None else levels.union(done)
        left = cut_lineage(left.join(ready, ["session_id", "call_id"], "left_anti"))
    out = ranks if levels is None else ranks.join(levels, ["session_id", "call_id"], "left")
    if levels is None:
        out = out.withColumns({"level": F.lit(0), "cyclic": F.lit(False)})
    return out.join(missing, ["session_id", "call_id"], "left").select(
        "session_id",
        "call_id",
        "rank",
        F.when(F.coalesce("cyclic", F.lit(False)), F.lit(None)).otherwise(F.coalesce("level", F.lit(0))).alias("level"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        F.coalesce("dangling", F.lit(0)).cast("bigint").alias("dangling"),
    )


def link_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Calls with their results in topological order, as canonical JSON: one row per call and result.

    ``calls``: ``session_id, seq, call_id, tool, arguments`` (JSON text), ``after`` (ids of calls that it needs, or null);
    ``results``: ``session_id, seq, call_id, content``. Returns ``session_id, call_id, seq, result_seq, status, rank,
    level, cyclic, dangling, valid, errors, message``. ``status`` is linked, pending (no result), orphan (a result
    without call) or repeated (a further call of an id that the session has used: the smallest ``seq`` is the call,
    and the results are its own). Sort a session by ``rank, level, seq, result_seq``.

    ``arguments`` must be strict JSON and satisfy the tool's schema in ``schemas``; ``errors`` says what they break, a
    tool without schema is one of them. ``message`` has the keys arguments, call_id, name and result, sorted.

    Joined by session and call id, so calls of one long session are spread. Null ids of session or call link with
    nothing: such calls are pending, such results orphans. A call without ``seq`` or ``tool`` is a call all the same; its
    tool is unknown, and it sorts by what it needs or has as a result. Null or empty arguments are no JSON; a null content is a
    JSON null. Equal results are returned one by one. Further columns are ignored, empty tables give no rows of
    their side.
    """
    rows = calls.select("session_id", "seq", "call_id", "tool", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    named = F.col("session_id").isNotNull() & F.col("call_id").isNotNull()
    order = ["seq", "tool", "arguments", "after"]
    first = rows.filter(named).groupBy("session_id", "call_id").agg(F.min(F.struct(*order)).alias("c"), F.count(F.lit(1)).alias("n"))
    first = cut_lineage(first.select("session_id", "call_id", "c.*", "n"))
    heads = first.drop("n").join(call_order(first), ["session_id", "call_id"]).withColumn("called", F.lit(True))
    given = results.select("session_id", "call_id", F.col("seq").alias("result_seq"), "content").withColumn("has", F.lit(True))
    linked = heads.drop("after").hint("shuffle_hash").join(given, ["session_id", "call_id"], "full_outer")
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("has"), "linked").otherwise("pending")
    linked = linked.withColumn("status", status).drop("called")
    # Further calls of a used id: all rows of it but one that equals the first.
    again = first.filter("n > 1").select("session_id", "call_id", F.struct(*order).alias("f"))
    further = rows.filter(named).join(again, ["session_id", "call_id"]).groupBy("session_id", "call_id", *order, "f").count()
    copies = F.col("count") - F.when(F.struct(*order).eqNullSafe(F.col("f")), 1).otherwise(0)
    further = further.select("session_id", "call_id", *order, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("count"))).alias("_i"), copies.alias("_c")).filter("_i <= _c")
    loose = further.select("session_id", "call_id", "seq", "tool", "arguments", F.lit("repeated").alias("status")).union(
        rows.filter(~named).select("session_id", "call_id", "seq", "tool", "arguments", F.lit("pending").alias("status"))
    )
    loose = loose.withColumns({"rank": F.col("seq"), "level": F.lit(0), "cyclic": F.lit(False), "dangling": F.lit(0).cast("bigint")})
    every = linked.unionByName(loose, allowMissingColumns=True)
    names = ["session_id", "call_id", "seq", "result_seq", "status", "rank", "level", "cyclic", "dangling"]
    every = every.withColumn("rank", F.coalesce("rank", "seq", "result_seq"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, errors, messages = [], [], []
            for call, state, tool, text, content in zip(*(batch.column(c).to_pylist() for c in ("call_id", "status", "tool", "arguments", "content"))):
                value, wrong = (None, []) if state == "orphan" else judged(tool, text, schemas)
                valid.append(not wrong if state != "orphan" else None)
                errors.append(wrong)
                messages.append(canonical({"arguments": value, "call_id": call, "name": tool, "result": content}))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(messages, pa.string())],
                [*names, "valid", "errors", "message"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in every.schema.fields}
    return every.mapInArrow(write, ", ".join([*(f"{n} {kinds[n]}" for n in names), "valid boolean", "errors array<string>", "message string"]))
