"""Chat formatting (operator 2), DataFrame functions only: linking tool calls with their results.

Calls and results meet in a hash join on conversation and call id, calls are put in an order in which
each follows what it depends on, arguments are checked against the tool's schema, and every call, like every other message,
becomes one line of canonical JSON: keys sorted, no white space. No conversation is gathered into one
row, so a conversation may hold any share of all turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirro.llm.common import materialize

#: JSON schema types and the variant types that satisfy them.
TYPES = {
    "string": "^STRING$",
    "integer": "^(BIGINT|DECIMAL\\([0-9]+,0\\))$",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT<.*>$",
    "array": "^ARRAY<.*>$",
    "null": "^VOID$",
}
_CALL = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>>"
_ROW = ("conv_id", "call_id", "turn", "result_turn", "status", "topo", "n_calls", "n_results", "errors", "json")


def canonical(text: Column) -> Column:
    """JSON text with sorted keys and no white space; null for what is not JSON."""
    return F.to_json(F.try_parse_json(text))


def _numbers(text: Column) -> Column:
    """The numbers outside strings, as they are written, sorted."""
    bare = F.regexp_replace(F.replace(F.replace(text, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit("")), '"[^"]*"', '""')
    return F.array_sort(F.regexp_extract_all(bare, F.lit("-?[0-9][0-9.eE+-]*"), F.lit(0)))


def lossless(text: Column) -> Column:
    """Whether canonical(text) is there and writes every number as text does."""
    return F.coalesce(_numbers(text) == _numbers(canonical(text)), F.lit(False))


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and other messages in messages (conv_id, turn, role, text).

    An assistant's text may be {"tool_calls": [{"id", "name", "arguments", "depends_on"}]}, a tool's
    {"tool_call_id", "content"}; arguments and content are JSON or JSON in a string. All other texts, null and broken ones too, are
    other messages. A call without id has a null call_id.
    """
    calls = F.when((F.col("role") == "assistant") & F.col("text").contains("tool_calls"), F.from_json("text", _CALL)["tool_calls"])
    result = F.when(F.col("role") == "tool", F.from_json("text", "struct<tool_call_id:string,content:string>"))
    own = messages.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).withColumns({"c": calls, "r": result})
    has_calls, has_result = F.coalesce(F.size("c"), F.lit(0)) > 0, F.col("r.tool_call_id").isNotNull()
    said = own.where(has_calls).select("conv_id", "turn", F.explode("c").alias("c")).select("conv_id", F.col("c.id").alias("call_id"), "turn", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.depends_on").alias("depends_on"))
    content = F.col("r.content")
    told = own.where(has_result).select("conv_id", F.col("r.tool_call_id").alias("call_id"), "turn", F.when(content.rlike(r"^\s*[\[{]") & lossless(content), canonical(content)).otherwise(content).alias("content"))
    return said, told, own.where(~has_calls & ~F.coalesce(has_result, F.lit(False))).select("conv_id", "turn", "role", "text")


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """Sorted array of json, unknown_tool, missing:<key>, type:<key> and extra:<key>; empty if the arguments fit."""
    v = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    out = F.array(F.lit("unknown_tool"))
    for tool, schema in schemas.items():
        known = schema.get("properties", {})
        found = [F.when(~F.array_contains(keys, k), F.lit(f"missing:{k}")) for k in schema.get("required", [])]
        for k, spec in known.items():
            kind = F.schema_of_variant(F.try_variant_get(v, f"$['{k}']", "variant"))
            found.append(F.when(F.array_contains(keys, k) & ~F.coalesce(kind.rlike(TYPES[spec["type"]]), F.lit(spec["type"] == "null")), F.lit(f"type:{k}")))
        errors = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")
        if not schema.get("additionalProperties", True):
            more = F.array_except(keys, F.array(*map(F.lit, known)) if known else F.array().cast("array<string>"))
            errors = F.concat(errors, F.transform(more, lambda k: F.concat(F.lit("extra:"), k)))
        out = F.when(name == tool, errors).otherwise(out)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.array_sort(F.when(~is_object, F.array(F.lit("json"))).otherwise(out))


def _levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, topo of the calls in conversations where some call depends on one that doesn't precede it.

    topo is the longest path down to a call that depends on none; calls on a cycle, or behind one, get null. Chains, that
    is calls that depend on one other call only, are shortened by pointer doubling; what is left, calls that depend on several, is
    peeled off in layers.
    """
    at = calls.select("conv_id", "call_id", "turn")
    edges = calls.select("conv_id", "call_id", "turn", F.explode("depends_on").alias("dep")).distinct()
    there = at.select(F.col("conv_id").alias("d_conv"), F.col("call_id").alias("dep_id"), F.col("turn").alias("d_turn"))
    edges = edges.join(there, (edges["conv_id"].eqNullSafe(there["d_conv"])) & (edges["dep"] == there["dep_id"]))
    edges = materialize(edges.select("conv_id", "call_id", "dep", (F.col("d_turn") >= F.col("turn")).alias("back")), "call-edges")
    odd = materialize(edges.where(F.coalesce("back", F.lit(True))).select("conv_id").distinct(), "unordered-conversations")
    if odd.isEmpty():
        return at.select("conv_id", "call_id", F.lit(0).cast("long").alias("topo")).limit(0)
    own = lambda df: df.join(odd.select(F.col("conv_id").alias("o")), df["conv_id"].eqNullSafe(F.col("o")), "left_semi")
    edges, nodes = own(edges.drop("back")), own(at.drop("turn"))
    several = edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("to"))
    several = materialize(several, "dependencies")
    chains = materialize(several.where("n = 1").select("conv_id", "call_id", "to", F.lit(1).cast("long").alias("w")), "chains")
    rounds = max(1, chains.count()).bit_length() + 1
    for _ in range(rounds):  # each doubles how far a pointer reaches
        q = chains.select(F.col("conv_id").alias("q_conv"), F.col("call_id").alias("q_id"), F.col("to").alias("q_to"), F.col("w").alias("q_w"))
        j = chains.join(q, chains["conv_id"].eqNullSafe(q["q_conv"]) & (chains["to"] == q["q_id"]), "left")
        chains = materialize(j.select("conv_id", "call_id", F.coalesce("q_to", "to").alias("to"), (F.col("w") + F.coalesce("q_w", F.lit(0))).alias("w"), F.col("q_id").isNotNull().alias("open")), "chains")
        if chains.where("open").isEmpty():
            break
    # pointers that still lead to a chain go round in a circle
    ends = chains.where("not open").select(F.col("conv_id").alias("e_conv"), F.col("call_id").alias("e_id"), F.col("to").alias("e_to"), F.col("w").alias("e_w"))
    many = several.where("n > 1").select("conv_id", "call_id")
    left = edges.join(many.select(F.col("conv_id").alias("m_conv"), F.col("call_id").alias("m_id")), edges["conv_id"].eqNullSafe(F.col("m_conv")) & (edges["call_id"] == F.col("m_id")), "left_semi")
    left = left.join(ends, left["conv_id"].eqNullSafe(ends["e_conv"]) & (left["dep"] == ends["e_id"]), "left")
    left = materialize(left.select("conv_id", "call_id", F.coalesce("e_to", "dep").alias("dep"), (1 + F.coalesce("e_w", F.lit(0))).alias("w")), "open-edges")
    known = several.select(F.col("conv_id").alias("k_conv"), F.col("call_id").alias("k_id"))
    new = materialize(nodes.join(known, nodes["conv_id"].eqNullSafe(known["k_conv"]) & (nodes["call_id"] == known["k_id"]), "left_anti").withColumn("topo", F.lit(0).cast("long")), "free-calls")
    todo, placed, paths = many, new, None
    while not todo.isEmpty() and not new.isEmpty():
        f = new.select(F.col("conv_id").alias("f_conv"), F.col("call_id").alias("f_id"), F.col("topo").alias("f_topo"))
        meets = left["conv_id"].eqNullSafe(f["f_conv"]) & (left["dep"] == f["f_id"])
        part = materialize(left.join(f, meets).select("conv_id", "call_id", (F.col("f_topo") + F.col("w")).alias("path")), "paths")
        paths = part if paths is None else paths.unionAll(part)
        left = materialize(left.join(f, meets, "left_anti"), "open-edges")
        blocked = left.select(F.col("conv_id").alias("b_conv"), F.col("call_id").alias("b_id")).distinct()
        same = todo["conv_id"].eqNullSafe(blocked["b_conv"]) & (todo["call_id"] == blocked["b_id"])
        free = todo.join(blocked, same, "left_anti").select(F.col("conv_id").alias("t_conv"), F.col("call_id").alias("t_id"))
        new = paths.join(free, paths["conv_id"].eqNullSafe(free["t_conv"]) & (paths["call_id"] == free["t_id"]), "left_semi")
        new = materialize(new.groupBy("conv_id", "call_id").agg(F.max("path").alias("topo")), "free-calls")
        todo = materialize(todo.join(blocked, same, "left_semi"), "blocked-calls")
        placed = placed.unionAll(new)
    p = placed.select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_id"), "topo")
    tails = ends.join(p, ends["e_conv"].eqNullSafe(p["p_conv"]) & (ends["e_to"] == p["p_id"])).select(F.col("e_conv").alias("p_conv"), F.col("e_id").alias("p_id"), (F.col("topo") + F.col("e_w")).alias("topo"))
    every = p.unionAll(tails)
    return nodes.join(every, nodes["conv_id"].eqNullSafe(every["p_conv"]) & (nodes["call_id"] == every["p_id"]), "left").select("conv_id", "call_id", "topo")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call id of a conversation, and for each result whose call is not there.

    calls: conv_id, call_id, turn, name, arguments (JSON text), depends_on (array of call ids); results: conv_id, call_id,
    turn, content. Of repeated ids the one of the lowest turn (then smallest content) counts, n_calls and n_results tell how
    many there were. status: linked, no_result, early_result (not after the call), no_call. topo: calls in
    rising (topo, turn, call_id) follow what they depend on; it is the turn itself where the
    conversation already has them in order, null on cycles and for results without a call. Dependencies
    on calls that are not there are ignored. Null conversation ids form one conversation, null
    arguments are an error `json`. Arguments that are no JSON, or numbers that canonical JSON would write otherwise, are
    kept as they are in raw_arguments. Empty tables give no rows; other columns are not read.
    """
    key = ["conv_id", "call_id"]
    first = calls.groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    first = first.select(*key, "n_calls", "c.*")
    told = results.groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    told = told.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"), F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results")
    both = first.join(told, first["conv_id"].eqNullSafe(told["r_conv"]) & (first["call_id"] == told["r_id"]), "full_outer")
    status = F.when(F.col("n_calls").isNull(), "no_call").when(F.col("n_results").isNull(), "no_result").when(F.col("result_turn") <= F.col("turn"), "early_result").otherwise("linked")
    levels = _levels(first)
    lv = levels.select(F.col("conv_id").alias("l_conv"), F.col("call_id").alias("l_id"), "topo", F.lit(True).alias("relaid"))
    both = both.join(lv, both["conv_id"].eqNullSafe(lv["l_conv"]) & (both["call_id"] == lv["l_id"]), "left")
    row = both.select(
        F.coalesce("conv_id", "r_conv").alias("conv_id"), F.coalesce("call_id", "r_id").alias("call_id"), "turn", "result_turn", status.alias("status"),
        F.when(F.coalesce("relaid", F.lit(False)), F.col("topo")).otherwise(F.col("turn").cast("long")).alias("topo"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.when(F.col("n_calls").isNull(), F.array().cast("array<string>")).otherwise(argument_errors(F.col("name"), F.col("arguments"), schemas)).alias("errors"),
        "name", F.when(F.col("n_calls").isNotNull(), F.col("arguments")).alias("arguments"), "content",
    )
    return row.select(*_ROW[:-1], _call_line().alias("json"))


def _quoted(c: Column) -> Column:
    """A JSON string or null."""
    made = F.to_json(F.struct(c.cast("string").alias("v")), {"ignoreNullFields": "false"})  # '{"v":' before, '}' after
    return F.substring(made, F.lit(6), F.char_length(made) - 6)


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def _call_line() -> Column:
    """raw_arguments is there only where the canonical ones don't hold all that the call said."""
    raw = F.when(F.col("arguments").isNotNull() & ~lossless(F.col("arguments")), F.concat(F.lit(',"raw_arguments":'), _quoted(F.col("arguments")))).otherwise("")
    return F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")), F.lit(',"call_id":'), _quoted(F.col("call_id")), F.lit(',"conv_id":'), _number("conv_id"),
        F.lit(',"name":'), _quoted(F.col("name")), raw, F.lit(',"result":'), _quoted(F.col("content")), F.lit(',"status":'), _quoted(F.col("status")), F.lit(',"turn":'), _number("turn"), F.lit("}"),
    )


def format_chat(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """link()'s rows of all tool calls and results in messages (conv_id, turn, role, text), and a row for every other message.

    Other messages have status message, no call_id, and role and content in their JSON; calls without an id have status no_id. No
    message is left out: texts that are null, empty, of unknown roles or not the JSON they should be are other messages. Repeated
    messages are rows each, repeated calls are counted by link(). Texts of any length are taken whole. An empty table gives no rows;
    other columns are not read.
    """
    calls, results, others = parse_messages(messages)
    out = link(calls.where("call_id is not null"), results, schemas)
    none = {"call_id": F.lit(None).cast("string"), "result_turn": F.lit(None).cast("long"), "topo": F.col("turn").cast("long"), "n_results": F.lit(0).cast("long")}
    stray = calls.where("call_id is null").withColumns(none | {"status": F.lit("no_id"), "n_calls": F.lit(1).cast("long"), "errors": argument_errors(F.col("name"), F.col("arguments"), schemas), "content": F.lit(None).cast("string")})
    line = F.concat(F.lit('{"content":'), _quoted(F.col("text")), F.lit(',"conv_id":'), _number("conv_id"), F.lit(',"role":'), _quoted(F.col("role")), F.lit(',"turn":'), _number("turn"), F.lit("}"))
    rest = others.withColumns(none | {"status": F.lit("message"), "n_calls": F.lit(0).cast("long"), "errors": F.array().cast("array<string>"), "json": line})
    return out.unionByName(stray.withColumn("json", _call_line()).select(*_ROW)).unionByName(rest.select(*_ROW))


def as_tool_messages(messages: DataFrame) -> DataFrame:
    """Conversations without tools as ones with a tool, `reply`: a user's turn becomes a call of it, the assistant's turn after it the result, other roles stay.

    By conv_id modulo 5 calls depend on the user's turn before (0, 3, 4), on the one after, so that they stand in the wrong order (1), or on
    both, which makes cycles (2); arguments are broken off (3) or hold numbers beyond any machine's, and results come early (4).
    """
    kind = F.coalesce(F.pmod(F.col("conv_id"), F.lit(5)), F.lit(0))
    call_id = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn, text = F.col("turn"), F.col("text").cast("string")
    plain = F.to_json(F.struct(text.alias("prompt"), F.char_length(text).alias("chars")), {"ignoreNullFields": "false"})
    cut = F.substring(plain, F.lit(1), F.char_length(plain) - 1)
    arguments = F.when(kind == 3, cut).when(kind == 4, F.concat(cut, F.lit(f',"seed":{SEED},"rate":1.0}}'))).otherwise(plain)
    before, after = call_id(turn - 2), call_id(turn + 2)
    depends = F.when(kind == 1, F.array(after)).when(kind == 2, F.array(before, after)).otherwise(F.array(before))
    call = F.to_json(F.struct(F.array(F.struct(call_id(turn).alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"), depends.alias("depends_on"))).alias("tool_calls")))
    result = F.to_json(F.struct(call_id(turn - 1).alias("tool_call_id"), text.alias("content")))
    user, said = F.col("role") == "user", F.col("role") == "assistant"
    return messages.select(
        "conv_id", F.when(said & (kind == 4), turn - 2).otherwise(turn).alias("turn"),
        F.when(user, "assistant").when(said, "tool").otherwise(F.col("role")).alias("role"), F.when(user, call).when(said, result).otherwise(text).alias("text"),
    )


SEED = "12345678901234567890" * 2 + "1234567890"
REPLY = {"reply": {"properties": {"chars": {"type": "integer"}, "prompt": {"type": "string"}, "seed": {"type": "integer"}, "rate": {"type": "number"}}, "required": ["prompt", "chars"], "additionalProperties": False}}
