"""Tool calls in conversations: linked to their results, ordered, validated, and written canonically.

Messages are rows (conv_id, turn, role, text).  An assistant's text may be a JSON object with
``tool_calls`` (id, name, arguments); a tool's text is one with ``tool_call_id`` and
``content``.  Arguments name the calls they build on as ``{"$call": id}`` under ``uses``.
Built-in functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmart.llm.common import cut

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>>"
RESULT = "struct<tool_call_id:string,content:string>"
KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}
# Where a message without a turn stands: after all others.
NO_TURN = (1 << 63) - 1
# Rounds whose placed calls are kept as tables of their own before they are written as one.
UNITED = 8

Schemas = dict[str, dict[str, dict]]


def _at(turn: Column) -> Column:
    return F.coalesce(turn, F.lit(NO_TURN))


def _told(turn: str) -> Column:
    return F.nullif(F.col(turn), F.lit(NO_TURN)).alias(turn)


def calls_of(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, place, call_id, name, arguments) of every call."""
    parsed = F.from_json("text", CALLS)
    found = messages.where((F.col("role") == "assistant") & F.col("text").contains("tool_calls")).select(
        "conv_id", "turn", F.posexplode(parsed["tool_calls"]).alias("place", "call")
    )
    return found.select(
        "conv_id", "turn", "place", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"),
        F.col("call.arguments").alias("arguments"),
    )


def results_of(messages: DataFrame) -> DataFrame:
    """(conv_id, call_id, result_turn, content) of every result, the earliest of each call."""
    parsed = F.from_json("text", RESULT)
    found = messages.where((F.col("role") == "tool") & F.col("text").contains("tool_call_id")).select(
        "conv_id", "turn", parsed.alias("r")
    )
    first = F.min(F.struct(_at(F.col("turn")).alias("turn"), F.col("r.content").alias("content"))).alias("first")
    return (
        found.groupBy("conv_id", F.col("r.tool_call_id").alias("call_id"))
        .agg(first, F.count("*").alias("n_results"))
        .select("conv_id", "call_id", F.col("first.turn").alias("result_turn"), F.col("first.content").alias("content"), "n_results")
    )


def canonical(text: Column) -> Column:
    """JSON without white space, its keys sorted; null where it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def faults(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What a call's arguments violate, in the order of the schema; an empty array if nothing."""
    value = F.try_parse_json(arguments)
    shape = F.schema_of_variant(value)
    none = F.array().cast("array<string>")
    checks = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        each = []
        for field, rule in fields.items():
            there = F.try_variant_get(value, f"$.{field}", "variant")
            kind = F.schema_of_variant(there)
            absent = there.isNull() | (kind == "VOID")
            if rule.get("required"):
                each.append(F.when(absent, F.lit(f"{field} missing")))
            each.append(F.when(~absent & ~kind.startswith(KINDS[rule["type"]]), F.lit(f"{field} is no {rule['type']}")))
            if "least" in rule or "most" in rule:
                number = F.try_variant_get(value, f"$.{field}", "long")
                outside = (number < rule.get("least", -(1 << 62))) | (number > rule.get("most", 1 << 62))
                each.append(F.when(outside, F.lit(f"{field} out of range")))
            if "one_of" in rule:
                text = F.try_variant_get(value, f"$.{field}", "string")
                each.append(F.when(~absent & ~text.isin(rule["one_of"]), F.lit(f"{field} not allowed")))
        known = F.array(*[F.lit(f) for f in [*fields, "uses"]])
        names = F.json_object_keys(arguments)
        extra = F.transform(F.array_sort(F.array_except(names, known)), lambda n: F.concat(n, F.lit(" unknown")))
        of_tool = F.concat(F.array_compact(F.array(*each)), F.coalesce(extra, none))
        checks = F.when(name == tool, of_tool).otherwise(checks)
    return F.when(value.isNull() | ~shape.startswith("OBJECT"), F.array(F.lit("arguments are no object"))).otherwise(checks)


def _ordered(calls: DataFrame, uses: DataFrame) -> DataFrame:
    """(conv_id, call_id, at_turn, at_place, depth, cyclic): a call stands after all it uses.

    A call keeps its own place unless it uses a later one, then it moves behind that.  In each round a
    use of a placed call is settled, and a use of a call with a single open use is replaced by
    that one, twice as far away; so chains of any length take a logarithmic number of rounds, and only calls
    that use several open ones wait for each of them.  No use is ever split in two.  A use that
    leads back to its call, or over more steps than there are calls, goes round in a circle.  The rounds
    end when nothing is open, or nothing changes; what then is still open stands in a circle or builds on
    one, has no order, is reported as cyclic and keeps its place.
    """
    keys = ["conv_id", "call_id"]
    shape = "struct<at_turn:bigint,at_place:int,depth:bigint>"
    n_calls = calls.count()
    own = F.struct("turn", "place", F.lit(0)).cast(shape)
    base = calls.select(*keys, own.alias("best"))
    edges = cut(uses.select(*keys, "used", F.lit(1).cast("long").alias("steps")))
    none = F.lit(False).alias("circle")
    state = _kinds(base.select(*keys, "best", none), edges)
    done = []
    while True:
        done.append(state.where(F.col("kind").isin("placed", "cyclic")))
        if len(done) > UNITED:
            done = [cut(reduce(DataFrame.unionByName, done))]
        open_ = state.where(F.col("kind").isin("single", "many"))
        # A use may have been moved on to a call that was placed rounds ago.
        theirs = reduce(DataFrame.unionByName, [open_, *done]).select(
            "conv_id", F.col("call_id").alias("used"), "kind", F.col("best").alias("theirs"), "to", "more"
        )
        met = cut(edges.join(theirs, ["conv_id", "used"]))
        if met.where("kind <> 'many'").isEmpty():
            done.append(open_.withColumn("kind", F.lit("cyclic")))
            break
        target = F.when(F.col("kind") == "single", F.col("to")).otherwise(F.col("used"))
        steps = F.col("steps") + F.when(F.col("kind") == "single", F.col("more")).otherwise(F.lit(0))
        round_ = (F.col("kind") == "cyclic") | (F.col("kind").isin("single", "many") & ((target == F.col("call_id")) | (steps > n_calls)))
        behind = F.struct("theirs.at_turn", "theirs.at_place", (F.col("theirs.depth") + F.col("steps")).alias("depth"))
        gained = met.groupBy(*keys).agg(
            F.max(F.when(F.col("kind").isin("placed", "single"), behind)).alias("gain"), F.max(round_).alias("circle")
        )
        base = open_.drop("kind", "to", "more", "circle").join(gained, keys)
        base = base.select(*keys, F.greatest("best", "gain").alias("best"), "circle")
        left = met.where(F.col("kind").isin("single", "many"))
        left = left.select(*keys, target.alias("used"), steps.alias("steps")).groupBy(*keys, "used").agg(F.max("steps").alias("steps"))
        edges = cut(left.join(base.where("not circle").select(*keys), keys, "left_semi"))
        state = _kinds(base, edges)
    every = reduce(DataFrame.unionByName, done).join(calls.select(*keys, own.alias("own")), keys)
    cyclic = F.col("kind") == "cyclic"
    place = F.when(cyclic, F.col("own")).otherwise(F.col("best"))
    return every.select(*keys, *[place[c].alias(c) for c in ("at_turn", "at_place", "depth")], cyclic.alias("cyclic"))


def _kinds(base: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls by how many of their uses are open; those with one carry its target and how far that is."""
    counted = edges.groupBy("conv_id", "call_id").agg(
        F.count("*").alias("n"), F.min("used").alias("to"), F.max("steps").alias("more")
    )
    kind = (
        F.when(F.col("circle"), "cyclic").when(F.col("n").isNull(), "placed").when(F.col("n") == 1, "single").otherwise("many")
    )
    return cut(
        base.join(counted, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "best", "circle", kind.alias("kind"), "to", "more")
    )


def linked(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call, and per result without a call.

    conv_id, call_id, name, turn, result_turn, status (linked, no result, early result, no call),
    order_key (sorts the calls of a conversation so that each follows what it uses), n_uses,
    n_unknown_uses, cyclic, valid, faults, n_same (calls of that identifier), canonical (JSON of
    the call with its result) and canonical_sha256.

    Calls and results meet by conversation and identifier, so a conversation of any length is
    spread over all tasks.  Of calls with one identifier the first counts; a message without a turn
    comes after all others.  Messages without a
    conversation, identifier or text link to nothing and give no row; repeated messages count
    once; other columns are ignored.
    """
    plain = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    ).where(F.col("conv_id").isNotNull() & F.col("text").isNotNull())
    every = calls_of(plain).where(F.col("call_id").isNotNull())
    first = F.min(F.struct(_at(F.col("turn")).alias("turn"), "place", "name", "arguments")).alias("c")
    calls = cut(
        every.groupBy("conv_id", "call_id")
        .agg(first, F.count("*").alias("n_same"))
        .select("conv_id", "call_id", "c.turn", "c.place", "c.name", "c.arguments", "n_same")
    )
    results = results_of(plain).where(F.col("call_id").isNotNull())
    uses = calls.select(
        "conv_id", "call_id",
        F.explode(F.array_distinct(F.from_json(F.get_json_object("arguments", "$.uses[*].$call"), "array<string>"))).alias("used"),
    )
    single = calls.select("conv_id", "call_id", F.get_json_object("arguments", "$.uses.$call").alias("used"))
    uses = uses.unionByName(single).where(F.col("used").isNotNull()).distinct()
    known = uses.join(calls.select("conv_id", F.col("call_id").alias("used"), F.lit(1).alias("known")), ["conv_id", "used"], "left")
    counts = known.groupBy("conv_id", "call_id").agg(
        F.count("*").alias("n_uses"), F.count_if(F.col("known").isNull()).alias("n_unknown_uses")
    )
    places = _ordered(calls, known.where("known = 1").select("conv_id", "call_id", "used"))
    both = (
        calls.join(places, ["conv_id", "call_id"])
        .join(counts, ["conv_id", "call_id"], "left")
        .join(results, ["conv_id", "call_id"], "full")
    )
    status = (
        F.when(F.col("turn").isNull(), "no call")
        .when(F.col("result_turn").isNull(), "no result")
        .when(F.col("result_turn") < F.col("turn"), "early result")
        .otherwise("linked")
    )
    found = F.when(F.col("turn").isNotNull(), faults(F.col("name"), F.col("arguments"), schemas))
    head = F.to_json(F.struct(F.col("call_id").alias("id"), "name", F.col("content").alias("result")))
    whole = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")), F.lit(","), F.substring(head, 2, F.length(head))
    )
    key = F.format_string("%020d:%010d:%06d", F.col("at_turn"), F.col("at_place").cast("long"), F.col("depth").cast("long"))
    out = both.select(
        "conv_id", "call_id", "name", _told("turn"), _told("result_turn"), status.alias("status"),
        F.when(F.col("turn").isNotNull(), key).alias("order_key"),
        F.coalesce("n_uses", F.lit(0).cast("long")).alias("n_uses"),
        F.coalesce("n_unknown_uses", F.lit(0).cast("long")).alias("n_unknown_uses"),
        "cyclic", (F.size(found) == 0).alias("valid"), F.array_join(found, "; ").alias("faults"), "n_same",
        canonical(whole).alias("canonical"),
    )
    return out.withColumn("canonical_sha256", F.sha2("canonical", 256))


# Tools of the derived calls, see ``as_messages``.
DERIVED: Schemas = {
    "search": {
        "query": {"type": "string", "required": True},
        "limit": {"type": "integer", "required": True, "least": 1, "most": 50},
    },
    "lookup": {
        "query": {"type": "string", "required": True},
        "lang": {"type": "string", "one_of": ["de", "en", "es", "fr"]},
    },
    "count": {"words": {"type": "integer", "required": True, "least": 1}},
}


def as_messages(conversations: DataFrame) -> DataFrame:
    """Tool messages made of a plain conversation: each user turn asks, each assistant turn answers.

    A user turn becomes an assistant's call, whose tool and arguments follow from the text and the turn;
    an assistant turn becomes the result of the call of the turn before it.  Turns divisible
    by 7 use the call two turns later, most others the one two turns before, so that some calls must
    be moved; some arguments break their schema.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.size(F.split(F.trim(text), r"\s+"))
    call = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id"), turn)
    used = F.when(F.col("turn") % 7 == 0, call(F.col("turn") + 2)).when(
        (F.col("turn") >= 2) & ((F.col("turn") - 2) % 7 != 0), call(F.col("turn") - 2)
    )
    uses = F.when(used.isNotNull(), F.concat(F.lit('{"$call": "'), used, F.lit('"}')))
    quoted = F.get_json_object(F.to_json(F.struct(F.struct(text.alias("q")).alias("x"))), "$.x")
    query = F.substring(quoted, 6, F.length(quoted) - 6)
    kind = words % 3
    body = (
        F.when(kind == 0, F.concat(F.lit('"query" : '), query, F.lit(', "limit": '), (words % 60).cast("string")))
        .when(kind == 1, F.concat(F.lit('"lang": "'), F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr", "xx"))), words % 5 + 1), F.lit('", "query": '), query))
        .otherwise(F.concat(F.lit('"words": '), words.cast("string")))
    )
    arguments = F.concat(F.lit("{ "), F.when(uses.isNotNull(), F.concat(F.lit('"uses": '), uses, F.lit(", "))).otherwise(F.lit("")), body, F.lit("}"))
    name = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("count")), kind + 1)
    asked = F.to_json(
        F.struct(F.array(F.struct(call(F.col("turn")).alias("id"), name.alias("name"), arguments.alias("arguments"))).alias("tool_calls"))
    )
    answered = F.to_json(F.struct(call(F.col("turn") - 1).alias("tool_call_id"), text.alias("content")))
    is_user = F.col("role") == "user"
    return conversations.where(F.col("role").isin("user", "assistant")).select(
        "conv_id", "turn",
        F.when(is_user, "assistant").otherwise("tool").alias("role"),
        F.when(is_user, asked).otherwise(answered).alias("text"),
    )
