"""Tool calls linked with their results, ordered, validated and written as JSON.

Calls and results meet by hash join on conversation and call id. The order is the
level of a call: one more than the highest level it waits for. Chains of calls that
wait for one other call are shortened by doubling their steps, so a chain of n calls
takes log n rounds; calls that wait for several are placed round by round.
Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import saved
from newsloom.operators.ordered import bucketed, previous, running

#: Tool -> parameter -> (JSON type, required, greatest value of a number).
Schemas = dict[str, dict[str, tuple[str, bool, float | None]]]

_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
_KINDS = {
    "integer": _NUMBER,
    "number": _NUMBER,
    "string": r"^STRING$",
    "boolean": r"^BOOLEAN$",
    "object": r"^OBJECT<.*",
    "array": r"^ARRAY<.*",
}
KEY = ["conv_id", "call_id"]


def levels(edges: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of calls that wait for others.

    ``edges`` are ``conv_id, call_id, dep``: the call waits for ``dep`` of the same
    conversation. Calls that wait for none are not in the result; their level is 0.
    Calls on a cycle, or behind one, have a null level.
    """
    edges = saved(edges.distinct(), "tool-edges")
    counts = edges.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("dep").alias("dep"))
    # One edge only: a step of a chain.
    chain = saved(counts.where("n = 1").select(*KEY, F.col("dep").alias("to"), F.lit(1).cast("long").alias("steps")), "chain")
    size = chain.count()
    for _ in range(size.bit_length() + 1):
        ahead = chain.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        joined = saved(chain.join(ahead, ["conv_id", "to"], "left"), "chain")
        chain = joined.select(*KEY, F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        if not joined.where("next IS NOT NULL").limit(1).count():
            break
    many = counts.where("n > 1").select(*KEY)
    # Where the edges of calls with several lead, chains left out.
    short = chain.select("conv_id", F.col("call_id").alias("dep"), "to", "steps")
    wide = edges.join(many, KEY, "left_semi").join(short, ["conv_id", "dep"], "left")
    wide = saved(wide.select(*KEY, F.coalesce("to", "dep").alias("to"), F.coalesce("steps", F.lit(0)).alias("steps")), "wide")
    heads = saved(chain.select("conv_id", F.col("to").alias("call_id")).unionByName(wide.select("conv_id", F.col("to").alias("call_id"))).distinct(), "heads")
    placed = heads.join(edges.select(*KEY), KEY, "left_anti").withColumn("level", F.lit(0).cast("long"))
    placed, waiting = saved(placed, "placed"), wide
    while True:
        base = placed.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("below"))
        found = waiting.join(base, ["conv_id", "to"], "left").groupBy(*KEY)
        found = found.agg(F.max(F.col("below") + F.col("steps") + 1).alias("level"), F.count_if(F.col("below").isNull()).alias("open"))
        ready = saved(found.where("open = 0").select(*KEY, "level"), "ready")
        if not ready.limit(1).count():
            break
        placed = saved(placed.unionByName(ready), "placed")
        waiting = saved(waiting.join(ready, KEY, "left_anti"), "waiting")
    base = placed.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("below"))
    chained = chain.join(base, ["conv_id", "to"], "left").select(*KEY, (F.col("below") + F.col("steps")).alias("level"))
    return chained.unionByName(many.join(placed, KEY, "left").select(*KEY, "level"))


#: A JSON text as strings, numbers and what is between them.
_TOKENS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++'


def _shortest(number: Column) -> Column:
    """A double as ECMAScript writes it, which is what canonical JSON asks for.

    The digits are the JVM's; before Java 19 it shows one too many for a few numbers.
    """
    shown = F.abs(number).cast("string")
    mantissa = F.regexp_extract(shown, "^[0-9.]+", 0)
    power = F.coalesce(F.regexp_extract(shown, "E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    every = F.replace(mantissa, F.lit("."), F.lit(""))
    tail = F.regexp_replace(every, "^0+", "")
    digits = F.regexp_replace(tail, "0+$", "")
    k = F.length(digits)
    # The number is 0.digits times ten to the n.
    n = F.instr(mantissa, ".") - 1 + power - (F.length(every) - F.length(tail))
    plain = F.when((k <= n) & (n <= 21), F.concat(digits, F.repeat(F.lit("0"), n - k)))
    plain = plain.when((n > 0) & (n <= 21), F.concat(F.substring(digits, F.lit(1), n), F.lit("."), F.substring(digits, n + 1, k)))
    plain = plain.when((n > -6) & (n <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -n), digits))
    fraction = F.when(k > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), k))).otherwise(F.lit(""))
    power_shown = F.concat(F.when(n > 0, "e+").otherwise("e-"), F.abs(n - 1).cast("string"))
    whole = plain.otherwise(F.concat(F.substring(digits, F.lit(1), F.lit(1)), fraction, power_shown))
    return F.when(number == 0, "0").otherwise(F.concat(F.when(number < 0, "-").otherwise(""), whole))


def canonical(text: Column) -> Column:
    """A JSON text with its fractions and powers in canonical form: ``1e2`` is ``100``.

    Whole numbers keep all their digits. What is inside strings stays as it is.
    """
    one = lambda t: F.when(t.rlike("^-?[0-9]") & t.rlike("[.eE]"), _shortest(t.try_cast("double"))).otherwise(t)
    tokens = F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), one)
    return F.when(text.rlike("[0-9][.eE]"), F.array_join(tokens, "")).otherwise(text)


def faults(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with parsed arguments (a variant), as an array; empty if nothing."""
    out = F.array(F.lit("unknown tool"))
    for tool, parameters in schemas.items():
        found = []
        for p, (kind, required, most) in sorted(parameters.items()):
            path = f"$['{p}']"
            value = F.try_variant_get(arguments, path, "variant")
            type_ = F.schema_of_variant(value)
            missing = value.isNull()
            number = F.try_variant_get(arguments, path, "double")
            fits = type_.rlike(_KINDS[kind])
            if kind == "integer":
                # Any number without a fraction, however it is written.
                fits = fits & F.coalesce(number % F.lit(1.0) == 0, F.lit(False))
            wrong = ~missing & ~fits
            found.append(F.when(missing & F.lit(required), F.lit(f"missing {p}")))
            found.append(F.when(wrong, F.lit(f"type of {p}")))
            if most is not None:
                found.append(F.when(~missing & ~wrong & (number > most), F.lit(f"range of {p}")))
        keys = F.map_keys(F.from_json(F.to_json(arguments), "map<string,string>"))
        extra = F.array_except(keys, F.array(*map(F.lit, parameters)) if parameters else F.array().cast("array<string>"))
        found.append(F.when(F.size(extra) > 0, F.lit("unknown parameter")))
        out = F.when(name == tool, F.array_compact(F.array(*found))).otherwise(out)
    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, out).otherwise(F.array(F.lit("no JSON object")))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call, and one per result that no call asked for.

    ``calls``: ``conv_id, call_id, name, arguments`` (JSON text), ``after`` (ids of calls
    it waits for; null: none). ``results``: ``conv_id, call_id, content``.

    Returns ``conv_id, call_id, level, status, faults, json``. Of rows that repeat a call
    or a result id the least one counts. Rows without conversation or id are left out.
    ``status``: ``orphan`` (a result without call), ``cyclic``, ``invalid`` (see
    ``faults``), ``open`` (no result) or ``done``, the first that holds. ``json`` has
    sorted keys, no blanks and canonical numbers; arguments that are no JSON, repeat a
    key or are longer than a variant may be (16 MB at least) stand in it as a string, as
    they came. Ids in ``after`` that name no call are not waited for.
    """
    there = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    one = calls.where(there).groupBy(*KEY).agg(
        F.min(F.struct("name", "arguments", F.array_sort("after").alias("after"))).alias("call")
    )
    one = saved(one, "calls")
    answer = results.where(there).groupBy(*KEY).agg(F.min("content").alias("content"), F.lit(True).alias("answered"))
    wanted = one.select(*KEY, F.explode("call.after").alias("dep")).where("dep IS NOT NULL")
    known = one.select("conv_id", F.col("call_id").alias("dep"))
    order = levels(wanted.join(known, ["conv_id", "dep"], "left_semi").select(*KEY, "dep"))
    both = (
        one.withColumn("called", F.lit(True))
        .join(order.withColumn("waits", F.lit(True)), KEY, "left")
        .join(answer, KEY, "full")
    )
    parsed = both.withColumn("args", F.try_parse_json("call.arguments"))
    wrong = F.when(F.col("called"), faults(F.col("call.name"), F.col("args"), schemas)).otherwise(F.array().cast("array<string>"))
    level = F.when(F.col("waits"), F.col("level")).when(F.col("called"), F.lit(0).cast("long"))
    status = (
        F.when(F.col("called").isNull(), "orphan")
        .when(F.col("waits") & F.col("level").isNull(), "cyclic")
        .when(F.size("faults") > 0, "invalid")
        .when(F.col("answered").isNull(), "open").otherwise("done")
    )
    # Fields in order of their names; a variant's keys are sorted already.
    raw = F.regexp_extract(F.to_json(F.array("call.arguments")), r"(?s)^\[(.*)\]$", 1)
    shown = F.coalesce(canonical(F.to_json("args")), F.when(F.col("call.arguments").isNotNull(), raw), F.lit("null"))
    rest = F.to_json(F.struct("call_id", F.col("call.name").alias("name"), F.col("content").alias("result")), {"ignoreNullFields": "false"})
    whole = F.concat(F.lit('{"arguments":'), shown, F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))
    return parsed.withColumn("faults", wrong).select(*KEY, level.alias("level"), status.alias("status"), "faults", whole.alias("json"))


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that stand for the turns of conversations, all of them.

    Each assistant turn is a call of ``reply``, its text among the arguments, that waits
    for the assistant turn before it, however far back. Every other turn, whatever its
    role, is the result of the turn before it, as JSON with its role; where that is no
    assistant turn, no call has asked for it. The first turn's id is ``start``. Rows
    without conversation or turn are left out; of rows that repeat a turn the least one
    counts. A null role or text is empty.

    The turn before is found by bucketed runs, so that a conversation of any length is
    never sorted by one task.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.struct("role", "text").alias("said"))
    rows = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("said").alias("said"))
    shown = lambda c: F.coalesce(F.col(f"said.{c}").cast("string"), F.lit("")).alias(c)
    rows = saved(rows.select("conv_id", "turn", shown("role"), shown("text")), "turns")
    call_id = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    # Only where a turn stands, and whose it is, is needed of the whole run, not what it says.
    places = bucketed(rows.select("conv_id", "turn", F.when(F.col("role") == "assistant", F.col("turn")).alias("reply")), ["conv_id"], "turn")
    places = previous(places, ["conv_id"], "turn", "turn", "before")
    places = running(places, ["conv_id"], "turn", "reply", "prior", "max", False)
    rows = rows.join(places.select("conv_id", "turn", "before", "prior"), ["conv_id", "turn"])
    asks = F.col("text").contains("?")
    arguments = F.struct(F.when(asks, asks).alias("asks"), F.length("text").alias("chars"), "text", "turn")
    calls = rows.where("role = 'assistant'").select(
        "conv_id", call_id(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), F.to_json(arguments).alias("arguments"),
        F.array(call_id(F.col("prior"))).alias("after"),
    )
    results = rows.where("role <> 'assistant'").select(
        "conv_id", F.coalesce(call_id(F.col("before")), F.lit("start")).alias("call_id"), F.to_json(F.struct("role", "text")).alias("content")
    )
    return calls, results


#: The tool of ``turns_as_calls``; replies of more characters are out of range.
REPLY: Schemas = {
    "reply": {"asks": ("boolean", False, None), "chars": ("integer", True, 1000), "text": ("string", True, None), "turn": ("integer", True, None)}
}
