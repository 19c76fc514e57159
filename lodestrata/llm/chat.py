"""Preference formatting: a pair's common turns are rendered once as the prompt, the rest as two completions.

A conversation is the array of its turns in order, so it has to fit into a row: some hundred MB of text. The longest
common prefix of chosen and rejected is found by comparing them place by place; everything is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.tables import stored

START, END = "<|im_start|>", "<|im_end|>"  #: fixed values of the template; <| in a text becomes < |


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and turns: array of struct(role, text), by turn (null first), then role and text; turns of one number all count. Null
    text is empty, null role unknown; rows without conv_id are left out; other columns are ignored; an empty table gives no rows."""
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns a and b start with in common."""
    same = F.zip_with(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b))), lambda x, y: x == y)
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same)).cast("int")


def rendered(turns: Column) -> Column:
    """Each turn's text in the template."""
    return F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), F.replace(t["text"], F.lit("<|"), F.lit("< |")), F.lit(END + "\n")))


def mask(turns: Column, texts: Column) -> Column:
    """start:end of what a model learns from: the assistant's words and end mark, in code points of the joined texts."""
    sizes = F.zip_with(turns, texts, lambda t, x: F.struct(t["role"].alias("role"), F.char_length(x).alias("size")))

    def step(acc: Column, s: Column) -> Column:
        at = acc["at"]
        span = F.concat_ws(":", (at + len(START) + F.char_length(s["role"]) + 1).cast("string"), (at + s["size"] - 1).cast("string"))
        return F.struct((at + s["size"]).alias("at"), F.when(s["role"] == "assistant", F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(sizes, start, step, lambda acc: F.array_join(acc["out"], ","))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pairs (conv_id, chosen, rejected: arrays of turns) to conv_id, n_prompt_turns, prompt, chosen, rejected and
    their masks. A pair with equal turns has empty completions; null turns count as none; in a role, what isn't a letter,
    digit, _ or - becomes _, so that it can't hold a mark of the template.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    clean = lambda x: F.transform(F.coalesce(x, none), lambda t: F.struct(F.regexp_replace(t["role"], "[^A-Za-z0-9_-]+", "_").alias("role"), t["text"].alias("text")))
    rows = pairs.select("conv_id", clean(F.col("chosen")).alias("c"), clean(F.col("rejected")).alias("r"))
    rows = rows.withColumn("n", common_turns(F.col("c"), F.col("r")))
    rest = lambda x: F.slice(x, F.col("n") + 1, F.size(x))
    rows = rows.select("conv_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    rows = rows.withColumns({"cx": rendered(F.col("c")), "rx": rendered(F.col("r"))})
    join = lambda x: F.array_join(x, "")
    return rows.select("conv_id", F.col("n").cast("long").alias("n_prompt_turns"), join(rendered(F.col("p"))).alias("prompt"), join(F.col("cx")).alias("chosen"), join(F.col("rx")).alias("rejected"), mask(F.col("c"), F.col("cx")).alias("chosen_mask"), mask(F.col("r"), F.col("rx")).alias("rejected_mask"))


def answer_swaps(conversations: DataFrame) -> DataFrame:
    """A pair for each conversation: chosen is all of it; rejected leaves it at one of its assistant's turns, the (conv_id mod their
    number)th from 0, and goes on with the conversation whose id differs in the lowest bit from that one's first assistant's
    turn on (nothing, if it has none). Without an assistant's turn both are the whole.
    """
    rows = stored(turns_of(conversations), "op6-turns")
    places = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull())
    own = rows.withColumn("places", places)
    other = rows.select(F.expr("conv_id ^ 1").alias("conv_id"), F.slice("turns", F.greatest(F.coalesce(F.array_min(places), F.lit(1)), F.lit(1)), F.when(F.size(places) > 0, F.size("turns")).otherwise(0)).alias("tail"))
    both = own.join(other.hint("merge"), "conv_id", "left")
    at = F.get("places", F.pmod("conv_id", F.greatest(F.size("places"), F.lit(1))).cast("int"))
    none = F.array().cast("array<struct<role:string,text:string>>")
    left = F.concat(F.slice("turns", F.lit(1), F.coalesce(at, F.lit(1)) - 1), F.coalesce("tail", none))
    return both.select("conv_id", F.col("turns").alias("chosen"), F.when(F.size("places") == 0, F.col("turns")).otherwise(left).alias("rejected"))


def op6_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return format_preferences(answer_swaps(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


_TEXT = "'<|im_start|>' || t.role || chr(10) || replace(t.text, '<|', '< |') || '<|im_end|>' || chr(10)"
_RENDER = f"coalesce(array_to_string(list_transform({{x}}, lambda t: {_TEXT}), ''), '')"
_SIZES = f"list_transform({{x}}, lambda t: length({_TEXT}))"
_MASK = "coalesce(array_to_string(list_filter(list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN {x}[i].role = 'assistant' THEN (coalesce(list_sum({s}[1:i - 1]), 0)::BIGINT + 12 + 9 + 1)::VARCHAR || ':' || (list_sum({s}[1:i])::BIGINT - 1)::VARCHAR END), lambda m: m IS NOT NULL), ','), '')"
ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, regexp_replace(coalesce(role, 'unknown'), '[^A-Za-z0-9_-]+', '_', 'g') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
b AS (SELECT conv_id, turns, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS places FROM a),
d AS (SELECT b.conv_id, b.turns AS c, CASE WHEN len(b.places) = 0 THEN b.turns ELSE list_concat(b.turns[1:b.places[b.conv_id % len(b.places) + 1] - 1], CASE WHEN len(o.places) > 0 THEN o.turns[o.places[1]:] ELSE [] END) END AS r FROM b LEFT JOIN b o ON o.conv_id = xor(b.conv_id, 1)),
e AS (SELECT conv_id, c, r, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])) - 1, least(len(c), len(r))) AS n FROM d),
f AS (SELECT conv_id, n, c[1:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM e),
g AS (SELECT *, {_SIZES.format(x="c")} AS cs, {_SIZES.format(x="r")} AS rs FROM f)
SELECT conv_id, n AS n_prompt_turns, {_RENDER.format(x="p")} AS prompt, {_RENDER.format(x="c")} AS chosen, {_RENDER.format(x="r")} AS rejected,
       {_MASK.format(x="c", s="cs")} AS chosen_mask, {_MASK.format(x="r", s="rs")} AS rejected_mask FROM g
"""
