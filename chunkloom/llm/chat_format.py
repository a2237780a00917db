"""Chat formatting: preference pairs rendered as one prompt and two masked completions, in DataFrame operations only.

Of two conversations, chosen and rejected, the longest common prefix of turns (same role and same text, nulls equal) is rendered once as the prompt; what follows
on either side is its completion. A completion comes with its segments: (start, end, train) in characters of the completion, one a turn, where only
turns of ``TRAIN_ROLE`` are trained on; the header of a turn is not, its closing mark is.

A pair's turns meet in one group, which the resulting row has to hold in any case; conversations are never compared with one another beyond their pair.

Defined results: turns are ordered by (turn, role, text), null turns first, and repeated rows are turns of their own; null roles render as an empty role, null texts as empty texts (a null is not equal to an
empty text when prefixes are compared); pairs of which a side has no turn have an empty prompt and that side's completion empty; turns without a pair key are left out; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROLE = "assistant"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(_head(t), _body(t))))


def segments(turns: Column) -> Column:
    """[(start, end, train)] over the rendered turns: heads are never trained on, bodies of TRAIN_ROLE are; runs of the same kind aren't joined."""

    def add(state: Column, t: Column) -> Column:
        head = state["at"] + F.length(_head(t))
        end = head + F.length(_body(t))
        piece = F.struct(head.cast("int").alias("start"), end.cast("int").alias("end"), F.coalesce(t["role"] == TRAIN_ROLE, F.lit(False)).alias("train"))
        return F.struct(end.cast("int").alias("at"), F.concat(state["out"], F.array(piece)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,train:boolean>>").alias("out"))
    return F.aggregate(turns, start, add, lambda s: s["out"])


def preference_pairs(turns: DataFrame, pair: str = "pair_id", side: str = "chosen") -> DataFrame:
    """One row a pair from turns (pair key, ``chosen`` boolean, turn, role, text)."""
    turn = _turn()
    grouped = turns.where(F.col(pair).isNotNull() & F.col(side).isNotNull()).groupBy(pair).agg(F.sort_array(F.collect_list(F.when(F.col(side), turn))).alias("a"), F.sort_array(F.collect_list(F.when(~F.col(side), turn))).alias("b"))
    return format_pairs(grouped, pair)


def _turn() -> Column:
    return F.struct(F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def format_pairs(pairs: DataFrame, pair: str = "pair_id") -> DataFrame:
    """One row a pair from (pair key, a: turns of the chosen conversation, b: of the rejected one), both in order."""
    # the first place at which the sides differ, or the end of the shorter one
    both = F.zip_with(F.slice("a", 1, F.least(F.size("a"), F.size("b"))), F.slice("b", 1, F.least(F.size("a"), F.size("b"))), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    same = F.array_position(both, F.lit(False))
    n = F.when(same > 0, same - 1).otherwise(F.size(both)).cast("int")
    cut = pairs.withColumn("prompt_turns", n)
    rest = lambda x: F.slice(x, F.col("prompt_turns") + 1, F.size(x))
    cut = cut.select(pair, "prompt_turns", F.slice("a", 1, F.col("prompt_turns")).alias("p"), *[F.when(F.size(x) > F.col("prompt_turns"), rest(x)).otherwise(F.slice(x, 1, 0)).alias(x) for x in ("a", "b")])
    return cut.select(pair, "prompt_turns", render(F.col("p")).alias("prompt"), render(F.col("a")).alias("chosen"), segments(F.col("a")).alias("chosen_segments"), render(F.col("b")).alias("rejected"), segments(F.col("b")).alias("rejected_segments"))


def masked(text: Column, parts: Column) -> Column:
    """The text's trained characters, as the mask selects them."""
    return F.concat_ws("", F.transform(F.filter(parts, lambda s: s["train"]), lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])))


def rejected_variants(conversations: DataFrame) -> DataFrame:
    """Pairs (pair_id, a, b) for ``format_pairs`` from conversations (conv_id, turn, role, text), which hold no preferences: each conversation is the chosen side of a pair.

    A digit drawn by the MD5 of its id says what is rejected. 0 to 2: the conversation that shares all but the lowest bit of the id (no turn if there is none), so that prefixes are mostly
    empty; 3 to 5: the conversation without its last turn, a prefix that the rejected side has whole; others: the conversation with the text of its last turn
    exchanged for that of its neighbour's last turn (null if there is none), so that all turns but the last are shared. Conversations meet only their neighbour, by an equi-join on the id.
    """
    whole = conversations.where(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").cast("bigint").alias("pair_id")).agg(F.sort_array(F.collect_list(_turn())).alias("a"))
    other = whole.select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("bigint")).alias("pair_id"), F.col("a").alias("o"))
    kind = F.conv(F.substring(F.md5(F.col("pair_id").cast("string")), 1, 1), 16, 10).cast("int")
    last = F.element_at("a", -1)
    swapped = F.struct(last["turn"].alias("turn"), last["role"].alias("role"), F.element_at("o", -1)["text"].alias("text"))
    shorter = F.slice("a", 1, F.size("a") - 1)
    none = F.slice("a", 1, 0)
    b = F.when(kind <= 2, F.coalesce("o", none)).when(kind <= 5, shorter).otherwise(F.concat(shorter, F.array(swapped)))
    return whole.join(other, "pair_id", "left").select("pair_id", "a", b.alias("b"))
