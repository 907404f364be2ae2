"""Preference formatting of chosen and rejected conversations, by column expressions only.

The longest run of turns that both share from the start is rendered once, as the prompt.  What
follows in either is a completion, with a mask that says which characters are to be trained on: the
assistant's words and the end mark behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import cut
from driftline.llm.merkle import with_next

#: The marks around a turn and the role whose words are trained on.
START, END, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"


def plain(c: Column) -> Column:
    """Text in which no mark begins: a space is put into ``<|``."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def head(t: Column) -> Column:
    """The start of a turn; a role is one line."""
    return F.concat(F.lit(START), F.replace(plain(t["role"]), F.lit("\n"), F.lit(" ")), F.lit("\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), plain(t["text"]), F.lit(f"{END}\n"))), "")


def mask(turns: Column) -> Column:
    """Run lengths of the rendered turns in code points, (chars, trained), three a turn: head, words with end mark, line end."""
    runs = lambda t: F.array(
        F.struct(F.char_length(head(t)).alias("chars"), F.lit(False).alias("trained")),
        F.struct((F.char_length(plain(t["text"])) + len(END)).alias("chars"), (t["role"] == TRAINED).alias("trained")),
        F.struct(F.lit(1).alias("chars"), F.lit(False).alias("trained")),
    )
    return F.flatten(F.transform(turns, runs))


def turns_of(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turns): each conversation's (role, text) in order of turn, then role, then text; null role and text: empty."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    listed = conversations.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    return listed.select("key", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    n = F.least(F.size(a), F.size(b))
    differing = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.array_min(differing) - 1, n))


def format_pairs(pairs: DataFrame, chosen: str = "chosen_turns", rejected: str = "rejected_turns") -> DataFrame:
    """``pairs`` with common_turns, prompt, chosen, chosen_mask, rejected and rejected_mask in place of the two arrays.

    prompt + chosen is the whole chosen conversation rendered, prompt + rejected the rejected one; the
    masks' run lengths add up to the completions' lengths.  Equal conversations give empty completions,
    as does one that is the other's beginning for the shorter.  Empty arrays are conversations without
    turns.  Null arrays count as empty.  Marks inside of texts and roles are broken up, so that no text
    forges a turn.  Columns with the names of the results are replaced; other columns stay.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    made = ("common_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask")
    keep = [F.col(f"`{c}`") for c in pairs.columns if c not in (chosen, rejected, *made)]
    a, b = F.coalesce(F.col(chosen), none), F.coalesce(F.col(rejected), none)
    rows = pairs.select(F.struct(*keep, F.lit(0).alias("_")).alias("kept"), a.alias("a"), b.alias("b")).withColumn("common_turns", common_turns(F.col("a"), F.col("b")).cast("int"))
    rest = lambda c: F.slice(c, F.col("common_turns") + 1, F.size(c))
    full = lambda c: F.when(F.size(c) > 0, rest(F.col(c))).otherwise(none)
    return rows.select(
        *[F.col(f"kept.`{c}`") for c in pairs.columns if c not in (chosen, rejected, *made)], "common_turns", render(F.slice("a", F.lit(1), F.col("common_turns"))).alias("prompt"),
        render(full("a")).alias("chosen"), mask(full("a")).alias("chosen_mask"), render(full("b")).alias("rejected"), mask(full("b")).alias("rejected_mask"),
    )


def swapped_replies(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Preference pairs from conversations alone: (key, chosen_turns, rejected_turns), one row a conversation.

    Chosen is the conversation up to its last assistant turn.  Rejected has the last assistant reply of
    the next conversation (in order of key, the first after the last) that has one in that turn's place.
    Without an assistant turn both are the conversation as it is.  Repeated rows are repeated turns.
    """
    convs = turns_of(conversations, key, turn, role, text)
    at = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i + 1)))
    marked = cut(convs.withColumn("at", at), "chat-turns")  # read several times from here
    able = marked.where("at is not null").withColumn("reply", F.element_at("turns", F.col("at"))["text"])
    ahead = with_next(able, "key", [], ["reply"])
    before = F.slice("turns", F.lit(1), F.col("at") - 1)
    other = F.array(F.struct(F.lit(TRAINED).alias("role"), F.col("next_reply").alias("text")))
    pairs = ahead.select("key", F.slice("turns", F.lit(1), F.col("at")).alias("chosen_turns"), F.concat(before, other).alias("rejected_turns"))
    plain = marked.where("at is null").select("key", F.col("turns").alias("chosen_turns"), F.col("turns").alias("rejected_turns"))
    return pairs.unionByName(plain).withColumnRenamed("key", key)
