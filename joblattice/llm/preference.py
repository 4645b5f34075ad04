"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

The longest common prefix of turns (same role, same text) of the two
conversations is rendered once as the prompt; what follows it in either is
rendered as its completion.  A mask names the parts of a completion to learn
from: the texts of assistant turns, as (start, length) in characters.

A turn is rendered as ``<|role|>``, a line feed, its text, and a line feed.

Edge cases: a null role or text is rendered as empty, and equals only null; if
one side is the whole prefix of the other, its completion is empty; a side
without turns is empty, so the prompt is empty too; turns that share a number
are ordered by role and text; rows that agree in all of these are kept; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "|>\n"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(CLOSE), F.coalesce(turn["text"], F.lit("")), F.lit("\n"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


_BLOCK = 256


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used inside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _mask(turns: Column) -> Column:
    """(start, length) of each assistant text within the rendered turns.

    What lies before a turn is added up over whole blocks of turns, and over the
    rest of its own block, so that a long conversation costs little more per turn.
    """
    head = lambda t: F.length(F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(CLOSE)))
    body = lambda t: F.length(F.coalesce(t["text"], F.lit("")))
    sizes = F.transform(turns, lambda t: F.struct(head(t).alias("head"), body(t).alias("body"), (head(t) + body(t) + 1).alias("all"), (t["role"] == "assistant").alias("own")))

    def spans(part: Column) -> Column:
        every = part["all"]
        within = lambda b, n: _total(F.slice(every, b * _BLOCK + 1, n))
        count = F.floor((F.size(part) + _BLOCK - 1) / _BLOCK).cast("int")
        sums = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda b: within(b, F.lit(_BLOCK)))).otherwise(F.array().cast("array<int>"))
        before = lambda xs: F.transform(xs, lambda _, b: _total(F.slice(xs, F.lit(1), b)))

        def place(blocks: Column) -> Column:
            start = lambda t, i: F.get(blocks, F.floor(i / _BLOCK).cast("int")) + within(F.floor(i / _BLOCK).cast("int"), i % _BLOCK)
            each = F.transform(part, lambda t, i: F.when(t["own"], F.struct((start(t, i) + t["head"]).alias("start"), t["body"].alias("length"))))
            return F.array_compact(each)

        return _let(_let(sums, before), place)

    return _let(sizes, spans)


def common_prefix(chosen: Column, rejected: Column) -> Column:
    """How many leading turns the two arrays share."""
    same = F.zip_with(chosen, rejected, lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same).cast("long")).cast("int")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """From pair_id, chosen and rejected (arrays of role and text) to prompt and masked completions."""
    empty = F.expr("CAST(array() AS array<struct<role:string,text:string>>)")
    sides = pairs.select("pair_id", F.coalesce("chosen", empty).alias("chosen"), F.coalesce("rejected", empty).alias("rejected"))
    cut = sides.withColumn("n_prompt", common_prefix(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.expr(f"slice({c}, n_prompt + 1, greatest(size({c}) - n_prompt, 0))")
    parts = cut.select("pair_id", "n_prompt", F.expr("slice(chosen, 1, n_prompt)").alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return parts.select(
        "pair_id",
        F.col("n_prompt").cast("long").alias("n_prompt_turns"),
        _text(F.col("p")).alias("prompt"),
        _text(F.col("c")).alias("chosen"),
        _text(F.col("r")).alias("rejected"),
        _mask(F.col("c")).alias("chosen_mask"),
        _mask(F.col("r")).alias("rejected_mask"),
    )


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order; turns without a conv_id are a conversation of their own."""
    turn = F.struct("turn", "role", "text")
    plain = F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(plain.alias("turns"))


def pair_by_answer(conversations: DataFrame) -> DataFrame:
    """Each conversation as chosen, and as rejected the same one with its last answer taken from its neighbour.

    Conversations 2k and 2k + 1 are neighbours.  The rejected side holds the turns
    before the last assistant turn and then the neighbour's last assistant turn;
    nothing in its place if there is no such neighbour or answer (a null conv_id has
    no neighbour), and all turns if there is no answer to replace.
    """
    answers = F.transform("turns", lambda t: F.coalesce(t["role"] == "assistant", F.lit(False)))
    last = F.size("turns") - F.array_position(F.reverse(answers), True).cast("int")  # counted from 0; the size if there is none
    each = _turns(conversations).withColumn("last", last)
    other = each.where(F.col("last") < F.size("turns")).select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.get("turns", F.col("last")).alias("answer"))
    both = each.join(other, "conv_id", "left")
    replaced = F.concat(F.slice("turns", F.lit(1), F.col("last")), F.when(F.col("answer").isNotNull(), F.array("answer")).otherwise(F.slice("turns", F.lit(1), F.lit(0))))
    return both.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.when(F.col("last") < F.size("turns"), replaced).otherwise(F.col("turns")).alias("rejected"))


def pair_by_parity(conversations: DataFrame) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as pair k; a missing one has no turns."""
    turn = F.struct("turn", "role", "text")
    side = lambda odd: F.collect_list(F.when(F.pmod("conv_id", F.lit(2)) == odd, turn))
    plain = lambda c: F.transform(F.sort_array(c), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    known = conversations.where(F.col("conv_id").isNotNull())
    grouped = known.groupBy(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id")).agg(side(0).alias("c"), side(1).alias("r"))
    return grouped.select("pair_id", plain(F.col("c")).alias("chosen"), plain(F.col("r")).alias("rejected"))
