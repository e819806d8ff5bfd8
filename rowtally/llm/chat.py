"""Operator 13: chat formatting by prefix-target expansion, in native functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtally.llm.numbering import in_order
from rowtally.session import scratch_folder, stored

BLOCK_TURNS = 256  # turns whose examples one row makes, at most
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """A turn is ``turn`` + role + ``body`` + text + ``end``.

    ``others`` are further strings that a model takes for controls. Inside roles and texts each of these strings is broken up by a
    backslash behind its first character; none may hold a backslash or end with what a mark starts with.
    """

    turn: str = "<|turn|>"
    body: str = "<|text|>"
    end: str = "</s>"
    others: tuple[str, ...] = ("<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def escaped(self, text: Column) -> Column:
        # every backslash is doubled first, so that a single one can only be one set here
        doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
        controls = (self.turn, self.body, self.end, *self.others)
        return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + ESCAPE + c[1:])), controls, doubled)

    @staticmethod
    def unescaped(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    def formatted(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.turn), self.escaped(role), F.lit(self.body), self.escaped(text), F.lit(self.end))

    def turns(self, chat: Column) -> Column:
        """The turns of a formatted chat: array of (role, text)."""
        def parsed(piece: Column) -> Column:
            head = F.substring_index(piece, self.body, 1)
            role = F.substring(head, F.lit(len(self.turn) + 1), F.char_length(head))
            text = F.substring(piece, F.char_length(head) + len(self.body) + 1, F.char_length(piece))
            return F.struct(self.unescaped(role).alias("role"), self.unescaped(text).alias("text"))

        return F.transform(F.filter(F.split(chat, re.escape(self.end)), lambda p: p != ""), parsed)


def format_chats(turns: DataFrame, template: Template = Template(), trainable: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, block, turn, last, chat, loss_start, loss_end, before of every example of ``turns`` (conv_id, turn, role, text).

    Each turn of a ``trainable`` role becomes an example of its own: ``before`` and ``chat`` are all turns up to it, and only the
    code points ``loss_start`` to ``loss_end`` of ``chat`` (its text, without the end mark) are trained on. Turns behind the last trainable
    one make a row without trainable text (both ends null), so that the output holds every conversation whole.

    A conversation of over BLOCK_TURNS turns is cut into blocks, each made into examples by itself: ``chat`` has the turns of the
    example's own block, ``before`` those of all earlier blocks. Examples with their whole context grow with the square of a
    conversation's turns, so the blocks of one are dealt to different tasks. The text of a block that isn't the last
    also stands by itself, in a row without trainable text. ``turn`` is the place of the row's last turn in its conversation,
    from 0; ``last`` marks the one row whose ``chat`` is its block whole.

    Turns stand in the order of turn, nulls first, then of role and text; rows alike are turns of their own. Null roles and texts
    count as empty, rows without conv_id are one conversation. Other columns are left out; an empty table gives an empty result.
    """
    whole = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.select("conv_id", F.col("turn").alias("at"), whole("role").alias("role"), whole("text").alias("text"))
    placed = in_order(stored(rows, scratch_folder(turns.sparkSession, "turns")), "conv_id", ["at", "role", "text"])
    reply = F.when(F.col("role").isin(*trainable), F.char_length(template.escaped(F.col("text"))))
    piece = F.struct("pos", template.formatted(F.col("role"), F.col("text")).alias("chat"), reply.alias("reply"))
    joined = lambda pieces: F.array_join(F.transform(pieces, lambda p: p["chat"]), "")
    own = F.expr(f"pos DIV {BLOCK_TURNS}")
    # a turn goes to its own block and, as context, to all later ones
    dealt = placed.select("conv_id", "n", "pos", own.alias("own"), piece.alias("piece"), F.explode(F.sequence(own, F.expr(f"(n - 1) DIV {BLOCK_TURNS}"))).alias("block"))
    gathered = lambda where: F.sort_array(F.collect_list(F.when(where, F.col("piece"))))
    blocks = dealt.groupBy("conv_id", "block").agg(gathered(F.col("own") == F.col("block")).alias("pieces"), joined(gathered(F.col("own") < F.col("block"))).alias("before"), F.max("n").alias("n"))
    size, first = F.size("pieces"), F.col("block") * BLOCK_TURNS
    ends_here = first + size < F.col("n")  # more blocks follow, which need this one as context
    targets = F.filter(F.sequence(F.lit(1), size), lambda i: F.element_at("pieces", i)["reply"].isNotNull())
    tail = ends_here | F.element_at("pieces", -1)["reply"].isNull()
    every = F.when(tail, F.array_append(targets, F.lit(0))).otherwise(targets)
    cut = blocks.select("conv_id", "block", first.alias("first"), size.alias("size"), tail.alias("tail"), "pieces", "before", F.explode(every).alias("i"))
    upto = F.when(F.col("i") > 0, F.col("i")).otherwise(F.col("size"))
    chat = joined(F.slice("pieces", 1, upto))
    out = cut.select("conv_id", "block", (F.col("first") + upto - 1).alias("turn"), ((F.col("i") == 0) | ~F.col("tail") & (upto == F.col("size"))).alias("last"), chat.alias("chat"),
                     F.when(F.col("i") > 0, F.element_at("pieces", upto)["reply"]).alias("reply"), "before")
    end = F.when(F.col("reply").isNotNull(), F.char_length("chat") - len(template.end)).cast("long")
    return out.select("conv_id", "block", "turn", "last", "chat", (end - F.col("reply")).alias("loss_start"), end.alias("loss_end"), "before")


def trained_text(template: Template = Template()) -> Column:
    """What an example trains on, as it stood in the conversation; null if nothing."""
    marked = F.substring(F.col("chat"), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return template.unescaped(marked)
