r"""Chat formatting by prefix-target expansion, in DataFrame expressions.

Each assistant turn becomes an example of its own: all turns before it as
context, then the turn itself, of which only the text is trainable. If the
conversation does not end with an assistant turn, one example of kind ``tail``
with nothing trainable holds it whole, so no turn is lost.

The template of a turn is ``### role:``, a line end, the text, a line end and
``</turn>`` with a line end. Inside texts and roles a backslash is put before
each backslash, ``###`` and ``</turn>``, so a marker inside a text never looks
like one of the template, and reading back restores each text exactly.

Null roles and texts count as empty. Turns go by number, then role, then text;
repeated rows are repeated turns. Rows without conv_id form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "###", "</turn>"
_CONTROL = r"(\\|###|</turn>)"
_ESCAPED = r"\\(\\|###|</turn>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(f"{OPEN} "), _role_out(turn["role"]), F.lit(":\n"))


def expand(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> conv_id, position (of the last turn held, from 0), kind
    (``target`` or ``tail``), formatted, loss_start and loss_length (code points of ``formatted``)."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    convs = convs.select("conv_id", "turns", F.transform("turns", lambda t: F.concat(_head(t), escape(t["text"]), F.lit(f"\n{CLOSE}\n"))).alias("done"))
    last = F.size("turns") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("turns", i)["role"] == target_role) | (i == last))
    each = convs.select("conv_id", "turns", "done", F.explode(ends).alias("position"))
    own = F.get("turns", F.col("position"))
    target = own["role"] == target_role
    before = F.array_join(F.slice("done", F.lit(1), F.col("position")), "")
    return each.select(
        "conv_id",
        "position",
        F.when(target, "target").otherwise("tail").alias("kind"),
        F.concat(before, F.get("done", F.col("position"))).alias("formatted"),
        F.when(target, F.length(before) + F.length(_head(own))).otherwise(0).cast("long").alias("loss_start"),
        F.when(target, F.length(escape(own["text"]))).otherwise(0).cast("long").alias("loss_length"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    parts = F.split(formatted, r"(?<!\\)</turn>\n")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(p: Column) -> Column:
        head = F.substring_index(p, ":\n", 1)
        n = F.length(head)
        return F.struct(_role_in(F.substr(head, F.lit(len(OPEN) + 2))).alias("role"), unescape(F.substr(p, n + 3, F.length(p) - n - 3)).alias("text"))

    return F.transform(parts, turn)


def digest(examples: DataFrame) -> DataFrame:
    """Read ``expand``'s output back: per conversation its turns and all text under the loss mask."""
    loss = unescape(F.substr("formatted", F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int")))
    convs = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "position").alias("whole"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "target", F.struct("position", loss.alias("loss"))))).alias("losses"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    convs = convs.select("conv_id", "formatted_chars", parsed(F.col("whole")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return convs.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
