"""Chat formatting: every assistant turn is an example, all turns before it are its context.

A turn is formatted as ``<turn>role<text>text</turn>`` and a line feed. Inside roles and texts a
backslash is doubled and one is put behind the < of a marker, which can be undone and leaves no
marker in a text. Only the text of an example's last turn is trainable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, BODY, CLOSE = "<turn>", "<text>", "</turn>\n"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, "<(/?turn>|text>)", r"<\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(convs: DataFrame, target: str = "assistant", id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_chars, is_last), one row for each turn of ``target``.

    ``text`` is every turn up to and with the example's own; its trainable part starts after
    ``loss_start`` characters and has ``loss_chars``, escapes counted. Turns that follow a
    conversation's last reply are one example more without a trainable part (loss_start null),
    so that nothing is lost. is_last marks the example that has the whole conversation.

    Turns are in order of ``turn``, null first, then role and text; repeated rows are turns of
    their own. Null roles and texts are empty; rows without a conversation id are one
    conversation. An empty table gives no rows. A conversation is one row while it is
    expanded, 2 GB at most, and its examples' texts together grow with the square of its turns,
    as the method has it; they are made one after the other, not held together.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    talks = convs.select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(BODY))
    formatted = F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(CLOSE)))
    last = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: (i == last) | (F.element_at("turns", i)["role"] == target))
    talks = talks.select("conv_id", "turns", formatted.alias("pieces"), ends.alias("ends"))
    each = talks.select("conv_id", "turns", "pieces", F.posexplode("ends").alias("example", "end"))
    own = F.element_at("turns", F.col("end"))
    context = F.array_join(F.slice("pieces", F.lit(1), F.col("end") - 1), "")
    trained = own["role"] == target
    made = each.select("conv_id", "example", context.alias("context"), F.element_at("pieces", F.col("end")).alias("piece"), F.when(trained, F.char_length(head(own))).alias("head"), F.when(trained, F.char_length(escape(own["text"]))).alias("loss_chars"), (F.col("end") == F.size("turns")).alias("is_last"))
    return made.select("conv_id", "example", F.concat("context", "piece").alias("text"), (F.char_length("context") + F.col("head")).alias("loss_start"), "loss_chars", "is_last")


def trained_text(text: Column, start: Column, chars: Column) -> Column:
    """What an example trains, as it was before formatting; null without a trainable part."""
    return unescape(F.substr(text, start + 1, chars))


def turns_of(text: Column) -> Column:
    """An array of (role, text) read back from formatted text."""
    pieces = F.split(text, CLOSE)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(pieces, lambda p: F.struct(unescape(F.substr(F.split(p, BODY, 2)[0], F.lit(len(OPEN) + 1))).alias("role"), unescape(F.split(p, BODY, 2)[1]).alias("text")))


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: n_turns, turns_sha256 (role, line feed, text,
    line feed for each turn), loss_chars and loss_sha256 of all trained texts in order,
    formatted_chars of all examples and n_examples."""
    turns = turns_of(F.col("text"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = made.select(
        "conv_id", "example",
        F.char_length("text").cast("long").alias("chars"),
        trained_text(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
        F.when(F.col("is_last"), F.size(turns)).alias("n_turns"),
        F.when(F.col("is_last"), F.sha2(said, 256)).alias("turns_sha256"),
    )
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "")
    found = rows.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.coalesce(F.sum(F.char_length("loss")), F.lit(0)).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    return found
