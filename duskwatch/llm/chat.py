"""Chat examples: one per assistant turn, with all turns before it as context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of the template; texts never contain their first two characters unescaped.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: The role whose turns are trained on.
TARGET = "assistant"


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\\`` and ``<|`` becomes ``<\|``, so no control string is left; null becomes empty."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def chat_examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  target: str = TARGET) -> DataFrame:
    """One training example for every ``target`` turn.

    A turn is written as ``<|im_start|>role<|im_sep|>text<|im_end|>`` with role and text escaped.
    An example holds all turns of its conversation up to and including its target turn; only the
    text of that turn, code points ``loss_start`` to ``loss_end`` of ``text``, is trainable. If a
    conversation does not end with a target turn, one more example without a trainable part
    holds it whole, so nothing of a conversation is lost.

    One shuffle by conversation orders its turns, sums lengths and joins the whole text, which
    must fit in one row as its last example does; examples are cut from it one at a time.

    Columns: the conversation, example (from 0), n_turns, text, loss_start, loss_end, trainable,
    whole (holds every turn). Turns are ordered by number, then role, then text, nulls first; repeated
    rows are turns of their own; a null role or text is empty; rows with a null conversation form
    one conversation; other columns are ignored; an empty table gives no rows.
    """
    head = F.concat(F.lit(START), escape(F.col(role)), F.lit(SEP))
    body = escape(F.col(text))
    pieces = turns.select(
        F.col(conv), F.col(turn).alias("_turn"), F.col(role).alias("_role"), F.col(text).alias("_text"),
        F.concat(head, body, F.lit(END)).alias("_piece"), F.length(head).alias("_head"), F.length(body).alias("_body"),
        F.coalesce(F.col(role) == target, F.lit(False)).alias("_target"))
    order = Window.partitionBy(conv).orderBy("_turn", "_role", "_text")
    spans = pieces.select(
        conv, "_piece", "_target", F.row_number().over(order).alias("_n"),
        F.sum(F.length("_piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_end"),
        "_head", "_body", F.length("_piece").alias("_length"))
    start = F.col("_end") - F.col("_length") + F.col("_head")
    whole = (
        spans.groupBy(conv)
        .agg(F.sort_array(F.collect_list(F.struct(
            "_n", "_piece", "_target", "_end", start.alias("_from"), (start + F.col("_body")).alias("_to")))).alias("_turns"))
        .withColumn("_full", F.array_join(F.transform("_turns", lambda t: t["_piece"]), ""))
        .withColumn("_last", F.element_at("_turns", -1)))
    cut = F.transform(
        F.filter("_turns", lambda t: t["_target"]),
        lambda t: F.struct(t["_n"].alias("n"), t["_end"].alias("end"), t["_from"].alias("a"), t["_to"].alias("b"),
                           F.lit(True).alias("trainable")))
    rest = F.array(F.struct(
        F.col("_last._n").alias("n"), F.col("_last._end").alias("end"), F.col("_last._end").alias("a"),
        F.col("_last._end").alias("b"), F.lit(False).alias("trainable")))
    examples = whole.select(
        conv, "_full", F.col("_last._n").alias("_all"),
        F.posexplode(F.when(F.col("_last._target"), cut).otherwise(F.concat(cut, rest))).alias("example", "_cut"))
    return examples.select(
        conv, "example", F.col("_cut.n").alias("n_turns"),
        F.substring("_full", F.lit(1), F.col("_cut.end").cast("int")).alias("text"),
        F.col("_cut.a").alias("loss_start"), F.col("_cut.b").alias("loss_end"), F.col("_cut.trainable").alias("trainable"),
        (F.col("_cut.n") == F.col("_all")).alias("whole"))


def read_turns(text: Column) -> Column:
    """The turns (role, text) written in an example, unescaped."""
    written = F.split(text, r"<\|im_end\|>", -1)
    turns = F.slice(written, F.lit(1), F.size(written) - 1)
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substring(F.substring_index(t, SEP, 1), F.lit(len(START) + 1), F.length(t))).alias("role"),
        unescape(F.substring(t, F.instr(t, SEP) + len(SEP), F.length(t))).alias("text")))


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substring(text, (start + 1).cast("int"), (end - start).cast("int")))


def digests(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, what can be read back from its examples: turns, trainable text, length."""
    read = examples.select(
        conv, F.struct("example", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss")).alias("loss"),
        F.length("text").cast("long").alias("chars"), F.when(F.col("whole"), F.col("text")).alias("whole"))
    gathered = read.groupBy(conv).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"), F.max("whole").alias("whole"))
    gathered = gathered.withColumn("turns", read_turns(F.col("whole")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return gathered.select(
        conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(lines, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode(F.col("loss"), "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars")
