"""Event-sourced chat reconstruction and formatting (operator 3), DataFrame functions only.

The log holds events (conv_id, seq, msg, role, kind, text):

* ``delta``      appends its text to message ``msg``;
* ``edit``       sets the text of message ``msg`` and withdraws the later messages logged so far;
* ``regenerate`` clears message ``msg``, to be streamed anew, and withdraws the later messages
  logged so far.

The log is partitioned by conversation and read in the order of ``seq``. An event counts unless a
later edit or regeneration of its message, or of an earlier message of the conversation, withdraws
it; a message is the concatenation of its events that count, in order; a message without such
events disappears. Messages are rendered as ``### role: text</turn>`` lines. Inside a text the
characters that control strings need are escaped (\\b for the backslash, \\l for <, \\h for #), so no
control string can appear in a text, and unescaping gives it back exactly.

The result has one row per conversation: ``formatted``, ``mask`` (start and length, in code points
of ``formatted``, of every assistant text), and ``starts`` (where each turn starts). Message texts
are folded per (conversation, message) first; a conversation is one row of output, so it is the
unit that a task must hold. Offsets are running sums in a window, linear in the conversation.

Null text counts as empty and null role as an empty role; rows of a null conv_id form one
conversation with a null id; events that tie in ``seq`` are read in the order of msg, kind, text;
repeated events are repeated; an empty log gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Control strings of the template and the escapes (fixed values).
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = ESCAPES + ((":", "\\c"),)
ASSISTANT = "assistant"


def escape(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def turn_events(turns: DataFrame) -> DataFrame:
    """A log of rows (conv_id, turn, role, text): every message is streamed as two deltas. Turns
    are numbered in the order of turn, then role and text, so repeated turns stay apart."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    half = F.floor(F.char_length("text") / 2).cast("int")
    return (turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
            .withColumn("msg", F.row_number().over(order).cast("long"))
            .withColumn("part", F.explode(F.array(
                F.struct(F.lit(0).alias("k"), F.substring("text", F.lit(1), half).alias("text")),
                F.struct(F.lit(1).alias("k"), F.substring("text", half + 1, F.char_length("text")).alias("text")))))
            .select("conv_id", (2 * F.col("msg") + F.col("part.k")).alias("seq"), "msg", "role",
                    F.lit("delta").alias("kind"), F.col("part.text").alias("text")))


def fold_messages(log: DataFrame) -> DataFrame:
    """conv_id, msg, role and the final text of every message that remains."""
    events = log.select("conv_id", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"),
                        F.coalesce("msg", F.lit(0)).cast("long").alias("msg"),
                        F.coalesce("role", F.lit("")).alias("role"), "kind",
                        F.coalesce("text", F.lit("")).alias("text"))
    # the last reset at or before each message, seen by the messages from there on
    resets = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq")))
    upto = Window.partitionBy("conv_id").orderBy("msg").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).over(upto)
    own = resets.over(Window.partitionBy("conv_id", "msg"))
    live = events.withColumn("cut", cut).withColumn("own", own).filter(
        F.col("cut").isNull() | (F.col("seq") > F.col("cut"))
        | (F.col("seq") == F.col("cut")) & (F.col("own") == F.col("cut")) & (F.col("kind") != "delta"))
    parts = F.sort_array(F.collect_list(F.struct("seq", "kind", "text")))
    return live.groupBy("conv_id", "msg").agg(
        F.max("role").alias("role"),
        F.array_join(F.transform(parts, lambda e: F.when(e["kind"] == "regenerate", "").otherwise(e["text"])), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted``, ``mask`` and ``starts``."""
    body = escape(F.col("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit(COLON))
    seg = messages.select("conv_id", "msg", "role", F.char_length(body).alias("n"), F.char_length(head).alias("h"),
                          F.concat(head, body, F.lit(CLOSE)).alias("seg"))
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("start", F.coalesce(F.sum(F.char_length("seg").cast("long")).over(before), F.lit(0).cast("long")))
    turns = F.sort_array(F.collect_list(F.struct(
        "msg", "start", "seg", (F.col("start") + F.col("h")).alias("at"), F.col("n").cast("long").alias("n"),
        (F.col("role") == ASSISTANT).alias("loss"))))
    one = seg.groupBy("conv_id").agg(turns.alias("t"))
    return one.select(
        "conv_id", F.array_join(F.col("t.seg"), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["loss"]),
                    lambda x: F.struct(x["at"].alias("start"), x["n"].alias("length"))).alias("mask"),
        F.col("t.start").alias("starts"))


def format_log(log: DataFrame) -> DataFrame:
    """Fold an event log into messages and render every conversation."""
    return render(fold_messages(log))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id``, ``turns`` (role, text) and ``loss_text`` (all text under the mask, unescaped)
    read from the rendered text alone and its mask."""
    segs = F.slice(F.split("formatted", CLOSE, -1), 1, F.size(F.split("formatted", CLOSE, -1)) - 1)
    at = len(OPEN) + 1
    colon = lambda s: F.instr(s, COLON)
    parsed = lambda s: F.struct(
        unescape(F.substring(s, F.lit(at), colon(s) - at), ROLE_ESCAPES).alias("role"),
        unescape(F.substring(s, colon(s) + len(COLON), F.char_length(s))).alias("text"))
    # each masked span lies in one turn: cut it out of that turn's own text
    rows = formatted.select("conv_id", "formatted", segs.alias("segs"), "starts", "mask")
    cut = F.aggregate(
        F.arrays_zip("segs", "starts"),
        F.struct(F.lit(0).alias("k"), F.array().cast("array<string>").alias("out")),
        lambda st, z: F.when(
            (st["k"] < F.size("mask")) & (F.col("mask")[st["k"]]["start"] <= z["starts"] + F.char_length(z["segs"])),
            F.struct((st["k"] + 1).alias("k"), F.concat(st["out"], F.array(F.substring(
                z["segs"], (F.col("mask")[st["k"]]["start"] - z["starts"] + 1).cast("int"),
                F.col("mask")[st["k"]]["length"].cast("int")))).alias("out"))).otherwise(st),
        lambda st: st["out"])
    return rows.select("conv_id", "formatted", F.transform("segs", parsed).alias("turns"),
                       unescape(F.array_join(cut, "")).alias("loss_text"))
