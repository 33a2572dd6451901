"""Chat formatting: conversations rebuilt from a log of events and rendered with a loss mask. DataFrame functions only.

An event has conv_id, turn, seq, op, role and text. Within a conversation events are folded in order of seq (ties: by op, role and text):

- message: opens the turn or sets its whole text,
- delta: adds its text to the turn's,
- edit: sets the turn's whole text,
- regenerate: sets the turn's whole text anew and takes back all later turns logged before it.

A turn's role is that of its last event with a role; a null role or text counts as empty, a null op as message, a null
turn comes before all others and a null conv_id is a conversation of its own. A delta without a message opens its turn.

Rendering: <|im_start|>role, a line feed, the text, <|im_end|> and a line feed for each turn. Inside roles and texts the
opening <| of control strings becomes "<", ESCAPE, "1|" and ESCAPE itself ESCAPE, "0", so no text can forge a mark and
unescape() gives back every text as it was; a line feed in a role becomes ESCAPE, "2". The output is a list of segments
whose texts joined are the formatted string; the mask is each segment's loss flag, set on assistant texts alone.

First each turn's events are folded under (conv_id, turn), then turns under conv_id: a row holds a turn or a rendered
conversation, which is what the result is made of, and never an unbounded group of events across turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, ESCAPE = "<|im_start|>", "<|im_end|>", "␛"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit("<|"), F.lit(f"<{ESCAPE}1|"))
    return F.replace(out, F.lit("\n"), F.lit(ESCAPE + "2")) if role else out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit(ESCAPE + "2"), F.lit("\n")), F.lit(f"<{ESCAPE}1|"), F.lit("<|"))
    return F.replace(out, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def events_of(turns: DataFrame) -> DataFrame:
    """Rows by turn as a log of message events, in order of turn. Rows of one turn become turns one after another."""
    # equal (conv_id, turn) rows stay rows of their own: the text's digest tells them apart, copies count by their number
    key = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    each = turns.select("conv_id", "turn", key.alias("k")).groupBy("conv_id", "turn", "k").agg(F.count("*").alias("n"))
    rows = each.select("conv_id", "turn", "k.role", "k.text", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    place = F.struct(F.col("turn"), F.col("role"), F.sha2("text", 256).alias("mark"), F.col("copy"))
    return rows.select("conv_id", place.alias("turn"), place.alias("seq"), F.lit("message").alias("op"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final turns of each conversation."""
    op = F.coalesce("op", F.lit("message"))
    log = events.select("conv_id", "turn", "seq", op.alias("op"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    item = F.struct("seq", "op", "role", "text")
    turns = log.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(item)).alias("log"), F.max("seq").alias("last"))
    # the text is what the last whole text and the deltas after it make up
    whole = F.array_max(F.transform("log", lambda e, i: F.when(e.op != "delta", i).otherwise(-1)))
    text = F.array_join(F.transform(F.filter("log", lambda e, i: i >= whole), lambda e: e.text), "")
    roles = F.filter(F.transform("log", lambda e: e.role), lambda r: r.isNotNull())
    turns = turns.select("conv_id", "turn", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), text.alias("text"), F.col("last"))
    # a turn is taken back by a regeneration of an earlier turn that was logged after its last event
    redone = log.where("op = 'regenerate'").groupBy("conv_id", "turn").agg(F.max("seq").alias("at"))
    redone = redone.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "at")).alias("redone")).toDF("_conv", "redone")
    kept = turns.join(redone, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    gone = F.exists("redone", lambda r: (r.turn < F.col("turn")) & (r.at > F.col("last")))
    return kept.where(~F.coalesce(gone, F.lit(False))).select("conv_id", "turn", "role", "text")


def render(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """(conv_id, segments, formatted): segments is an array of struct<text, loss>, formatted their texts joined."""
    parts = F.array(
        F.struct(F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(F.col("text")).alias("text"), (F.col("role") == learned).alias("loss")),
        F.struct(F.lit(CLOSE + "\n").alias("text"), F.lit(False).alias("loss")),
    )
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", parts.alias("parts")))).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: t.parts))
    convs = convs.select("conv_id", segments.alias("segments"))
    return convs.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted string: array of struct<role, text>, unescaped."""
    bodies = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b, i: i > 0)

    def turn(body: Column) -> Column:
        head = F.instr(body, "\n")
        text = F.substring(body, head + 1, F.char_length(body) - head - len(CLOSE) - 1)
        return F.struct(unescape(F.substring(body, F.lit(1), head - 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(bodies, turn)


def digests(rendered: DataFrame) -> DataFrame:
    """Reads the output back: n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars for each conversation."""
    turns = F.array_join(F.transform(parse(F.col("formatted")), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text)), "")
    read = rendered.select("conv_id", F.size(parse(F.col("formatted"))).cast("long").alias("n_turns"), turns.alias("turns"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
