"""Chat formatting by event-sourced reconstruction (DataFrame operations only).

An event log has the columns ``conv_id, message_id, seq, op, role, text``.
``seq`` may be of any type that can be ordered. ``op`` is one of

- ``message``: creates the message or sets its whole text;
- ``delta``: appends to the message's text (streamed pieces);
- ``edit``: replaces the text, later deltas append to it;
- ``regenerate``: clears the text for new deltas, and drops every message
  that came after this one before the regeneration (the old branch);
- ``retract``: removes the message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """Backslash becomes ``\\s``, ``<|`` becomes ``<\\p``: no control string is left, and it can be undone."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\p"), F.lit("<|")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """``(conv_id, position, role, text)``: the final messages of an event log.

    A message's position is the ``seq`` of its first event, its role that of
    its earliest event with a role (none: empty). Null texts are empty, events
    of one message with equal ``seq`` apply in the order of their text, a null
    ``conv_id`` or ``message_id`` is an identifier like any other, unknown ops
    are ignored. An empty log gives no rows; other columns are ignored.

    Superseded events are dropped before texts are gathered: the last reset of
    each message is a map-side combined maximum, and only events from it on
    are concatenated.
    """
    e = events.select("conv_id", "message_id", "seq", "op", F.coalesce("role", F.lit("")).alias("role"),
                      F.coalesce("text", F.lit("")).alias("text"), F.col("role").isNotNull().alias("has_role"))
    e = e.where(F.col("op").isin("message", "delta", "edit", "regenerate", "retract"))
    heads = e.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("position"),
        F.max(F.when(F.col("op").isin("message", "edit", "regenerate"), F.col("seq"))).alias("reset"),
        F.max(F.when(F.col("op") == "regenerate", F.col("seq"))).alias("regen"),
        F.max(F.when(F.col("op") == "retract", F.col("seq"))).alias("retract"),
        F.min(F.when(F.col("has_role"), F.struct("seq", "role"))).getField("role").alias("role"))
    own = Window.partitionBy("conv_id").orderBy("position", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    heads = (heads.withColumn("branch", F.max("regen").over(own))
             .where(F.coalesce(F.col("branch") <= F.col("position"), F.lit(True)) & F.col("retract").isNull()))
    h, x = heads.alias("h"), e.where(F.col("op") != "retract").alias("x")
    live = (x.join(h, F.col("x.conv_id").eqNullSafe(F.col("h.conv_id"))
                   & F.col("x.message_id").eqNullSafe(F.col("h.message_id")))
            .where(F.coalesce(F.col("x.seq") >= F.col("h.reset"), F.lit(True))))
    texts = live.groupBy(F.col("h.conv_id").alias("conv_id"), F.col("h.message_id").alias("message_id"),
                         F.col("h.position").alias("position"), F.coalesce("h.role", F.lit("")).alias("role")).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("x.seq").alias("seq"), (F.col("x.op") == "delta").alias("piece"), F.col("x.text").alias("text")))).alias("parts"))
    text = F.array_join(F.transform(F.filter("parts", lambda p: p["text"] != ""), lambda p: p["text"]), "")
    return texts.select("conv_id", "position", "message_id", "role", text.alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, loss_spans``.

    A turn is ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` with control strings inside
    escaped. ``loss_spans`` is the loss mask: an array of ``(turn, start,
    length)`` in code points of that turn's rendered piece, exactly the text of
    each assistant turn, its end mark left out. Turns go by position, then
    message identifier.
    """
    body, head = escape(F.col("text")), F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = messages.select(
        "conv_id", F.struct(
            "position", "message_id", F.concat(head, body, F.lit(END)).alias("piece"),
            F.when(F.col("role") == loss_role, F.struct(F.length(head).alias("start"), F.length(body).alias("length")))
            .alias("loss")).alias("t"))
    conv = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    spans = F.filter(F.transform("ts", lambda t, i: F.struct(
        i.alias("turn"), t["loss"]["start"].alias("start"), t["loss"]["length"].alias("length"))),
        lambda s: s["start"].isNotNull())
    return conv.select("conv_id", F.size("ts").cast("bigint").alias("n_turns"),
                       F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("formatted"),
                       spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_texts``: roles and texts parsed from the output, and the texts under the mask."""
    pieces = formatted.withColumn("pieces", F.filter(
        F.split("formatted", r"<\|im_end\|>\n"), lambda p: F.startswith(p, F.lit(START))))
    after = lambda p: F.substr(p, F.lit(len(START) + 1))
    role = lambda p: F.substring_index(after(p), "\n", 1)
    turns = F.transform("pieces", lambda p: F.struct(
        unescape_role(role(p)).alias("role"),
        unescape(F.substr(after(p), F.length(role(p)) + 2)).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(
        F.substr(F.get(F.col("pieces"), s["turn"]), s["start"] + 1, s["length"])))
    return pieces.select("conv_id", "n_turns", "formatted", turns.alias("turns"), loss.alias("loss_texts"))


def conversation_events(turns: DataFrame, delta_chars: int = 400) -> DataFrame:
    """The event log of a table ``(conv_id, turn, role, text)``, one message per row.

    Assistant texts stream as deltas of ``delta_chars`` code points after an
    empty ``message``; others are one ``message``. Rows go by turn, then role,
    then hashes of the text; repeated rows are counted and are messages of
    their own. Message identifiers follow from the rows alone, so a task that
    runs again gives the same. Null texts are empty, very long ones are cut
    into deltas or stay one message; other columns are ignored.
    """
    t = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    t = t.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).select(
        "*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("row"))
    t = t.select(
        "conv_id", F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.xxhash64("text").alias("tie"),
                            F.md5("text").alias("digest"), F.col("row").alias("row")).alias("at"), "role", "text")
    streamed = F.col("role") == "assistant"
    n = F.when(streamed, F.ceil(F.length("text") / delta_chars).cast("int")).otherwise(0)
    piece = lambda i: F.struct(
        i.alias("part"), F.when(i == 0, "message").otherwise("delta").alias("op"),
        F.when(~F.coalesce(streamed, F.lit(False)), F.col("text")).when(i == 0, "")
        .otherwise(F.substr("text", (i - 1) * delta_chars + 1, F.lit(delta_chars))).alias("text"))
    parts = t.select("conv_id", "at", "role", F.explode(F.transform(
        F.sequence(F.lit(0), F.coalesce(n, F.lit(0))), piece)).alias("p"))
    return parts.select("conv_id", F.col("at").alias("message_id"),
                        F.struct(F.col("at.turn").alias("turn"), F.col("at.role").alias("role"), F.col("at.tie").alias("tie"),
                                 F.col("at.digest").alias("digest"), F.col("at.row").alias("row"), F.col("p.part").alias("part")).alias("seq"),
                        F.col("p.op").alias("op"), "role", F.col("p.text").alias("text"))


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Fold an event log and render it; see ``fold_events`` and ``render``."""
    return render(fold_events(events), loss_role)
