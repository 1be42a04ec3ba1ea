r"""Chat formatting by event sourcing: fold each conversation's event log into messages, then render.

An event is (conv_id, seq, message_id, kind, role, text). Kinds: ``message`` and ``edit`` set the
message's text, ``regenerate`` empties it for deltas that follow, ``delta`` appends, ``delete``
removes the message (a later event brings it back). A message takes its place by its first event and
its role from the first event that names one.

Template: ``<|im_start|>role\ntext<|im_end|>\n``. Inside a text every ``<``, backslashes, ``|`` gets
one backslash more, so that no control string can occur in it; reading takes one away. A role also
has its backslashes doubled and line feeds written ``\n``.

The result has the formatted string and its segments (text, loss), in order and without gaps; the
assistant's texts are under the loss mask.

Cases: null text and null role are empty; null kind is ``message``; a null conv_id is a conversation
of its own; events of equal seq go by kind, role and text; repeated events all count. No rows give
no conversations. Other columns are ignored. One conversation's output is one string, so it is put
together in one task; deltas of a message are folded before, each message by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # between doubled backslashes, every backslash that is left belongs to a line feed
    parts = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def events_of(rows: DataFrame) -> DataFrame:
    """Whole turns (conv_id, turn, role, text) as one ``message`` event each, repeated rows too."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select(
        "conv_id",
        F.row_number().over(order).cast("long").alias("seq"),
        F.row_number().over(order).cast("long").alias("message_id"),
        F.lit("message").alias("kind"),
        "role",
        "text",
    )


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, place, message_id, role, text) of the event log."""
    e = events.select(
        "conv_id", "message_id",
        F.struct("seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")).alias("e"),
    ).groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list("e")).alias("log"))
    # where the text begins anew for the last time
    last = F.coalesce(F.array_max(F.transform("log", lambda x, i: F.when(x["kind"] != "delta", i + 1).otherwise(0))), F.lit(0))
    since = F.slice("log", F.greatest(last, F.lit(1)), F.size("log"))
    text = F.array_join(F.transform(since, lambda x: F.when(x["kind"].isin("regenerate", "delete"), F.lit("")).otherwise(x["text"])), "")
    gone = (last > 0) & (F.element_at("log", F.greatest(last, F.lit(1)))["kind"] == "delete") & (last == F.size("log"))
    role = F.element_at(F.transform(F.filter("log", lambda x: x["role"].isNotNull()), lambda x: x["role"]), 1)
    role = F.when(F.exists("log", lambda x: x["role"].isNotNull()), role).otherwise("")
    return e.select(
        "conv_id", F.element_at("log", 1)["seq"].alias("place"), "message_id", role.alias("role"), text.alias("text"), gone.alias("gone")
    ).where(~F.col("gone")).drop("gone")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, segments, formatted): segments are (text, loss) and make up formatted."""
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "message_id", "role", "text"))).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")), F.lit(False)),
                segment(escape(t["text"]), t["role"] == TRAINED_ROLE),
                segment(F.lit(END + "\n"), F.lit(False)),
            ),
        )
    )
    out = turns.select("conv_id", segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold(events))


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>>, read back from a formatted string."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, F.greatest(F.size(F.split(formatted, r"<\|im_start\|>")), F.lit(1)))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - len(END) - 2)
        return F.struct(_unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def read_loss(segments: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
