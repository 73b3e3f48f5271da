"""Chat formatting from event logs, with DataFrame functions only.

A log has a row for each event: conversation, sequence number, kind, turn, role and text.
- `message`: the turn's text, whole; `edit`: the text that replaces what the turn had; `regenerate`: what the turn had is void (its text, if any, begins anew);
- `delta`: text that is appended; `retract`: the turn is withdrawn, until a later event brings it back.
Events are sorted by sequence; a turn's final text is that of its last message, edit or regenerate and of the deltas after it. The role is the last one given
in the turn. Rows of one turn with equal sequence numbers are sorted by kind (message, edit, regenerate, retract before delta), then text. Unknown kinds count
as message. Turns are folded first, each on its own (a conversation of any length is spread over its turns); then a conversation's messages are
sorted by turn, nulls first, and rendered to one string, which is the only thing that needs a conversation in one place.

Rendering: BEGIN, then per turn OPEN role MIDDLE text CLOSE. Inside roles and texts every `~` becomes `~~` and every control string has `~` put after
its first character; that undoes without loss, and no control string is left for a reader to find. Null roles and texts are empty. Conversations with no turns have no
row; a null conversation id is one conversation. With `mask`, turns of the trained roles end with CLOSE after a LOSS mark, so that
the loss mask (what a model is trained on) can be read back from the string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import q

BEGIN, OPEN, MIDDLE, CLOSE, LOSS = "<|begin|>", "<|turn|>", "<|says|>", "<|end|>", "<|learn|>"
#: Every string that a template of this or a common kind takes as a command.
CONTROLS = (BEGIN, OPEN, MIDDLE, CLOSE, LOSS, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>")
ESCAPE = "~"
KINDS = ("message", "edit", "regenerate", "retract", "delta")


def escaped(text: Column) -> Column:
    """text without control strings, reversibly."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    """What escaped() was given: a single `~` goes, a doubled one is one. Runs of them are never ambiguous, read from the left: a
    put-in `~` follows `<` or `[` and precedes a character that is no `~`."""
    return F.regexp_replace(F.regexp_replace(text, "(?<=[<\\[])~(?=[^~])", ""), "~~", "~")


def fold(events: DataFrame, conversation: str = "conv_id", sequence: str = "seq", kind: str = "kind", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The final messages: conversation, turn, role, text, a row for each turn that is not retracted."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), q(kind)).cast("int"), F.lit(0))
    event = F.struct(q(sequence).alias("s"), F.when(order == 0, 1).otherwise(order).alias("k"), F.coalesce(q(text), F.lit("")).alias("t"), q(role).alias("r"))
    turns = events.select(q(conversation).alias("conversation"), q(turn).alias("turn"), event.alias("e")).groupBy("conversation", "turn").agg(F.sort_array(F.collect_list("e")).alias("e"))
    # The place of the last event that sets the text, and what has come since: filter() passes places, so this is linear in the events.
    places = F.filter(F.transform("e", lambda x, i: F.when(x.k < 5, i)), lambda i: i.isNotNull())
    turns = turns.withColumn("last", F.coalesce(F.array_max(places), F.lit(0)))
    live = turns.where((F.get("e", F.col("last")).k != 4) | (F.size("e") > F.col("last") + 1))
    kept = F.slice("e", F.col("last") + 1, F.size("e"))
    said = F.array_join(F.transform(kept, lambda x: F.when(x.k == 4, F.lit("")).otherwise(x.t)), "")
    roles = F.filter(F.transform("e", lambda x: x.r), lambda r: r.isNotNull())
    return live.select("conversation", "turn", F.coalesce(F.element_at(F.when(F.size(roles) > 0, roles), -1), F.lit("")).alias("role"), said.alias("text"))


def render(messages: DataFrame, learn_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conversation, formatted): each conversation of folded messages as one string."""
    mark = F.when(F.col("role").isin(*learn_roles), F.lit(LOSS)).otherwise(F.lit(""))
    part = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE), escaped(F.col("text")), mark, F.lit(CLOSE))
    whole = F.sort_array(F.collect_list(F.struct("turn", part.alias("part"))))
    return messages.groupBy("conversation").agg(F.concat(F.lit(BEGIN), F.array_join(F.transform(whole, lambda x: x.part), "")).alias("formatted"))


def format_chats(events: DataFrame, learn_roles: tuple[str, ...] = ("assistant",), **columns: str) -> DataFrame:
    """fold(), then render()."""
    return render(fold(events, **columns), learn_roles)


def parse(formatted: DataFrame) -> DataFrame:
    """formatted with messages: an array of (role, text, learn) read back from the strings, texts and roles as they were before escaping."""
    turns = F.split(F.expr(f"substring(formatted, {len(BEGIN) + len(OPEN) + 1})"), "\\Q" + CLOSE + "\\E(?:\\Q" + OPEN + "\\E)?")
    turns = F.slice(turns, 1, F.size(turns) - 1)  # nothing follows the last CLOSE

    def message(turn: Column) -> Column:
        text, learn = F.substring_index(turn, MIDDLE, -1), turn.endswith(LOSS)
        text = F.when(learn, text.substr(F.lit(1), F.length(text) - len(LOSS))).otherwise(text)
        return F.struct(unescaped(F.substring_index(turn, MIDDLE, 1)).alias("role"), unescaped(text).alias("text"), learn.alias("learn"))

    return formatted.withColumn("messages", F.transform(turns, message))
