"""Operator 10, chat formatting: conversations rebuilt from event logs, in SQL functions only.

A log row is an event of one message: ``message`` sets its role and text, ``delta`` appends
streamed text, ``edit`` replaces the text, ``regenerate`` empties it so that later deltas
begin anew, ``delete`` takes it away. Logs are partitioned by conversation and message,
sorted by sequence, and folded: what counts is the last event that sets the text, and the
deltas after it. Messages come in the order of their first event and are rendered as

    <|im_start|>role\\ntext<|im_end|>\\n

Texts and roles are escaped first: ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``, and a
line break in a role ``&#10;``, so no text can hold a marker and ``unescape`` restores each.
The loss mask is a list of pieces: the formatted string is their concatenation, and those
with ``loss`` (assistant texts) are trained on.

Folding and rendering work on single messages; only finished pieces are brought together,
as one conversation is one output record. Hot conversations are folded message by message,
in as many tasks as there are.

Edge cases: null texts and roles are empty; ties in sequence are folded in order of event
kind, role and a hash of the text; repeated events count as often as they occur (in a table of
turns, a repeated row is one more turn; equal turns come in order of role and text); unknown event kinds and
rows without a conversation are left out; a deleted message gives no turn; an empty table
gives no conversations. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
KINDS = ("message", "regenerate", "edit", "delta", "delete")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _role_out(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def fold(events: DataFrame, keys: tuple[str, ...] = ("message_id",)) -> DataFrame:
    """conv_id, keys, at (the sequence of its first event), role and text of every message that is left.

    ``events`` has conv_id, the keys of a message, seq, kind, role and text. Windows sort by
    small columns only, and a log that is already partitioned by conversation and message
    keys is not shuffled again.
    """
    kind = F.when(F.col("kind").isin(*KINDS), F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
    events = events.where("conv_id is not null").withColumn("k", kind).where("k is not null")
    events = events.select("conv_id", *keys, "seq", "k", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.struct("seq", "k", "role", F.xxhash64("text").alias("h"))
    message = Window.partitionBy("conv_id", *keys)
    events = events.withColumn("e", order).withColumns({
        "last_set": F.max(F.when(F.col("k") != 4, F.col("e"))).over(message), "at": F.min("e").over(message),
        "named": F.max(F.when(F.col("role") != "", F.col("e"))).over(message),
    }).where("last_set is null or (e >= last_set and last_set.k != 5)")
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("e", "text"))), lambda x: F.when(x["e"]["k"] == 2, "").otherwise(x["text"])))
    return events.groupBy("conv_id", *keys).agg(F.first("at")["seq"].alias("at"), F.coalesce(F.first("named")["role"], F.lit("")).alias("role"), text.alias("text"))


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as a log of ``message`` events keyed by turn and nth; equal turns stay separate messages."""
    each = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return conversations.select("conv_id", "turn", F.row_number().over(each).alias("nth"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def replayed(conversations: DataFrame) -> DataFrame:
    """A table of turns as the log of how they might have come about; folding it gives the turns again.

    A hash of the turn decides: the message at once; streamed deltas; a draft and its edit; or
    a draft, its regeneration and the deltas of that. Every seventh turn is followed by a
    message that is deleted again. Texts are sent once, only drafts come on top.
    """
    each = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", "turn", F.row_number().over(each).alias("nth"), "role", F.coalesce("text", F.lit("")).alias("text"))
    way = F.pmod(F.xxhash64("conv_id", "turn", "nth"), F.lit(28))
    size = F.ceil(F.length("text") / 3).cast("int")
    draft, none = F.lit("<|im_end|> a draft & no more"), F.lit("")

    def event(step: int, kind: str, text: Column, role: Column | None = None, nth: Column | None = None) -> Column:
        return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), (none if role is None else role).alias("role"), text.alias("text"), (F.col("nth") if nth is None else nth).alias("nth"))

    deltas = [event(4 + i, "delta", F.substr("text", F.lit(i) * size + 1, size)) for i in range(3)]
    role = F.coalesce("role", none)
    ways = [
        [event(1, "message", F.col("text"), role)],
        [event(1, "message", none, role), *deltas],
        [event(1, "message", draft, role), event(2, "delta", draft), event(3, "edit", F.col("text"))],
        [event(1, "message", draft, role), event(2, "delta", draft), event(3, "regenerate", none), *deltas],
    ]
    events = F.when(way % 4 == 0, F.array(*ways[0]))
    for k in (1, 2, 3):
        events = events.when(way % 4 == k, F.array(*ways[k]))
    stray = F.array(event(8, "message", draft, role, -F.col("nth")), event(9, "delete", none, None, -F.col("nth")))
    events = F.concat(events, F.when(way < 4, stray).otherwise(F.slice(stray, 1, 0)))
    return rows.select("conv_id", "turn", F.explode(events).alias("x")).select("conv_id", "turn", "x.nth", F.struct("turn", "x.step").alias("seq"), "x.kind", "x.role", "x.text")


def render(messages: DataFrame, keys: tuple[str, ...] = ("message_id",)) -> DataFrame:
    """conv_id, formatted, and pieces (text, loss) whose concatenation it is."""
    pieces = F.array(
        F.struct(F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(F.col("text")).alias("text"), (F.col("role") == LOSS_ROLE).alias("loss")),
        F.struct(F.lit(f"{END}\n").alias("text"), F.lit(False).alias("loss")),
    )
    one = messages.select("conv_id", F.struct("at", *keys, pieces.alias("p")).alias("m"))
    whole = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    whole = whole.select("conv_id", F.flatten(F.transform("ms", lambda m: m["p"])).alias("pieces"))
    return whole.select("conv_id", F.concat_ws("", F.transform("pieces", lambda p: p["text"])).alias("formatted"), "pieces")


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string."""
    blocks = F.split(formatted, r"<\|im_end\|>\n")
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    body = F.transform(blocks, lambda b: F.substr(b, F.lit(len(START) + 1)))
    return F.transform(body, lambda b: F.struct(_role_in(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substr(b, F.locate("\n", b) + 1)).alias("text")))


def digests(rendered: DataFrame) -> DataFrame:
    """What the output says when it is read back."""
    turns = rendered.select("conv_id", "formatted", "pieces", parse(F.col("formatted")).alias("turns"))
    loss = F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescape(p["text"]))
    turns = turns.select("conv_id", "turns", F.concat_ws("", loss).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    keys = ("turn", "nth")
    return render(fold(as_events(conversations), keys), keys)


def format_replayed(conversations: DataFrame) -> DataFrame:
    keys = ("turn", "nth")
    return render(fold(replayed(conversations), keys), keys)


ORACLE_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
), turns AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS nth, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows_
), sized AS (
  SELECT *, length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) + length('<|im_start|><|im_end|>') + 2 AS n FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, nth)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, nth) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
