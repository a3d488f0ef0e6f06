"""A chat's event stream as one stateful query: frames from pieces of text, delta batches, lifecycles; and the same in batch.

Each trace keeps the rest of an unfinished frame, the deltas of the open batch, and a map of
facts (model, project and the like; nulls never overwrite values). A trace that sends nothing
for ``idle`` of event time is closed by its timer: the batch is flushed, the lifecycle row is
written and the state goes, unfinished frame and all, so no trace is kept for ever. State
lives in the query's checkpoint: a query that is started again goes on in the middle of a frame.

Rows are of two kinds. ``batch`` has the deltas of a trace that were joined up to ``limit``
bytes or to its next other event, with the number of the batch. ``lifecycle`` comes once for
each time a trace closes: events, first and last of them, first delta, bytes of deltas,
status and facts. Completed is never overwritten; failed and cancelled follow their order.
A trace that sends again after it was closed is a new one, numbered from 0.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "trace string, kind string, number long, text string, n_events long, first_seq long, last_seq long, first_delta long, delta_bytes long, status string, facts map<string,string>"
STATE = "rest string, seq long, batch long, held string, first_seq long, last_seq long, first_delta long, delta_bytes long, status string, facts map<string,string>, n_events long"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]
#: A frame longer than this is not waited for; what it has is dropped with it.
MAX_REST = 1 << 20
_END = re.compile("\r?\n\r?\n")
_ENDS = {"done": "completed", "error": "failed", "cancelled": "cancelled"}
FACTS = ("model", "project_id", "index_id", "reason")


class Trace:
    """What a trace has sent so far."""

    def __init__(self, state: tuple | None = None):
        (self.rest, self.seq, self.batch, self.held, self.first_seq, self.last_seq, self.first_delta, self.delta_bytes, self.status, self.facts, self.n_events) = state or ("", 0, 0, "", None, None, None, 0, "running", {}, 0)
        self.facts = dict(self.facts or {})

    def state(self) -> tuple:
        return self.rest, self.seq, self.batch, self.held, self.first_seq, self.last_seq, self.first_delta, self.delta_bytes, self.status, self.facts, self.n_events

    def take(self, text: str) -> Iterator[tuple]:
        """Numbered delta batches that a piece of text completes."""
        *whole, self.rest = _END.split(self.rest + text)
        if len(self.rest) > MAX_REST:
            self.rest = ""
        for block in whole:
            seq, self.seq = self.seq, self.seq + 1
            fields = [line.partition(":")[::2] for line in block.splitlines()]
            try:
                data = json.loads("\n".join(v.removeprefix(" ") for k, v in fields if k == "data"))
            except ValueError:
                continue
            if isinstance(data, dict):
                yield from self.event(seq, next((v.strip() for k, v in fields if k == "event"), "message"), data)

    def event(self, seq: int, name: str, data: dict) -> Iterator[tuple]:
        self.n_events += 1
        self.first_seq = seq if self.first_seq is None else self.first_seq
        self.last_seq = seq
        told = data.get("metadata")
        self.facts |= {k: str(v) for k, v in (told if isinstance(told, dict) else {}).items() if k in FACTS and v is not None}
        if name == "delta":
            text = data.get("text") if isinstance(data.get("text"), str) else ""
            self.first_delta = seq if self.first_delta is None else self.first_delta
            self.delta_bytes += len(text.encode("utf-8", "surrogatepass"))
            self.held += text
            if len(self.held.encode("utf-8", "surrogatepass")) >= self.limit:
                yield self.flush()
        else:
            if self.held:
                yield self.flush()
            if name in _ENDS and self.status != "completed":
                self.status = _ENDS[name]

    limit = 2048

    def flush(self) -> tuple:
        number, text, self.batch, self.held = self.batch, self.held, self.batch + 1, ""
        return number, text

    def closed(self) -> tuple:
        return self.n_events, self.first_seq, self.last_seq, self.first_delta, self.delta_bytes, self.status, self.facts


def _batch_row(trace: str, number: int, text: str) -> tuple:
    return (trace, "batch", number, text, *[None] * 7)


def _closing(trace: str, held: Trace) -> list[tuple]:
    rows = [_batch_row(trace, *held.flush())] if held.held else []
    return [*rows, (trace, "lifecycle", None, None, *held.closed())]


def _frame(rows: list[tuple]):
    import pandas as pd

    return pd.DataFrame(rows, columns=COLUMNS).astype({c: "Int64" for c in ("number", "n_events", "first_seq", "last_seq", "first_delta", "delta_bytes")})


def chat_stream(pieces: DataFrame, limit: int = 2048, idle: str = "30 minutes", late: str = "0 seconds") -> DataFrame:
    """A stream of (trace, ts, seq, piece) as a stream of ``OUT`` rows; pieces of one trace come in files in order, and in a file by seq."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    seconds = pieces.sparkSession.sql(f"SELECT unix_seconds(timestamp'1970-01-01 00:00:00Z' + interval {idle})").first()[0]

    def fold(key, frames, state):
        import pandas as pd

        held = Trace(state.get if state.exists else None)
        held.limit = limit
        if state.hasTimedOut:
            state.remove()
            yield _frame(_closing(key[0], held))
            return
        rows = []
        whole = pd.concat(list(frames))  # the pieces of one trace in one trigger
        for piece in whole.sort_values(["ts", "seq"]).piece:
            rows += [_batch_row(key[0], *b) for b in held.take(piece or "")]
        newest = int(whole.ts.max().timestamp() * 1000)
        state.update(held.state())
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + seconds * 1000)
        yield _frame(rows)

    timed = pieces.select("trace", F.col("ts").cast("timestamp").alias("ts"), "seq", "piece").withWatermark("ts", late)
    return timed.groupBy("trace").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def chat_batch(pieces: DataFrame, limit: int = 2048) -> DataFrame:
    """The same rows of a table (trace, ts, seq, piece) in which every trace has ended, by a fold over sorted rows that holds one trace's state."""
    def fold(batches):
        trace, held, rows = None, None, []
        for batch in batches:
            for key, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held is None or key != trace:
                    rows += _closing(trace, held) if held is not None else []
                    trace, held = key, Trace()
                    held.limit = limit
                rows += [_batch_row(trace, *b) for b in held.take(piece or "")]
            if rows:
                yield _arrow(rows)
                rows = []
        if held is not None:
            yield _arrow(_closing(trace, held))

    def _arrow(rows):
        import pyarrow as pa

        kinds = {"string": pa.string(), "long": pa.int64(), "map<string,string>": pa.map_(pa.string(), pa.string())}
        return pa.RecordBatch.from_arrays([pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], kinds[f.split(" ", 1)[1]]) for c, f in zip(zip(*rows, strict=True), OUT.split(", "), strict=True)], names=COLUMNS)

    dealt = pieces.where("trace is not null").repartition("trace").sortWithinPartitions("trace", "ts", "seq")
    return dealt.select("trace", "piece").mapInArrow(fold, OUT)
