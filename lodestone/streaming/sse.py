"""Server-sent event streams: frames, delta batching and lifecycle, in batch and as streams; windows over events."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import folded

FRAME_SCHEMA = "trace string, seq long, event string, data string"


def frames(raw: DataFrame) -> DataFrame:
    """trace, seq, event, data of whole frames in (trace, text); frames without a JSON object are dropped, as is an unfinished last one."""
    blocks = F.split(F.coalesce("text", F.lit("")), "\r?\n\r?\n")
    rows = raw.select("trace", F.posexplode(F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0)))).alias("at", "block"))
    event = F.regexp_extract("block", r"(?m)^event:[ ]?([^\r\n]*)", 1)
    data = F.concat_ws("\n", F.regexp_extract_all("block", F.lit(r"(?m)^data:[ ]?([^\r\n]*)"), F.lit(1)))
    rows = rows.select("trace", F.col("at").cast("long").alias("seq"), F.when(event == "", "message").otherwise(event).alias("event"), data.alias("data"))
    return rows.where(is_json_object(F.col("data")))


def is_json_object(data):
    """Whether a text is one JSON object and nothing after it."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(data)).startswith("OBJECT") & F.rtrim(data, F.lit(" \t\r\n")).endswith("}"), F.lit(False))


def serialise(event, data):
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def batch_deltas(events: DataFrame, limit: int) -> DataFrame:
    """trace, batch and joined text: buffered deltas are flushed at ``limit`` bytes or at the next other event."""

    def start():
        batch, held = 0, 0

        def step(kind, size):
            nonlocal batch, held
            mine = batch
            if kind == "delta":
                held += size or 0
            if kind != "delta" and held or kind == "delta" and held >= limit:
                batch, held = batch + 1, 0
            return mine

        return step

    rows = events.select("trace", "seq", "kind", "text", F.octet_length("text").alias("size"))
    numbered = folded(rows, ("trace",), ["seq"], ("kind", "size"), start, "batch long").where("kind = 'delta'")
    pieces = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return numbered.groupBy("trace", "batch").agg(F.concat_ws("", F.transform(pieces, lambda x: x["text"])).alias("text"))


def frame_stream(chunks: DataFrame) -> DataFrame:
    """A stream of (trace, chunk) pieces of text as a stream of frames; the unfinished rest is kept for each trace."""
    import json
    import re

    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class Frames(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.rest = handle.getValueState("rest", "rest string, seq long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            rest, seq = self.rest.get() if self.rest.exists() else ("", 0)
            out = []
            for frame in rows:
                *whole, rest = re.split("\r?\n\r?\n", rest + "".join(frame.chunk))
                for block in whole:
                    fields = [line.partition(":")[::2] for line in block.splitlines()]
                    data = "\n".join(v.removeprefix(" ") for k, v in fields if k == "data")
                    event = next((v.strip() for k, v in fields if k == "event"), "message")
                    try:
                        if isinstance(json.loads(data), dict):
                            out.append((key[0], seq, event, data))
                    except ValueError:
                        pass
                    seq += 1
            self.rest.update((rest, seq))
            yield pd.DataFrame(out, columns=["trace", "seq", "event", "data"])

        def close(self) -> None:
            pass

    return chunks.groupBy("trace").transformWithStateInPandas(Frames(), FRAME_SCHEMA, "Append", "None")


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows; works on streams (with a watermark) and tables."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(window, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), "n")
