"""The pending correction: a down-vote waits for its author's next text; a command clears it, the text uses it up."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sarnai.ship import ship

EVENT = "user_id long, seq long, kind string, request_id long"  # kind: down, command, text or other
FOUND = "user_id long, seq long, request_id long"
PATIENCE_MS = 30 * 24 * 3600 * 1000  # a vote that nobody answers is forgotten then, so that state does not only grow


def pending(log: DataFrame, by: list[str]) -> DataFrame:
    """Batch form. The texts that answer a down-vote, each with its request."""
    w = Window.partitionBy(*by).orderBy("seq")
    setting = F.when(F.col("kind").isin("down", "command"), F.struct("seq", "kind", "request_id"))
    before = F.last(setting, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    texts = log.withColumn("_state", before).where((F.col("kind") == "text") & (F.col("_state.kind") == "down"))
    first = F.row_number().over(Window.partitionBy(*by, "_state.seq").orderBy("seq")) == 1
    return texts.withColumn("_first", first).where("_first").select(*by, "seq", F.col("_state.request_id").alias("request_id"))


def pending_stream(events: DataFrame, patience_ms: int = PATIENCE_MS) -> DataFrame:
    """Streaming form over EVENT rows that come in order of seq per user, state kept per user until it is answered or too old."""
    ship(events.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(columns=["user_id", "seq", "request_id"])
            return
        waiting = state.get[0] if state.exists else None
        out = []
        for seq, kind, request in pd.concat(list(batches)).sort_values("seq")[["seq", "kind", "request_id"]].itertuples(index=False):
            if kind == "down":
                waiting = request
            elif kind == "command":
                waiting = None
            elif kind == "text" and waiting is not None:
                out.append((key[0], seq, waiting))
                waiting = None
        if waiting is None:
            state.remove() if state.exists else None
        else:
            state.update((int(waiting),))
            state.setTimeoutDuration(patience_ms)
        yield pd.DataFrame(out, columns=["user_id", "seq", "request_id"])

    return events.groupBy("user_id").applyInPandasWithState(step, FOUND, "request_id long", "append", "ProcessingTimeTimeout")
