"""The rate limiter on a stream, and syncing by micro-batches."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from codeloom.operators.limiter import CALLS, WINDOW, decide


def rate_limit_stream(events: DataFrame, calls: int = CALLS, window: float = WINDOW) -> DataFrame:
    """Decisions for a stream of ``key, id, at``; the state of a key is the times of its allowed
    calls, ``calls`` of them at most."""
    kind = dict(events.dtypes)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "id"], kind="stable")
        kept = deque(state.get[0]) if state.exists else deque()
        got = decide(rows["at"].tolist(), calls, window, kept)
        state.update((list(kept),))
        yield pd.DataFrame({"key": rows["key"], "id": rows["id"], "at": rows["at"], "allowed": [g[0] for g in got], "remaining": [g[1] for g in got], "reset_in": [g[2] for g in got]})

    out = f"key {kind['key']}, id {kind['id']}, at double, allowed boolean, remaining int, reset_in int"
    return events.groupBy("key").applyInPandasWithState(run, out, "times array<double>", "append", GroupStateTimeout.NoTimeout)


def sync_stream(files: DataFrame, sync: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands all files that have come since the last run to ``sync`` and ends."""
    return files.writeStream.foreachBatch(sync).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
