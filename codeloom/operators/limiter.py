"""Sliding-window rate limiter: only allowed calls count against the limit."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALLS, WINDOW = 25, 3600.0


def decide(times: Iterable[float], calls: int, window: float, history: deque | None = None) -> list[tuple[bool, int, int]]:
    """``allowed, remaining, reset_in`` of calls in order of time; ``history`` is carried on."""
    kept, out = deque() if history is None else history, []
    for now in times:
        while kept and now - kept[0] >= window:
            kept.popleft()
        allowed = len(kept) < calls
        if allowed:
            kept.append(now)
        out.append((allowed, max(0, calls - len(kept)), max(0, int(window - (now - kept[0]))) if kept else 0))
    return out


def rate_limit(events: DataFrame, calls: int = CALLS, window: float = WINDOW) -> DataFrame:
    """Adds ``allowed, remaining, reset_in`` to ``key, id, at`` (seconds), in the order ``at, id``.

    A key's calls are a sequence, each decision resting on those before it.  They are sorted in their
    partition and read batch by batch; what is carried from one batch to the next is the key and the
    times of its allowed calls, ``calls`` of them at most, whatever the number of its calls."""
    kinds = dict(events.dtypes)

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        carried, kept = None, deque()
        for rows in batches:
            if not len(rows):
                continue
            codes = pd.factorize(rows["key"], use_na_sentinel=False)[0]
            starts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(rows)]
            times, got = rows["at"].tolist(), []
            for a, b in zip(starts, starts[1:], strict=False):
                key = rows["key"].iloc[a]
                key = (None,) if pd.isna(key) else (key,)
                if key != carried:
                    carried, kept = key, deque()
                got += decide(times[a:b], calls, window, kept)
            yield rows.assign(allowed=[g[0] for g in got], remaining=[g[1] for g in got], reset_in=[g[2] for g in got])

    ordered = events.select("key", "id", F.col("at").cast("double").alias("at")).repartition("key").sortWithinPartitions("key", "at", "id")
    return ordered.mapInPandas(run, f"key {kinds['key']}, id {kinds['id']}, at double, allowed boolean, remaining int, reset_in int")
