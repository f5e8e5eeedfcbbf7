"""The edit history over an endless log: the same fold, kept as state for each user. An extension; the batch fold is in ``operators.records``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.records import history_step


def history_stream(log: DataFrame, cap: int = 20) -> DataFrame:
    """(user_id, present, n_past, n_future) after each micro-batch, for a streaming log of (user_id, ts, event_id, action, value).

    Events of a batch are folded in (ts, event_id) order; state is a user's stacks, at most ``cap`` past values.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, future, present = state.get if state.exists else ([], [], 0)
        now = (list(past), present, list(future))
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for action, value in zip(rows["action"].tolist(), rows["value"].tolist(), strict=True):
            now = history_step(now, action, value, cap)
        past, present, future = now
        state.update((past, future, present))
        yield pd.DataFrame({"user_id": [key[0]], "present": [present], "n_past": [len(past)], "n_future": [len(future)]})

    return log.groupBy("user_id").applyInPandasWithState(fold, "user_id long, present long, n_past int, n_future int", "past array<long>, future array<long>, present long", "update", GroupStateTimeout.NoTimeout)
