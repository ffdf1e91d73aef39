"""The panel's fold over a stream: the state of an entity is two masks and a few numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "first_idx int, last_idx int, observed long, unknown long, event_idx int, rows long"
RESULT = "entity string, first_idx int, last_idx int, observed_mask long, unknown_mask long, event_idx int, rows long"


def folded(rows: DataFrame, horizon: int = 12) -> DataFrame:
    """Updates of ``(entity, idx, serious, unknown)`` rows in any order; the last update of an entity equals the batch fold of its rows.

    Months are or-ed into masks and the event is a minimum, so neither order nor repetition matters.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, seen, unknown, event, n = state.get if state.exists else (1 << 30, -(1 << 30), 0, 0, 0, 0)
        for b in batches:
            for idx, bad, dim in zip(b["idx"].tolist(), b["serious"].tolist(), b["unknown"].tolist(), strict=True):
                first, last, n = min(first, idx), max(last, idx), n + 1
                if 1 <= idx <= horizon:
                    seen |= 1 << (idx - 1)
                    unknown |= (1 << (idx - 1)) if dim else 0
                    if bad:
                        event = min(event or idx, idx)
        state.update((first, last, seen, unknown, event, n))
        out = pd.DataFrame({"entity": [key[0]], "first_idx": [first], "last_idx": [last], "observed_mask": [seen], "unknown_mask": [unknown], "event_idx": pd.array([event or None], dtype="Int32"), "rows": [n]})
        yield out

    return rows.groupBy("entity").applyInPandasWithState(fold, RESULT, STATE, "update", GroupStateTimeout.NoTimeout)
