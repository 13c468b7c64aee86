"""Memory features of a panel that arrives month by month.

State per cell is its number of rows, the last row with an event and the last labels: a fixed size, however long the
panel grows. Months at or before a cell's latest one are late and dropped; the batch operators can rebuild them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "rows long, last_event long, latest date, labels array<int>"


def stream_memory_features(panel: DataFrame, cap: int, months: int = 12) -> DataFrame:
    """cell_id, date, y, y_lag1, event_count, months_since_event for each new row of a stream of cell_id, date, y."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, last, latest, labels = state.get if state.exists else (0, -1, None, [])
        labels, out = list(labels), []
        for date, y in pd.concat(frames)[["date", "y"]].sort_values("date").itertuples(index=False):
            if latest is not None and date <= latest:
                continue
            rows, latest, before = rows + 1, date, labels[-1] if labels else 0
            last = rows if before else last
            out.append((key[0], date, y, before, sum(labels), min(cap, rows - last) if last >= 0 else cap))
            labels = [*labels, int(y)][-months:]
        state.update((rows, last, latest, labels))
        yield pd.DataFrame(out, columns=["cell_id", "date", "y", "y_lag1", "event_count", "months_since_event"])

    schema = "cell_id long, date date, y int, y_lag1 int, event_count long, months_since_event int"
    kept = panel.select("cell_id", "date", "y")
    return kept.groupBy("cell_id").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)
