"""The state fold over a stream: an extension beyond the batch operators.

Events of one episode must arrive in order within a micro-batch boundary; within a batch they are sorted. State is one
word for each episode, kept by the state store, so a lost executor recovers from the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUTPUT = "episode_id string, turn_index bigint, previous_state string, operation string, new_state string"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    current = state.get[0] if state.exists else "unknown"
    rows = []
    for e in pd.concat(list(batches)).sort_values("turn_index").itertuples():
        previous = current
        operation = "RETRACT_EXISTENCE" if e.assertion == "negative" else "RECUR" if previous in ("absent", "resolved") else "ASSERT_EXISTENCE"
        current = "absent" if operation == "RETRACT_EXISTENCE" else "present"
        rows.append((key[0], e.turn_index, previous, operation, current))
    state.update((current,))
    yield pd.DataFrame(rows, columns=["episode_id", "turn_index", "previous_state", "operation", "new_state"])


def fold_stream(events: DataFrame) -> DataFrame:
    """(episode_id, turn_index, assertion) as a stream -> one row for each event with its operation and states."""
    return events.groupBy("episode_id").applyInPandasWithState(_fold, OUTPUT, "current string", "append", "NoTimeout")
