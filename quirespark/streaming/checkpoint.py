"""Incremental extraction state: an automaton for each page, streaming and batch.

pending -> started -> response -> completed; started -> failed; a page found
``started`` when the stream restarts is ``outcome_unknown`` and stays so until a
person decides. The streaming form keeps one state a key and emits the state
after each batch; the batch form folds the same transitions over the sorted
events of each key inside the JVM.

Defined results
* events that the state doesn't allow leave it and count as ``refused``.
* repeated events (same key, time and kind) count once.
* ties of time: by kind's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Event kinds allowed in each state, and the state they lead to.
NEXT: dict[tuple[str, str], str] = {
    ("pending", "start"): "started", ("started", "response"): "response", ("response", "complete"): "completed",
    ("started", "fail"): "failed", ("failed", "start"): "started", ("started", "restart"): "outcome_unknown", ("outcome_unknown", "decide"): "pending",
}


def step(state: str, kind: str) -> str | None:
    return NEXT.get((state, kind))


def fold(events: DataFrame, key: str = "page_id", time: str = "ts", kind: str = "kind") -> DataFrame:
    """Final state, steps taken and refused of each key. A key's events are one array, as many as a page has attempts."""
    table = F.create_map(*[F.lit(x) for (a, b), c in NEXT.items() for x in (f"{a}|{b}", c)])
    held = events.select(key, time, kind).distinct().groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(kind).alias("k")))).alias("e"))

    def advance(acc, e):
        to = F.try_element_at(table, F.concat_ws("|", acc["state"], e["k"]))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["steps"] + to.isNotNull().cast("int")).alias("steps"), (acc["refused"] + to.isNull().cast("int")).alias("refused"))

    start = F.struct(F.lit("pending").alias("state"), F.lit(0).alias("steps"), F.lit(0).alias("refused"))
    return held.select(key, F.aggregate("e", start, advance).alias("s")).select(key, "s.*")


def track(stream: DataFrame, key: str = "page_id", time: str = "ts", kind: str = "kind") -> DataFrame:
    """Streaming form: the state of each key after every batch that touches it."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, steps, refused = state.get if state.exists else ("pending", 0, 0)
        events = pd.concat(list(batches)).drop_duplicates([time, kind]).sort_values([time, kind])
        for what in events[kind]:
            to = step(now, what)
            now, steps, refused = (to, steps + 1, refused) if to else (now, steps, refused + 1)
        state.update((now, steps, refused))
        yield pd.DataFrame({key: [k[0]], "state": [now], "steps": [steps], "refused": [refused]})

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kinds[key]}, state string, steps int, refused int", "state string, steps int, refused int", "update", GroupStateTimeout.NoTimeout)


def windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Events, distinct kinds and value of each window; works on a stream and on a table."""
    df = events.withWatermark(time, late) if events.isStreaming else events
    return df.groupBy(F.window(time, length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions of each key: events no further apart than the gap."""
    df = events.withWatermark(time, late) if events.isStreaming else events
    return df.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last")).drop("w")
