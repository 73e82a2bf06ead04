"""Keyed state of a change feed: the last sequence number of each path, so that late and repeated events do nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.ids import norm_path

EVENT = "path string, op string, source string, seq long"
#: Keys are dealt to so many groups by a hash, since Python is called once a group and batch, not once a key. A checkpoint
#: holds its state by these groups, so the number must stay; a batch writes the numbers of the groups that it touches anew.
GROUPS = 4096


def _order(event: tuple) -> tuple:
    path, op, source, seq = event
    return seq, op or "", source is not None, source or "", path


def _newest(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of each key of a group the last event in a batch, by seq, op, source and path, if its number is beyond the state's."""
    last = dict(state.get[0]) if state.exists else {}
    best: dict[str, tuple] = {}
    for events in batches:
        texts = [events[c].astype(object).where(events[c].notna(), None) for c in ("key", "path", "op", "source")]
        for key, *event in zip(*texts, events["seq"].tolist(), strict=True):
            seq, old = event[3], best.get(key)
            if (key not in last or seq > last[key]) and (old is None or seq > old[3] or (seq == old[3] and _order(event) > _order(old))):
                best[key] = event
    if best:
        state.update((last | {key: event[3] for key, event in best.items()},))
        yield pd.DataFrame(list(best.values()), columns=["path", "op", "source", "seq"])


def newer(changes: DataFrame) -> DataFrame:
    """Of a streaming frame ``path, op, source, seq`` the last event of each path in a batch, unless one with its number or a
    later one has come in an earlier batch. The state is a number a path; events without a number are dropped."""
    rows = changes.select("path", "op", "source", F.col("seq").cast("long").alias("seq"), norm_path(F.col("path")).alias("key")).where("seq IS NOT NULL AND path IS NOT NULL")
    rows = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS)).cast("int"))
    return rows.groupBy("group").applyInPandasWithState(_newest, EVENT, "seqs map<string, long>", "append", GroupStateTimeout.NoTimeout)
