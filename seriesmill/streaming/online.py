"""Applying fitted transforms to streams, and keeping the latest observations of every series as state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seriesmill.operators.scalar import Fitted, apply_fitted


def transform_stream(sdf: DataFrame, *fitted: Fitted) -> DataFrame:
    """Fitted scalers, imputers and encoders on a stream (or a batch): a stateless projection."""
    return apply_fitted(sdf, *fitted)


class RecentRows(StatefulProcessor):
    """Keeps the last ``n`` rows of a series by order columns and emits them after every batch.

    With ``idle_ms`` a series' state goes when the watermark has passed its latest event by so much.
    """

    def __init__(self, schema: T.StructType, order: Sequence[str], n: int, event_time: str | None = None, idle_ms: int | None = None):
        self.schema, self.order, self.n = schema, list(order), n
        self.event_time, self.idle_ms = event_time, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = self.schema.fieldNames()
        held = pd.DataFrame(list(self.rows.get()), columns=names)
        # a batch is folded in piece by piece, so that no more than n rows and one Arrow batch are held; late rows
        # take their place in the order, or fall out at once if n later ones are held
        for part in rows:
            part = part[names]
            held = part if held.empty else pd.concat([held, part], ignore_index=True)
            held = held.sort_values(self.order, kind="stable").tail(self.n)
        self.rows.put([tuple(r) for r in held.itertuples(index=False, name=None)])
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            last = pd.Timestamp(held[self.event_time].max())
            self.handle.registerTimer(int(last.value // 1_000_000) + self.idle_ms)
        yield held.reset_index(drop=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.rows.clear()
        return iter(())

    def close(self) -> None:
        pass


def update_context_stream(
    sdf: DataFrame, series: str, order_by: Sequence[str], n: int = 512, event_time: str | None = None, delay: str | None = None, idle_ms: int | None = None
) -> DataFrame:
    """The last ``n`` rows of every series after each batch (update mode, RocksDB state store).

    ``idle_ms`` lets the state of a series expire when the watermark (``event_time`` less ``delay``) is that far past its last event.
    """
    timed = idle_ms is not None
    if timed and (event_time is None or delay is None):
        raise ValueError("expiry needs event_time and delay")
    rows = sdf.withWatermark(event_time, delay) if timed else sdf
    return rows.groupBy(series).transformWithStateInPandas(
        statefulProcessor=RecentRows(sdf.schema, order_by, n, event_time, idle_ms),
        outputStructType=sdf.schema,
        outputMode="update",
        timeMode="eventTime" if timed else "none",
    )
