"""Structured Streaming forms of the operators whose state is bounded: windowed class summaries, running totals per key,
and keyed updates by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_means(stream: DataFrame, time: str, width: str, aggs: dict[str, Column], keys: Sequence[str] = (), slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Class summaries over tumbling or sliding windows; rows later than the watermark are dropped."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, width, slide) if slide else F.window(time, width), *keys).agg(*[a.alias(k) for k, a in aggs.items()])
    return out.select("window.start", "window.end", *keys, *aggs)


def sessions(stream: DataFrame, time: str, key: str, gap: str, aggs: dict[str, Column], late: str = "10 minutes") -> DataFrame:
    """Runs of rows of a key with gaps below `gap`."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(*[a.alias(k) for k, a in aggs.items()])
    return out.select(F.col("session_window.start"), F.col("session_window.end"), key, *aggs)


def running_total(stream: DataFrame, key: str, value: str, order: str, key_type: str = "long") -> DataFrame:
    """Sum statement on a stream: each row with its key's total so far; a key's state is one number.

    Rows of a micro-batch are taken in `order`."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        run = pdf[value].fillna(0.0).cumsum() + total
        state.update((float(run.iloc[-1]),))
        yield pd.DataFrame({key: k[0], order: pdf[order].to_numpy(), "total": run.to_numpy()})

    order_type = dict(stream.dtypes)[order]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {key_type}, {order} {order_type}, total double", "total double", "append", GroupStateTimeout.NoTimeout)


def upsert(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """UPDATE by micro-batch: `apply` overlays a batch of transactions on its master table."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
