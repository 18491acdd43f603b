"""Streams: a change feed, versions from observations, and a rate limit with its own memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def change_feed(spark: SparkSession, path: str, schema: T.StructType, id_col: str, at: str, delay: str = "1 day") -> DataFrame:
    """A feed read from an append-only table: delivery is at least once, so ids are dropped that
    repeat within the watermark; state is bounded by it."""
    return spark.readStream.schema(schema).parquet(path).withWatermark(at, delay).dropDuplicatesWithinWatermark([id_col])


def versions(observations: DataFrame, key: str, observed: str, id_col: str, content: str) -> DataFrame:
    """created and updated events: (key, id, version, previous_id, kind) for each observation whose
    content differs from the key's latest version. State per key: content, version, id."""
    key_type, id_type = observations.schema[key].dataType.simpleString(), observations.schema[id_col].dataType.simpleString()
    out = f"{key} {key_type}, {id_col} {id_type}, version bigint, previous_id {id_type}, kind string"

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, version, last_id = state.get if state.exists else (None, 0, None)
        rows = pd.concat(list(frames)).sort_values([observed, id_col], kind="stable")
        made = []
        for row_id, now in zip(rows[id_col], rows[content], strict=True):
            if not version or now != last:
                made.append((group[0], row_id, version + 1, last_id, "updated" if version else "created"))
                last, version, last_id = now, version + 1, row_id
        state.update((last, version, last_id))
        yield pd.DataFrame(made, columns=[key, id_col, "version", "previous_id", "kind"]).astype({"version": "int64", "previous_id": "object"})

    return observations.groupBy(key).applyInPandasWithState(step, out, f"content string, version bigint, id {id_type}", "append", GroupStateTimeout.NoTimeout)


def rate_limit(attempts: DataFrame, key: str, micros: str, id_col: str, limits: tuple[tuple[int, int], ...]) -> DataFrame:
    """(key, id, allowed, retry_at): an attempt passes if every window (width in microseconds,
    most) has room in (t - width, t]; refused attempts aren't remembered.

    State per key: the accepted instants of the widest window, at most the largest limit.
    """
    id_type, key_type = attempts.schema[id_col].dataType.simpleString(), attempts.schema[key].dataType.simpleString()
    widest = max(w for w, _ in limits)

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values([micros, id_col], kind="stable")
        made = []
        for row_id, t in zip(rows[id_col], rows[micros], strict=True):
            kept = [x for x in kept if x > t - widest]
            retry = []
            for width, most in limits:
                inside = [x for x in kept if x > t - width]
                if len(inside) >= most:
                    retry.append(inside[0] + width)
            if not retry:
                kept.append(int(t))
            made.append((group[0], row_id, not retry, max(retry, default=None)))
        state.update((kept,))
        yield pd.DataFrame(made, columns=[key, id_col, "allowed", "retry_at"]).astype({"retry_at": "Int64"})

    return attempts.groupBy(key).applyInPandasWithState(
        step, f"{key} {key_type}, {id_col} {id_type}, allowed boolean, retry_at bigint", "kept array<bigint>", "append", GroupStateTimeout.NoTimeout
    )


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what there is and stop; the sink is append-only Parquet, exactly once by the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, at: str, by: str, width: str, delay: str) -> DataFrame:
    """Counts per event-time window and value, final once the watermark has passed."""
    return events.withWatermark(at, delay).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))
