"""Incremental operators for Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def events_stream(df: DataFrame, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Event time as a timestamp with a watermark."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def windowed(df: DataFrame, at: str, length: str, slide: str | None, keys: list[str], value: str) -> DataFrame:
    """Tumbling or sliding windows: count and sum by key."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return df.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, at: str, gap: str, keys: list[str]) -> DataFrame:
    """Sessions that end after a gap."""
    return df.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each key within the watermark."""
    return df.dropDuplicatesWithinWatermark(keys)


def min_max_curve(df: DataFrame, key: str, value: str) -> DataFrame:
    """A learned curve: range of values by key; for update mode."""
    return df.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def append_new(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that appends rows with keys that the store doesn't hold; batches can be repeated."""
    from tidelake.sources.writers import store_once

    return lambda batch, _: store_once(batch, path, keys) and None


def quota_step(targets: dict[str, int], band: str, stall: int):
    """applyInPandasWithState function: emits a band's rows until its target is met, then none; it also stops after
    ``stall`` rows in one batch group without room.  State: rows taken."""

    def step(key, batches, state):  # noqa: ANN001, ANN202
        taken = state.get[0] if state.exists else 0
        room = targets.get(key[0], 0)
        idle = 0
        for pdf in batches:
            some = pdf.head(max(0, room - taken))
            taken += len(some)
            idle += len(pdf) - len(some)
            if len(some):
                yield some
            if idle > stall:
                break
        state.update((taken,))

    return step


def with_quota(df: DataFrame, band: str, targets: dict[str, int], stall: int = 1_000_000) -> DataFrame:
    """Rows up to each band's target, counted over the whole stream."""
    return df.groupBy(band).applyInPandasWithState(quota_step(targets, band, stall), df.schema, "taken long", "append", "NoTimeout")


def run_available(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Handles what there is and stops; the checkpoint resumes there."""
    query = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def folded_by_key(df: DataFrame, key: str, at: str, start: tuple, step: Callable[[tuple, dict], tuple], state: str) -> DataFrame:
    """A fold over each key's rows in order of ``at``, its state kept between batches: key and state after every batch that has rows of the key.

    step(state, row) gives the next state.  Rows of a batch are sorted by key; a row that comes in a later batch
    than its successors is folded when it comes.
    """
    kind = T.StructType.fromDDL(state)
    out = T.StructType([df.schema[key], *kind])

    def run(k, batches, held):  # noqa: ANN001, ANN202
        now = held.get if held.exists else start
        for row in pd.concat(list(batches)).sort_values(at, kind="stable").to_dict("records"):
            now = step(now, row)
        held.update(now)
        yield pd.DataFrame([(k[0], *now)], columns=out.names)

    return df.groupBy(key).applyInPandasWithState(run, out, kind, "update", "NoTimeout")


def resetting(hit: Callable[[dict], bool], at: str, span: int, least: int = 2) -> tuple[tuple, Callable[[tuple, dict], tuple], str]:
    """For folded_by_key(): events of ``least`` hits within ``span`` places; an event clears what was counted."""

    def step(state: tuple, row: dict) -> tuple:
        held, events = state
        if not hit(row):
            return state
        held = [p for p in held if p >= row[at] - span] + [int(row[at])]
        return ([], events + 1) if len(held) >= least else (held, events)

    return ([], 0), step, "held array<bigint>, events int"


def run_state(flag: Callable[[dict], bool]) -> tuple[tuple, Callable[[tuple, dict], tuple], str]:
    """For folded_by_key(): length of the run under way, runs begun, rows in runs."""

    def step(state: tuple, row: dict) -> tuple:
        length, runs, total = state
        return (length + 1, runs + (length == 0), total + 1) if flag(row) else (0, runs, total)

    return (0, 0, 0), step, "length int, runs int, total int"


def last_states(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink of an update stream: each batch in a folder of its own, written anew if the batch is repeated."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")


def read_last(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last state of each key that last_states() wrote."""
    rows = spark.read.parquet(path)
    kept = F.struct(*[c for c in rows.columns if c != "batch"])
    return rows.groupBy(key).agg(F.max_by(kept, "batch").alias("__x")).select("__x.*")
