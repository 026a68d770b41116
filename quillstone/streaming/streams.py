"""Streaming forms of batch operators: incremental resume, deduplication, windowed sums and as-of dependencies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_files(spark: SparkSession, path: str, schema: str, per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream; with a checkpoint each file is handled once (the resume of a campaign)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def keep_once(stream: DataFrame, key: list[str], at: str, late: str) -> DataFrame:
    """The first record of each key; copies later than `late` after it may come again."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def tumbling(stream: DataFrame, at: str, width: str, late: str, keys: list[str], value: str, slide: str | None = None) -> DataFrame:
    """Count and sum per window and key; a window is final once the watermark has passed it, later records are dropped."""
    w = F.window(F.col(at), width, slide) if slide else F.window(F.col(at), width)
    g = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(w, *keys)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("bucket"), *keys, "n", "total")


def sessions(stream: DataFrame, at: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Runs of records of a key with pauses shorter than `gap`."""
    g = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.session_window(at, gap), *keys)
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), *keys, "n")


def dependencies(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(obj_id, src_seq, dst_seq): each read with the last write of its object before it.

    Input: obj_id long, seq long, kind string, in order of seq across batches. State is one number per object; a record
    older than the newest seen of its object is judged by the writes that have come so far. With `idle_ms`, an object
    without records for so long is forgotten.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = []
        for s, k in sorted((s, k) for b in batches for s, k in zip(b.seq, b.kind)):
            if k == "write":
                last = int(s)
            elif k == "read" and last is not None:
                rows.append((key[0], last, int(s)))
        if last is not None:
            state.update((last,))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["obj_id", "src_seq", "dst_seq"]).astype("int64")

    return stream.groupBy("obj_id").applyInPandasWithState(step, "obj_id long, src_seq long, dst_seq long", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, run to its end into Parquet files under `path`, which are read back.

    Nothing is collected at the driver. In append mode each batch is written exactly once; in complete mode each batch
    replaces what is there.
    """
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", path).start()
    else:
        q = w.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Into Parquet files, each batch exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
