"""The fact log as a stream: a signed accumulator and the active state, both idempotent under replays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signed_sums(ops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, weight): writes count +1 and forgets -1, each operation id once. Batch or stream (which keeps all ids as state)."""
    once = ops.dropDuplicates(["seq"])
    return once.groupBy(*keys).agg(F.sum(F.when(F.col("op") == "write", 1).otherwise(-1)).alias("weight"))


def last_state(ops: DataFrame) -> DataFrame:
    """(subj, rel, obj, op, seq): the last operation on each triple. Batch or stream."""
    return ops.groupBy("subj", "rel", "obj").agg(F.max(F.struct("seq", "op")).alias("x")).select("subj", "rel", "obj", "x.op", "x.seq")


def drain(stream: DataFrame, path: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there, and return the final table.

    Each batch goes to Parquet below `path`, which all executors share, never to the driver. With `keys` the stream is in update
    mode and the newest row of each key counts; without, each batch is the whole table (complete mode) and the last one counts."""
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        done.append(number)

    writer = stream.writeStream.outputMode("update" if keys else "complete").option("checkpointLocation", f"{path}/state")
    writer.foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    read = stream.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, _batch int")
    if not keys:
        return read.parquet(f"{path}/out/batch={max(done)}").drop("_batch")
    rows, rest = read.parquet(*(f"{path}/out/batch={k}" for k in done)), [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_x")).select(*keys, *(F.col(f"_x.{c}").alias(c) for c in rest))


def windowed(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key, with a watermark that lets state go."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))
