"""Patches of messages as a stream: keyed state remembers the newest patch of each message, and only newer ones are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.operators import conversations


def newest(patches: DataFrame, keys: list[str], fields: list[str], forget_s: int = 3600) -> DataFrame:
    """Rows (keys, fields, seq) of a stream that are newer than all that came before for their message, one a message and batch.

    State is one number a message; it is dropped when no patch has come for forget_s seconds. A late repeat is written again then,
    which changes nothing for `applied`. Patches without seq or without a key have no effect and are left out.
    """
    rows = patches.select(*keys, *fields, F.col("seq").cast("long").alias("seq")).dropna(subset=[*keys, "seq"])

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        best = None
        for pdf in batches:
            row = pdf.iloc[[int(pdf["seq"].to_numpy().argmax())]]
            if best is None or row["seq"].iloc[0] > best["seq"].iloc[0]:
                best = row
        seq = int(best["seq"].iloc[0])
        if not state.exists or seq > state.get[0]:
            state.update((seq,))
            yield best
        state.setTimeoutDuration(forget_s * 1000)

    return rows.groupBy(*keys).applyInPandasWithState(run, rows.schema, "seq long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def start(patches: DataFrame, path: str, keys: list[str], fields: list[str], checkpoint: str, forget_s: int = 3600, **trigger):
    """Keep a folder a micro-batch of newest patches at path; a batch that is written again replaces itself."""
    rows = newest(patches, keys, fields, forget_s)
    patches.sparkSession.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark, key = patches.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    # with time-outs, batches without data would follow one another, and a stream of what is there would never end
    spark.conf.set(key, "false")
    try:
        out = rows.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
        return out.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(key, before)


def applied(messages: DataFrame, path: str, keys: list[str], fields: list[str]) -> DataFrame:
    """messages with what the stream has kept so far, whatever the order in which patches came."""
    return conversations.patched(messages, messages.sparkSession.read.parquet(path), keys, fields)
