"""Hourly replay with Structured Streaming: one file a trigger, state per source, only touched sources are profiled anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "nrec long, pk long, bytes long, t0 long, t1 long, words array<int>, hfirst long, hlast long"


def update(key, batches, state):  # noqa: ANN001, ANN201
    """Merge a source's new rows into its state and emit its profile. All parts are sums, minima, maxima or ors."""
    import pandas as pd

    words = [0] * 7
    n = pk = by = 0
    t0, t1, hf, hl = 1 << 62, 0, 1 << 62, -1
    if state.exists:
        n, pk, by, t0, t1, w, hf, hl = state.get
        words = list(w)
    for b in batches:
        n, pk, by = n + len(b), pk + int(b.pk.sum()), by + int(b.bytes.sum())
        t0, t1 = min(t0, int(b.t.min())), max(t1, int(b.t.max()))
        hf, hl = min(hf, int(b.h.min())), max(hl, int(b.h.max()))
        for h in b.h.unique():
            if 0 <= h < 168:
                words[int(h) // 24] |= 1 << int(h) % 24
    state.update((n, pk, by, t0, t1, words, hf, hl))
    yield pd.DataFrame({"src": [key[0]], "nrec": [n], "pk": [pk], "bytes": [by], "t0": [t0], "t1": [t1], "words": [words], "hfirst": [hf], "hlast": [hl]})


def profiles(flows: DataFrame) -> DataFrame:
    """A stream of flows(src, t, h, pk, bytes) as a stream of updated profiles."""
    return flows.groupBy("src").applyInPandasWithState(update, f"src long, {STATE}", STATE, "update", "NoTimeout")


def replay(spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str, shuffle: int | None = None) -> DataFrame:
    """Run all files of a folder, one a micro-batch, into a Parquet table of updates, and return the last profile of each source.

    Each micro-batch overwrites its own folder, so one that is run again after a failure leaves no repeats.
    """
    stream = profiles(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))

    def put(df: DataFrame, epoch: int) -> None:
        df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{table}/batch={epoch:06d}")

    q = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(table)
    return rows.groupBy("src").agg(F.max_by(F.struct("nrec", "pk", "bytes", "t0", "t1", "words", "hfirst", "hlast"), "epoch").alias("x")).select("src", "x.*")
