"""Hourly updates of a landmark window (SM1-SM10): state per source as mergeable partials, profiles of touched sources, campaigns and decisions on all, identity from update to update, a log.

State is a folder per update that holds the rows of the sources it touched; the
newest row of a source counts. Everything an update writes is named by its number
and replaced if it runs again, so a repeated micro-batch changes nothing. A new
landmark is a new folder.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import external, fingerprints, reduction


class Landmark:
    """A window that starts at a landmark. ``infer(profiles, days)`` gives (src, camp) and (camp, testable, orchestrated) of all profiles; it runs once two whole days are there (SM7)."""

    def __init__(self, spark: SparkSession, folder: str, d0: int, d_size: int, days: int = 7, infer: Callable[[DataFrame, int], tuple[DataFrame, DataFrame]] | None = None) -> None:
        self.spark, self.folder, self.d0, self.d_size, self.days, self.infer = spark, folder.rstrip("/"), d0, d_size, days, infer

    def _exists(self, kind: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _write(self, df: DataFrame, kind: str, no: int) -> DataFrame:
        path = f"{self.folder}/{kind}/update={no:06d}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def newest(self, kind: str, before: int | None = None) -> DataFrame | None:
        """The newest row of each source of a kind of state, of updates below ``before``."""
        if not self._exists(kind):
            return None
        rows = self.spark.read.option("basePath", f"{self.folder}/{kind}").parquet(f"{self.folder}/{kind}")
        if before is not None:
            rows = rows.filter(F.col("update") < before)
        w = W.partitionBy("src").orderBy(F.desc("update"))
        return rows.withColumn("tw_r", F.row_number().over(w)).filter("tw_r = 1").drop("tw_r", "update")

    def update(self, hours: DataFrame, no: int) -> None:
        """SM4-SM8, SM10: one update from source-hours. Number 0 is the warm start (SM3): earlier days at once."""
        began = time.time()
        part = self._write(reduction.partial(hours, self.days), "touched", no)
        old = self.newest("state", no)
        both = part if old is None else part.unionByName(old.join(part.select("src"), "src", "left_semi").select(*part.columns))
        state = self._write(reduction.merge(both, self.days), "state", no)
        ingested = time.time()
        self._write(fingerprints.candidates(fingerprints.profile(reduction.finished(state), self.d0, self.d_size)), "profiles", no)
        every = self.newest("profiles", no + 1)
        facts = hours.agg(F.count("*").alias("rows"), F.coalesce(F.max("h") + 1, F.lit(0)).alias("n")).first()
        touched, sources, profiles = part.count(), self.newest("state", no + 1).count(), every.count()
        seen = facts.n if old is None else max(facts.n, (old.agg(F.max("hlast")).first()[0] or 0) + 1)
        profiled = time.time()
        log = {"update": no, "hour": seen - 1, "rows": facts.rows, "touched": touched, "sources": sources, "profiles": profiles, "campaigns": None, "orchestrated": None, "continuity": None}
        if self.infer and seen >= 48:
            members, decisions = self.infer(external.as_of(every, seen) if seen < 24 * self.days else every, seen // 24)
            members = self._write(members.select("src", "camp"), "members", no)
            got = decisions.agg(F.count("*").alias("n"), F.count_if(F.col("orchestrated")).alias("o")).first()
            log |= {"campaigns": got.n, "orchestrated": got.o, "continuity": self.continuity(members, no)}
        log |= {"t_ingest": ingested - began, "t_profile": profiled - ingested, "t_infer": time.time() - profiled, "t_total": time.time() - began}
        kinds = "update long, hour long, rows long, touched long, sources long, profiles long, campaigns long, orchestrated long, continuity double, t_ingest double, t_profile double, t_infer double, t_total double"
        self.spark.createDataFrame([tuple(log.values())], kinds).coalesce(1).write.mode("overwrite").json(f"{self.folder}/log/batch={no:06d}")

    def continuity(self, members: DataFrame, no: int, threshold: float = 0.5) -> float | None:
        """JN8, SM8: the share of campaigns that continue one of the update before: of all that share members the one that shares most, if their Jaccard index reaches the threshold. None without an update before."""
        if not self._exists(f"members/update={no - 1:06d}"):
            return None
        before = self.spark.read.parquet(f"{self.folder}/members/update={no - 1:06d}").withColumnRenamed("camp", "was")
        size, old = members.groupBy("camp").agg(F.count("*").alias("m")), before.groupBy("was").agg(F.count("*").alias("n"))
        shared = members.join(before, "src").groupBy("camp", "was").agg(F.count("*").alias("k")).groupBy("camp").agg(F.max(F.struct("k", (-F.col("was")).alias("w"))).alias("x")).select("camp", F.col("x.k").alias("k"), (-F.col("x.w")).alias("was"))
        j = size.join(shared, "camp", "left").join(old, "was", "left")
        return j.agg(F.avg((F.coalesce(F.col("k") / (F.col("m") + F.col("n") - F.col("k")), F.lit(0.0)) >= threshold).cast("double"))).first()[0]

    def log(self) -> DataFrame:
        """Q8, SNK4: the log, a row for each update."""
        return self.spark.read.json(f"{self.folder}/log").drop("batch")


def replay(window: Landmark, folder: str, schema: str, checkpoint: str, warm: DataFrame | None = None, once: str | None = None) -> DataFrame:
    """SM1: run a folder of hourly Parquet files through a window, one file an update, after a warm start; returns the log.

    ``once`` (an extension, off by default as late and repeated rows are then
    counted as they come, SM9): an event-time column; rows that repeat a source
    and hour within a day of it are dropped.
    """
    if warm is not None:
        window.update(warm, 0)
    stream = window.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    if once:
        stream = stream.withWatermark(once, "1 day").dropDuplicatesWithinWatermark(["src", "h"])
    q = stream.writeStream.foreachBatch(lambda df, no: window.update(df, no + 1)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return window.log()
