"""The decision log as a stream.

The log is append-only and the last line of a key wins, so a stream only has to keep, for each
key, the latest line; a line without a verdict clears the key. Each micro-batch first reduces
itself to its last lines (one aggregation) and then updates a stored table, one version for each
batch, so that a batch that is run again gives the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def last_lines(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")).select(*keys, "__last.*")


def merged(state: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The state after a batch. Cleared keys stay as lines without a verdict, so that an older line
    which arrives late cannot bring them back."""
    return last_lines(state.unionByName(batch), keys, order)


def decisions(state: DataFrame) -> DataFrame:
    """The decisions that stand."""
    return state.where("verdict is not null")


class ReplayStore:
    """Versions of the state under a folder, `v=<batch>`; the newest complete one counts. With `keep`,
    only so many of the newest stay (two at least: a batch that is run again needs the one before)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], keep: int | None = None):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order
        self.keep = None if keep is None else max(keep, 2)

    def _versions(self) -> list[int]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return []
        out = []
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                out.append(int(name[2:]))
        return sorted(out)

    def read(self, before: int | None = None) -> DataFrame | None:
        found = [v for v in self._versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/v={found[-1]}") if found else None

    def update(self, batch: DataFrame, batch_id: int) -> None:
        old = self.read(before=batch_id)
        new = last_lines(batch, self.keys, self.order) if old is None else merged(old, batch, self.keys, self.order)
        new.write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")
        if self.keep is not None:
            jvm = self.spark.sparkContext._jvm
            for v in self._versions()[: -self.keep]:
                gone = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={v}")
                gone.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


# --- extras: event-time windows, which the log itself does not need ------------------------------


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """Count and sum of each window and type, over a stream or a table."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts", by: str = "user_id") -> DataFrame:
    """Sessions of each user, split where nothing happens for the gap."""
    return events.groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"))


def sessions_by_gap(events: DataFrame, seconds: int = 1800, ts: str = "ts", by: str = "user_id") -> DataFrame:
    """The same sessions of a table, by a running sum over gaps."""
    w = Window.partitionBy(by).orderBy(ts)
    at = F.col(ts).cast("timestamp").cast("double")
    gap = at - F.lag(at).over(w)
    marked = events.withColumn("__new", F.when(gap.isNull() | (gap >= seconds), 1).otherwise(0))
    marked = marked.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "session").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))
