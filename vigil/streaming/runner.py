"""Run a streaming query to completion into a checkpointed parquet sink and read the result back.

Used by tests and registered queries: ``trigger(availableNow=True)`` processes
everything available in bounded micro-batches, then stops. Sinks and
checkpoints live under the session's ``spark.checkpoint.dir`` (shared storage on
a cluster), so a restarted query resumes exactly once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigil.session import ensure_checkpoint_dir
from vigil.sources.manifest import create_manifest, latest, remove, versions


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/vigil/{name}-{uuid.uuid4().hex[:10]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_to_table(stream: DataFrame, name: str, output_mode: str = "append", foreach_batch=None) -> str:
    """Drain ``stream`` (availableNow) into a parquet folder; returns the folder."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", out + "/_checkpoint")
    if foreach_batch is not None:
        q = w.outputMode(output_mode).foreachBatch(lambda df, epoch: foreach_batch(df, epoch, out)).start()
    else:
        q = w.outputMode(output_mode).format("parquet").option("path", out + "/data").start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return out


def epoch_writer(batch: DataFrame, epoch: int, out: str) -> None:
    """foreachBatch sink for update mode: each epoch's changed rows go to their own folder (a replayed
    epoch overwrites itself, so the sink is idempotent)."""
    batch.write.mode("overwrite").parquet(f"{out}/updates/epoch={epoch}")


def read_latest(spark: SparkSession, out: str, keys) -> DataFrame:
    """Current value of every key from an update-mode sink: the row of the highest epoch."""
    df = spark.read.parquet(f"{out}/updates")
    rest = [c for c in df.columns if c not in list(keys) + ["epoch"]]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("epoch")).alias("_r")).select(*keys, "_r.*")


#: Epochs from one snapshot of a state to the next.
SNAPSHOT_EVERY = 8


class StreamState:
    """Keyed state of a foreachBatch writer: the rows that an epoch leaves for the keys it touched (one or more a key,
    and they replace what the key had), in a folder of the epoch.

    Every ``every`` epochs the whole state is written as a snapshot and committed by a manifest, so a batch reads one
    snapshot and fewer than ``every`` later folders, however long the stream runs. The last two snapshots stay, so that
    an epoch that is replayed finds the state before it; older folders go. ``expire(state)`` says what a snapshot may
    leave out: keys whose time to live is over.
    """

    def __init__(self, spark: SparkSession, out: str, keys, schema: str | StructType, every: int = SNAPSHOT_EVERY,
                 expire: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.out, self.keys, self.schema = spark, out, list(keys), schema
        self.every, self.expire = every, expire

    def folders(self, epoch: int) -> list[tuple[int, str]]:
        """What the state before ``epoch`` is read from: the newest snapshot, then the folders of the epochs since."""
        at = latest(self.spark, f"{self.out}/state", before=epoch)
        first = [(at[0], at[1]["snapshot"])] if at else []
        since = at[0] + 1 if at else 0
        return first + [(e, f"{self.out}/state/epoch={e}") for e in range(since, epoch)]

    def before(self, epoch: int) -> DataFrame:
        """State as the epochs before ``epoch`` left it, empty before the first one."""
        parts = [self.spark.read.schema(self.schema).parquet(path).withColumn("_epoch", F.lit(e))
                 for e, path in self.folders(epoch)]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if len(parts) == 1:
            return rows.drop("_epoch")
        last = rows.groupBy(*self.keys).agg(F.max("_epoch").alias("_last"))
        same = F.col("r._epoch") == F.col("l._last")
        for k in self.keys:
            same = same & F.col(f"r.`{k}`").eqNullSafe(F.col(f"l.`{k}`"))
        return rows.alias("r").join(last.alias("l"), same, "left_semi").drop("_epoch")

    def write(self, rows: DataFrame, epoch: int) -> None:
        """The epoch's folder, and every so often a snapshot. A replayed epoch writes the same once more."""
        rows.write.mode("overwrite").parquet(f"{self.out}/state/epoch={epoch}")
        if (epoch + 1) % self.every:
            return
        remove(self.spark, f"{self.out}/state/_manifest/{epoch}.json")  # of a replayed epoch: made anew from the one before
        state = self.before(epoch + 1)
        path = f"{self.out}/state/snapshot={epoch}"
        (state if self.expire is None else self.expire(state)).write.mode("overwrite").parquet(path)
        create_manifest(self.spark, f"{self.out}/state", epoch, {"snapshot": path}, replace=True)
        self._clean(epoch)

    def _clean(self, epoch: int) -> None:
        """Folders that neither this snapshot nor the one before it needs."""
        kept = versions(self.spark, f"{self.out}/state")
        for old in kept[:-2]:
            remove(self.spark, f"{self.out}/state/snapshot={old}")
            remove(self.spark, f"{self.out}/state/_manifest/{old}.json")
        if len(kept) > 1:
            for e in range(max(0, kept[-2] - 2 * self.every), kept[-2] + 1):
                remove(self.spark, f"{self.out}/state/epoch={e}")
