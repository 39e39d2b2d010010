"""Progress events: batch views and their streaming twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder

#: Phases in order, with the share of the work that each stands for.
PHASES = {
    "initializing": 0.05, "scanning": 0.10, "detecting_type": 0.05, "identifying_entries": 0.05, "parsing_files": 0.50,
    "analyzing_relationships": 0.20, "generating_graph": 0.05,
}


def latest(events: DataFrame, session: str, ts: str, tie: str) -> DataFrame:
    """The last event of each session."""
    rest = F.struct(*events.columns)
    return events.groupBy(session).agg(F.max_by(rest, F.struct(ts, tie)).alias("r")).select("r.*")


def overall(last: DataFrame, phase: str, progress: str, weights: dict[str, float]) -> DataFrame:
    """last with ``overall``: the weights of the phases before, and the share done of the present one."""
    before, run = {}, 0.0
    for k, w in weights.items():
        before[k], run = run, run + w
    base = F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)])[F.col(phase)]
    own = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, v)])[F.col(phase)]
    done = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(progress)))
    return last.withColumn("overall", F.when(F.col(phase) == "completed", 1.0).when(F.col(phase) == "failed", 0.0).otherwise(base + own * done))


def remaining_seconds(elapsed, progress):
    """Time left at the present pace; null before the start and after the end."""
    return F.when((progress > 0) & (progress < 1), elapsed / progress - elapsed)


def over_limit(snapshots: DataFrame, key: str, value: str, limit: float, warn: float = 0.8) -> DataFrame:
    """snapshots with ``state`` and whether the state is newly entered."""
    v = F.col(value)
    state = F.when(v > limit, "exceeded").when(v > warn * limit, "warning").otherwise("ok")
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    return snapshots.withColumn("state", state).withColumn("entered", ~F.col("state").eqNullSafe(F.lag("state").over(w)))


def windowed(events: DataFrame) -> DataFrame:
    """Events per hour and type."""
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def stream_counts(spark: SparkSession, path: str, schema) -> DataFrame:
    """Hourly counts of a Parquet folder or file, computed by a stream that takes what is there and ends.

    Late rows are kept for a day; the state of closed windows is dropped by the watermark.  The
    result is written with checkpoints into the shared folder, hence exactly once.
    """
    out = f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    one = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    reader = spark.readStream.schema(schema)
    folder, _, name = path.rpartition("/")
    events = reader.option("pathGlobFilter", name).parquet(folder) if one else reader.parquet(path)
    # foreachBatch sees each refreshed window; the last version of a window is the highest batch
    counts = windowed(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    q = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema("w struct<start:timestamp,end:timestamp>, event_type string, n bigint, total double, batch int").parquet(f"{out}/data/batch=*")
    last = rows.groupBy("w", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r"))
    return last.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "r.n", "r.total")
