"""The per-document plan over streams: detection and masking hold no state, so they run on a stream as they do on a table; counts need a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect


def read_folder(spark: SparkSession, path: str, schema, kind: str = "parquet", files: int = 100) -> DataFrame:
    """New files of a folder as a stream; a path that is one file gives that file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).load(str(at.getParent()))
    return reader.load(path)


def votes(stream: DataFrame, rules=detect.RULES) -> DataFrame:
    return detect.with_patterns(stream, rules)


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need times with a zone; those without one are taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Events by type and window; state is dropped once the watermark has passed."""
    events = _timed(events)
    window = F.window("ts", every, slide) if slide else F.window("ts", every)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users: their start, end and number of events."""
    return _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def write_json(stream: DataFrame, path: str, checkpoint: str):
    """Exactly-once JSON lines; both folders must be shared by all executors."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
