"""The sliding analysis on a stream that arrives: watermarked windows in append mode, closed by stream time as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilstream.functions.missing import parsed
from veilstream.operators.analysis import AnalysisSpec
from veilstream.sources.streams import GLOBAL_KEY, attributes_of, event_type_of, q


def windows_stream(stream: DataFrame, spec: AnalysisSpec, delay: str = "0 seconds") -> DataFrame:
    """Rows as the batch form's afterAggregate, markers for windows without a fresh result among them."""
    others = [c for c in attributes_of(stream) if c not in spec.averaged]
    kept = stream if spec.before is None else stream.where(spec.before(stream))
    valid = F.lit(True)
    for name in spec.averaged:
        valid = valid & q(name).isNotNull()
    timed = kept.withColumn("__time", F.timestamp_millis("ts")).withWatermark("__time", delay)
    place = F.when(valid, F.struct("seq", "dup_path"))
    last = F.max_by(F.struct("seq", "dup_path", "ts", "event_type", *[q(c) for c in others]), place).alias("__last")
    averages = [F.avg(F.when(valid, q(c))).alias(f"__a{k}") for k, c in enumerate(spec.averaged)]
    windows = timed.groupBy("key", F.window("__time", f"{spec.size} milliseconds", f"{spec.slide} milliseconds")).agg(last, *averages)
    fresh = F.coalesce(F.col("__last.ts") >= F.unix_millis("window.end") - spec.slide, F.lit(False))
    value = lambda c: F.when(fresh, F.col(f"__a{spec.averaged.index(c)}") if c in spec.averaged else F.col("__last").getField(c)).alias(c)
    return windows.select(
        F.when(fresh, F.col("__last.seq")).otherwise(-1).cast("bigint").alias("seq"),
        F.when(fresh, F.col("__last.dup_path")).otherwise("").alias("dup_path"),
        F.when(fresh, F.col("__last.ts")).otherwise(F.unix_millis("window.start")).alias("ts"),
        F.when(fresh, F.col("key")).otherwise("-1").alias("key"),
        F.when(fresh, F.col("__last.event_type")).otherwise("EMPTY_WINDOW").alias("event_type"),
        *[value(c) for c in attributes_of(stream)],
    )


def sliding_average_stream(stream: DataFrame, spec: AnalysisSpec, delay: str = "0 seconds") -> DataFrame:
    """Rows as the batch form's output."""
    out = windows_stream(stream, spec, delay)
    return out.where((F.col("event_type") != "EMPTY_WINDOW") & spec.after(out))


def run_to_table(stream: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Everything available now, appended to a table in memory."""
    writer = stream.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def stream_of_files(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_of_csv(spark: SparkSession, path: str, header: list[str], attributes: list[str], key: str = "", files_per_batch: int = 1) -> DataFrame:
    """A stream from a folder of headed CSV files with the given columns; names are met in any case.

    Lines without a whole timestamp, repeated headers among them, are dropped. Events of one time are ordered by a hash
    of their line, as files that arrive have no line numbers.
    """
    schema = ", ".join(f"`{c}` string" for c in header)
    rows = spark.readStream.schema(schema).options(header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, maxFilesPerTrigger=files_per_batch).csv(path)
    names = {c.lower(): c for c in header}
    stamp, kind, key_column = q(names["timestamp"]).try_cast("bigint"), names.get("eventtype"), names.get(key.lower()) if key else None
    line = F.pmod(F.xxhash64(*[q(c) for c in header]), F.lit(1 << 20))
    return rows.where(stamp.isNotNull()).select(
        (F.shiftleft(stamp, 20) + line).alias("seq"),
        F.lit("").alias("dup_path"),
        stamp.alias("ts"),
        (q(key_column) if key_column else F.lit(GLOBAL_KEY)).alias("key"),
        (event_type_of(q(kind)) if kind else F.lit("NORMAL")).alias("event_type"),
        *[parsed(q(names[a.lower()])).alias(a) for a in attributes],
    )
