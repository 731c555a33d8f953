"""A stream is a frame (seq, dup_path, ts, key, event_type, attributes...): ts in epoch milliseconds, attributes doubles.

(seq, dup_path) is the order of events; dup_path grows by one character with every duplicating operator.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilstream.functions.missing import known, numeric_or_missing, parsed

FIXED = ["seq", "dup_path", "ts", "key", "event_type"]
EVENT_TYPES = ["NORMAL", "DUPLICATE", "EMPTY_WINDOW"]
GLOBAL_KEY = "GLOBAL"


@dataclass(frozen=True)
class Loaded:
    events: DataFrame
    attributes: list[str]


def attributes_of(stream: DataFrame) -> list[str]:
    return [c for c in stream.columns if c not in FIXED]


def q(name: str) -> Column:
    """A column by its exact name, dots and parentheses included."""
    return F.col(f"`{name}`")


def event_type_of(text: Column) -> Column:
    upper = F.upper(F.trim(text))
    return F.when(upper.isin(EVENT_TYPES), upper).otherwise("NORMAL")


def infer_numeric(rows: DataFrame, candidates: list[str]) -> list[str]:
    """The columns whose every value is blank, NaN or a number, over a full scan; file order."""
    if not candidates:
        return []
    found = rows.agg(*[F.coalesce(F.bool_and(numeric_or_missing(q(c))), F.lit(True)).alias(f"c{k}") for k, c in enumerate(candidates)]).first()
    return [c for k, c in enumerate(candidates) if found[k]]


def read_csv(spark: SparkSession, path: str, key: str = "", **options) -> Loaded:
    """A headed CSV file with a timestamp column; rows without a whole timestamp and repeated headers are skipped."""
    rows = spark.read.options(header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE", **options).csv(path)
    return from_text_rows(rows, key)


def from_text_rows(rows: DataFrame, key: str = "") -> Loaded:
    names = {c.lower(): c for c in rows.columns}
    stamp = names.get("timestamp")
    if stamp is None:
        raise ValueError("the input has no column named timestamp")
    key_column = names.get(key.lower()) if key else None
    kind = names.get("eventtype")
    rows = rows.where(q(stamp).try_cast("bigint").isNotNull())
    candidates = [c for c in rows.columns if c not in (stamp, key_column, kind) and c.lower() != "id"]
    attributes = infer_numeric(rows, candidates)
    plain = rows.select(
        F.monotonically_increasing_id().alias("__place"),
        q(stamp).cast("bigint").alias("ts"),
        (q(key_column).cast("string") if key_column else F.lit(GLOBAL_KEY)).alias("key"),
        (event_type_of(q(kind)) if kind else F.lit("NORMAL")).alias("event_type"),
        *[parsed(q(c)).alias(c) for c in attributes],
    )
    return Loaded(numbered(plain), attributes)


def numbered(plain: DataFrame) -> DataFrame:
    """Number events by (ts, place) without bringing them into one partition: sorted ranges, then each range's offset."""
    ranged = plain.repartitionByRange("ts", "__place").sortWithinPartitions("ts", "__place").withColumn("__part", F.spark_partition_id())
    return ranged.withColumn("seq", (F.col("__part").cast("bigint") * F.lit(1 << 33)) + F.row_number().over(Window.partitionBy("__part").orderBy("ts", "__place"))).select("seq", F.lit("").alias("dup_path"), "ts", "key", "event_type", *[q(c) for c in plain.columns if c not in ("__place", "ts", "key", "event_type")])


def from_table(rows: DataFrame, seq: Column, ts: Column, key: Column | None, attributes: dict[str, Column]) -> DataFrame:
    """A stream from typed columns; ts in epoch milliseconds, seq in the order of time."""
    return rows.select(
        seq.cast("bigint").alias("seq"),
        F.lit("").alias("dup_path"),
        ts.cast("bigint").alias("ts"),
        (key.cast("string") if key is not None else F.lit(GLOBAL_KEY)).alias("key"),
        F.lit("NORMAL").alias("event_type"),
        *[known(c).alias(name) for name, c in attributes.items()],
    )


def epoch_millis(timestamp_ntz: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), timestamp_ntz.cast("timestamp_ntz"))


def time_bounds(stream: DataFrame) -> tuple[int, int]:
    low, high = stream.agg(F.min("ts"), F.max("ts")).first()
    return low, high


def header_attributes(path: str, excluded: list[str]) -> list[str]:
    """The names of a CSV file's first line but the excluded; no look at the values."""
    from pyspark.sql import SparkSession

    first = SparkSession.active().read.text(path).limit(1).collect()
    if not first:
        raise OSError(f"{path} is empty")
    return [c.strip() for c in first[0][0].split(",") if c.strip() and c.strip() not in excluded]


def column_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(attribute, min, max, min_digits, max_digits) of text columns; digits: characters before the point, without sign."""
    parts = [rows.select(F.lit(c).alias("attribute"), parsed(q(c)).alias("v"), F.length(F.replace(F.split(F.trim(q(c)), r"\.")[0], F.lit("-"), F.lit(""))).alias("digits")) for c in columns]
    long = parts[0]
    for p in parts[1:]:
        long = long.union(p)
    known_rows = long.where(F.col("v").isNotNull())
    return known_rows.groupBy("attribute").agg(F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.min("digits").cast("bigint").alias("min_digits"), F.max("digits").cast("bigint").alias("max_digits"))
