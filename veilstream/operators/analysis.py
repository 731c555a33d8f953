"""Keyed sliding event-time analysis: filter, averages over sliding windows, filter, with the stages in between.

A window gives one row for a key, with the time and all other attributes of its last valid event, if that event lies in
the window's last slide (else a later event has not come, and the row would repeat the one before). Windows that end
after the last event of the aggregate's input stay open and give nothing, unless flush_tail is set.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.sources.streams import attributes_of, q

HOUR = 3_600_000


def no_condition(stream: DataFrame) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class AnalysisSpec:
    """name; the averaged attributes; conditions before (None: no such stage) and after; window, slide, resolution in ms."""

    name: str
    averaged: tuple[str, ...]
    before: Callable[[DataFrame], Column] | None
    after: Callable[[DataFrame], Column]
    tolerance: float = 0.15
    size: int = 3 * HOUR
    slide: int = HOUR
    resolution: int = HOUR
    flush_tail: bool = False


@dataclass
class Analysis:
    """stages by name; frames: the frames that they are parts of, each with the conditions of its stages."""

    stages: dict[str, DataFrame] = field(default_factory=dict)
    frames: list[tuple[DataFrame, dict[str, Column]]] = field(default_factory=list)

    @property
    def output(self) -> DataFrame:
        return self.stages["outputStream"]

    @property
    def windows(self) -> DataFrame:
        return self.frames[1][0]


def at_least(first: str, a: float, second: str, b: float) -> Callable[[DataFrame], Column]:
    return lambda stream: (q(first) >= a) & (q(second) >= b)


def inside_box(x: str, y: str, centre_x: float, centre_y: float, radius: float) -> Callable[[DataFrame], Column]:
    """Strictly inside."""
    return lambda stream: (q(x) > centre_x - radius) & (q(x) < centre_x + radius) & (q(y) > centre_y - radius) & (q(y) < centre_y + radius)


#: Thresholds, centre and radius of the two customary analyses.
AIR_QUALITY = AnalysisSpec("air_quality", ("CO(GT)", "NO2(GT)"), at_least("CO(GT)", 2.0, "NO2(GT)", 40.0), at_least("CO(GT)", 5.0, "NO2(GT)", 100.0), 0.15)
TRAJECTORIES = AnalysisSpec("trajectories", ("avg_X", "avg_Y"), None, inside_box("avg_X", "avg_Y", 341097.79, 111055.50, 2000.0), 0.10)
ANALYSES = {a.name: a for a in (AIR_QUALITY, TRAJECTORIES)}


def sliding_average(stream: DataFrame, averaged: tuple[str, ...], size: int, slide: int, flush_tail: bool = False) -> DataFrame:
    """Results and, as rows of type EMPTY_WINDOW with key -1, the windows without a fresh result.

    Sums are first made for panes of one slide, which then go to the windows they lie in.
    """
    others = [c for c in attributes_of(stream) if c not in averaged]
    valid = F.lit(True)
    for name in averaged:
        valid = valid & q(name).isNotNull()
    rows = stream.withColumns({"__pane": F.floor(F.col("ts") / F.lit(slide)), "__ok": valid})
    carried = F.struct("seq", "dup_path", "ts", "event_type", *[q(c) for c in others])
    sums = [F.sum(F.when(F.col("__ok"), q(c))).alias(f"__s{k}") for k, c in enumerate(averaged)]
    panes = rows.groupBy("key", "__pane").agg(F.max("ts").alias("__seen"), F.count(F.when(F.col("__ok"), True)).alias("__n"), *sums, F.max_by(carried, F.when(F.col("__ok"), F.struct("seq", "dup_path"))).alias("__last"), F.max(F.when(F.col("__ok"), F.struct("seq", "dup_path"))).alias("__at"))
    per = size // slide
    spread = panes.select("*", F.explode(F.sequence(F.col("__pane") - (per - 1), F.col("__pane"))).alias("__first"))
    totals = [F.sum(f"__s{k}").alias(f"__s{k}") for k in range(len(averaged))]
    windows = spread.groupBy("key", "__first").agg(F.sum("__n").alias("__n"), *totals, F.max_by("__last", "__at").alias("__last"))
    windows = windows.withColumns({"__start": F.col("__first") * slide, "__end": F.col("__first") * slide + size})
    if not flush_tail:
        latest = stream.agg(F.max("ts").alias("__latest"))  # one row
        windows = windows.join(F.broadcast(latest), F.col("__end") <= F.col("__latest"))
    fresh = F.coalesce(F.col("__last.ts") >= F.col("__end") - slide, F.lit(False))

    def made(name: str) -> Column:
        value = F.col(f"__s{averaged.index(name)}") / F.col("__n") if name in averaged else F.col("__last").getField(name)
        return F.when(fresh, value).alias(name)

    return windows.select(
        F.coalesce(F.when(fresh, F.col("__last.seq")), F.lit(-1)).cast("bigint").alias("seq"),
        F.coalesce(F.when(fresh, F.col("__last.dup_path")), F.lit("")).alias("dup_path"),
        F.when(fresh, F.col("__last.ts")).otherwise(F.col("__start")).cast("bigint").alias("ts"),
        F.when(fresh, F.col("key")).otherwise("-1").alias("key"),
        F.when(fresh, F.col("__last.event_type")).otherwise("EMPTY_WINDOW").alias("event_type"),
        *[made(c) for c in attributes_of(stream)],
    )


def analyse(stream: DataFrame, spec: AnalysisSpec, keep: Callable[[DataFrame], DataFrame] = lambda windows: windows) -> Analysis:
    """The stages by name: source, after the first filter (if any), after the aggregate, output.

    keep: what to do with the windows before stages are made of them, for those who use several stages.
    """
    parts, kept = {"sourceStream": F.lit(True)}, stream
    if spec.before is not None:
        parts["afterFilter1"] = spec.before(stream)
        kept = stream.where(spec.before(stream))
    windows = keep(sliding_average(kept, spec.averaged, spec.size, spec.slide, spec.flush_tail))
    results = {"afterAggregate": F.lit(True), "outputStream": (F.col("event_type") != "EMPTY_WINDOW") & spec.after(windows)}
    frames = [(stream, parts), (windows, results)]
    return Analysis({name: df.where(condition) for df, named in frames for name, condition in named.items()}, frames)
