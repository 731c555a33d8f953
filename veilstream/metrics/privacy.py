"""Privacy: how evenly far each modified tuple is from its nearest original tuples, times how well the counts agree.

Distances are root mean squares over the attributes valid on both sides, each attribute scaled by the original's
standard deviation. Equal originals are one point with a number, and equal tuples are asked once. The points are filed in
cells of about CELL_ROWS for each set of valid attributes, as many as it takes: cuts come from a sample, the cells' boxes
from all points. A tuple first looks into one cell, found by the cuts; the k-th distance found then tells which other
cells can hold nearer ones, and only these are looked into, again by the cuts. Within a cell the points lie in small
boxes, and a tuple is held against those boxes' points that can be near, so its work does not grow with the originals.
Cells meet their tuples in a join, a large cell in blocks of BLOCK_ROWS points, so no task holds more than that at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from enum import Enum

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstream.sources.scratch import written
from veilstream.sources.streams import q

BLOCK_ROWS = 50_000
CELL_ROWS, SAMPLE, SAMPLE_OF_CELL = 8192, 65_536, 32
BOX_ROWS = 64
K = 50


class PrivacyMetric(Enum):
    MEAN = "K_ANONYMITY_CARDINALITY"
    MAX = "K_ANONYMITY_CARDINALITY_MAX"
    Q99 = "K_ANONYMITY_CARDINALITY_Q99"


def scales(original: DataFrame, attributes: list[str]) -> list[float]:
    """1 / sample standard deviation; 1 where there are fewer than two values or hardly any spread."""
    row = original.agg(*[F.stddev_samp(q(a)) for a in attributes]).first()
    return [1.0 if s is None or not s > 1e-9 else 1.0 / s for s in row]


def vectors(stream: DataFrame, attributes: list[str], factors: list[float], *keep: str) -> DataFrame:
    """keep and v: the scaled attributes of the rows with at least one of them."""
    v = F.array(*[q(a) * f for a, f in zip(attributes, factors, strict=True)])
    return stream.select(*keep, v.alias("v")).where(F.exists("v", lambda x: x.isNotNull()))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column as a matrix, null as NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _valid(rows: np.ndarray) -> np.ndarray:
    """A number for each row's set of valid attributes."""
    return (~np.isnan(rows)) @ (1 << np.arange(rows.shape[1]))


class Cells:
    """Cuts of the space, by set of valid attributes; a cell's number is that set's, and its place among the set's cells."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.cuts: dict[int, tuple | None] = {}
        self.boxes: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        sets = _valid(sample)
        for which in np.unique(sets).tolist():
            own = sample[sets == which]
            depth = int(np.log2(max(1, leaves * len(own) // max(1, len(sample)))))
            self.cuts[which] = self._cut(own, [d for d in range(own.shape[1]) if which >> d & 1], depth)

    def _cut(self, rows: np.ndarray, dims: list[int], depth: int):
        if not depth or not dims or len(rows) < 2:
            return None
        d = max(dims, key=lambda d: float(np.ptp(rows[:, d])))
        at = float(np.median(rows[:, d]))
        if (rows[:, d] <= at).all():  # more than half are the largest: cut below it
            smaller = rows[rows[:, d] < at, d]
            if not len(smaller):
                return None
            at = float(smaller.max())
        low = rows[:, d] <= at
        return d, at, self._cut(rows[low], dims, depth - 1), self._cut(rows[~low], dims, depth - 1)

    def _place(self, rows: np.ndarray, which: int) -> np.ndarray:
        """The cells of a set of attributes in which rows lie; an attribute that a row has not may lie anywhere."""
        out, todo = np.zeros(len(rows), np.int64), [(np.arange(len(rows)), self.cuts.get(which), 1)]
        while todo:
            at, cut, number = todo.pop()
            if cut is None or not len(at):
                out[at] = (which << 32) | number
            else:
                low = rows[at, cut[0]] <= cut[1]
                todo += [(at[low], cut[2], 2 * number), (at[~low], cut[3], 2 * number + 1)]
        return out

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        sets, out = _valid(rows), np.zeros(len(rows), np.int64)
        for which in np.unique(sets).tolist():
            out[sets == which] = self._place(rows[sets == which], which)
        return out

    def fill(self, boxes: dict[int, tuple[np.ndarray, np.ndarray, int]]) -> None:
        """boxes: the least and largest values of each cell's points, and how many originals they stand for."""
        self.boxes, self.sets = boxes, sorted({number >> 32 for number in boxes})

    def start(self, rows: np.ndarray, k: int) -> np.ndarray:
        """A cell for each row, of the set of attributes that shares the most with it and has k originals there, if any."""
        sets, out = _valid(rows), np.zeros(len(rows), np.int64)
        for which in np.unique(sets).tolist():
            left = np.flatnonzero(sets == which)
            for other in sorted(self.sets, key=lambda o: (-(o & which).bit_count(), o != which)):
                found = self._place(rows[left], other)
                enough = np.array([c in self.boxes and self.boxes[c][2] >= k and other & which != 0 for c in found.tolist()], bool)
                out[left[enough]], left = found[enough], left[~enough]
                if not len(left):
                    break
            out[left] = next(iter(self.boxes))  # fewer than k everywhere: all cells follow
        return out

    def reached(self, rows: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, cell) of all cells that can hold a point nearer to the row than its reach."""
        sets, ats, cells = _valid(rows), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for which in self.sets:
            shared = np.array([(int(x) & which).bit_count() for x in sets.tolist()], float)
            todo = [(np.flatnonzero(shared > 0), self.cuts.get(which), 1)]
            while todo:
                at, cut, number = todo.pop()
                if not len(at):
                    continue
                if cut is None:
                    low, high, _ = self.boxes.get((which << 32) | number, (None, None, 0))
                    if low is not None:
                        at = at[bounds(rows[at], low[None], high[None])[:, 0] < reach[at]]
                        ats.append(at)
                        cells.append(np.full(len(at), (which << 32) | number))
                    continue
                gap = rows[at, cut[0]] - cut[1]
                near = np.isnan(gap) | (np.sqrt(gap**2 / shared[at]) < reach[at])
                todo += [(at[near | (gap <= 0)], cut[2], 2 * number), (at[near | (gap > 0)], cut[3], 2 * number + 1)]
        return np.concatenate(ats), np.concatenate(cells)


def bounds(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least distance from each row to anything in each box; infinite where no attribute is valid on both sides."""
    total, shared = np.zeros((len(rows), len(low))), np.zeros((len(rows), len(low)))
    for d in range(rows.shape[1]):
        gap = np.maximum(0.0, np.maximum(low[None, :, d] - rows[:, d, None], rows[:, d, None] - high[None, :, d]))
        there = ~np.isnan(gap)
        total += np.where(there, gap, 0.0) ** 2
        shared += there
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, np.sqrt(total / shared), np.inf)


def distances(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """A point is a box."""
    return bounds(mine, other, other)


class Boxes:
    """Points with one set of valid attributes, each with a number of equal originals, in boxes of BOX_ROWS at most."""

    def __init__(self, rows: np.ndarray, counts: np.ndarray):
        parts, todo = [], [np.arange(len(rows))]
        while todo:
            at = todo.pop()
            if len(at) <= BOX_ROWS:
                parts.append(at)
                continue
            d = int(np.argmax(np.nan_to_num(np.ptp(rows[at], axis=0), nan=-1.0)))
            order = np.argpartition(rows[at, d], len(at) // 2)
            todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
        self.rows, self.counts = [rows[p] for p in parts], [counts[p] for p in parts]
        self.low, self.high = np.array([r.min(axis=0) for r in self.rows]), np.array([r.max(axis=0) for r in self.rows])

    def nearest(self, rows: np.ndarray, k: int) -> list[np.ndarray]:
        """The k smallest distances of each row, equal originals each for itself."""
        near, times = np.full((len(rows), k), np.inf), np.zeros((len(rows), k), np.int64)
        reach = np.full(len(rows), np.inf)

        def look(box: int, at: np.ndarray) -> None:
            found = distances(rows[at], self.rows[box])
            both = np.concatenate([near[at], found], axis=1)
            number = np.concatenate([times[at], np.broadcast_to(self.counts[box], found.shape)], axis=1)
            best = np.argpartition(both, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(both, best, axis=1), axis=1), axis=1)
            near[at], times[at] = np.take_along_axis(both, best, axis=1), np.take_along_axis(number, best, axis=1)
            enough = np.cumsum(times[at], axis=1) >= k
            reach[at] = np.where(enough[:, -1], near[at, enough.argmax(axis=1)], np.inf)

        least = np.ascontiguousarray(bounds(rows, self.low, self.high).T)
        first = least.argmin(axis=0)
        order = np.argsort(first, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
            look(int(first[at[0]]), at)
        least[first, np.arange(len(rows))] = np.inf
        for box in range(len(least)):
            at = np.flatnonzero(least[box] < reach)
            if len(at):
                look(box, at)
        return [np.repeat(d[f], n[f])[:k] for d, n, f in zip(near, times, np.isfinite(near), strict=True)]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else [], kind))


def _met(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (leaf, block, share, asks, v, n) sorted by the first four: (v, n, near) of those that ask."""
        where, held, boxes = None, [], None
        for batch in batches:
            rows, asks = _matrix(batch.column("v")), batch.column("asks").to_numpy(zero_copy_only=False)
            place = np.stack([batch.column(c).to_numpy() for c in ("leaf", "block", "share")], axis=1)
            ends = [*(np.flatnonzero((place[1:] != place[:-1]).any(axis=1) | (asks[1:] != asks[:-1])) + 1).tolist(), len(rows)]
            start = 0
            for end in ends if len(rows) else ():
                if tuple(place[start]) != where:
                    where, held, boxes = tuple(place[start]), [], None
                if not asks[start]:
                    held.append((rows[start:end], batch.column("n").to_numpy()[start:end]))
                elif held:
                    boxes = Boxes(*(np.concatenate(x) for x in zip(*held, strict=True))) if boxes is None else boxes
                    step = max(1, 2_000_000 // len(boxes.low))
                    for at in range(start, end, step):
                        near = boxes.nearest(rows[at : min(end, at + step)], k)
                        yield pa.RecordBatch.from_arrays([batch.column("v").slice(at, len(near)), batch.column("n").slice(at, len(near)), _lists(near, pa.float64())], names=["v", "n", "near"])
                start = end

    return run


class Originals:
    """The originals (v), ready to be asked any number of times."""

    def __init__(self, originals: DataFrame, k: int = K, leaves: int | None = None):
        """k: the most nearest ones that will be asked for; leaves: the number of cells, by default as many as it takes."""
        self.k = k
        points = written(originals.groupBy("v").agg(F.least(F.count("*"), F.lit(k)).alias("n")), "points")
        rows = points.count()
        leaves = max(1, rows // CELL_ROWS) if leaves is None else leaves
        share = min(1.0, max(SAMPLE, SAMPLE_OF_CELL * leaves) / max(1, rows))
        drawn = points if share == 1.0 else points.where(F.pmod(F.xxhash64("v"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1))
        sample = _matrix(drawn.select("v").toArrow().column("v").combine_chunks())
        self.cells = cells = Cells(sample, leaves) if len(sample) else None
        if cells is None:
            return

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(cells(_matrix(batch.column("v")))), batch.column("v"), batch.column("n")], names=["leaf", "v", "n"])

        self.filed = written(points.mapInArrow(file, "leaf bigint, v array<double>, n bigint"), "cells")
        dims = range(sample.shape[1])
        sides = [f(F.get("v", F.lit(d))).alias(f"{name}{d}") for d in dims for name, f in (("lo", F.min), ("hi", F.max))]
        found = self.filed.groupBy("leaf").agg(F.count("*").alias("points"), F.sum("n").alias("n"), *sides).collect()  # one row for each cell
        side = lambda b, s: np.array([np.nan if b[f"{s}{d}"] is None else b[f"{s}{d}"] for d in dims], float)
        self.sizes = {b["leaf"]: b["points"] for b in found}
        cells.fill({b["leaf"]: (side(b, "lo"), side(b, "hi"), b["n"]) for b in found})

    def _joined(self, asked: DataFrame) -> DataFrame | None:
        """(v, n, near) for rows (leaf, v, n): the k smallest distances in that cell, or in one of its blocks; None without rows."""
        spark = asked.sparkSession
        wanted = {r["leaf"]: r["c"] for r in asked.groupBy("leaf").agg(F.count("*").alias("c")).collect()}  # as many rows as cells
        if not wanted:
            return None
        rows = [(leaf, -(-self.sizes[leaf] // BLOCK_ROWS), -(-c // BLOCK_ROWS)) for leaf, c in wanted.items()]
        sizes = F.broadcast(spark.createDataFrame(rows, "leaf bigint, blocks int, shares int"))
        draw = lambda n: F.pmod(F.xxhash64("v"), n)
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1))
        original = self.filed.join(sizes, "leaf").select("leaf", draw(F.col("blocks")).alias("block"), every(F.col("shares")).alias("share"), F.lit(False).alias("asks"), "v", "n")
        tuples = asked.join(sizes, "leaf").select("leaf", draw(F.col("shares")).alias("share"), every(F.col("blocks")).alias("block"), F.lit(True).alias("asks"), "v", "n")
        parts = min(sum(b * s for _, b, s in rows), max(4 * spark.sparkContext.defaultParallelism, sum(wanted.values()) // BLOCK_ROWS))  # by work, not by bytes
        both = original.unionByName(tuples).repartition(parts, "leaf", "block", "share").sortWithinPartitions("leaf", "block", "share", "asks")
        return both.mapInArrow(_met(self.k), "v array<double>, n bigint, near array<double>")

    def nearest(self, asked: DataFrame) -> DataFrame:
        """(v, n, near) for distinct v, each with a number n: the k smallest distances to originals, ascending."""
        if self.cells is None:
            return asked.select("v", "n", F.array().cast("array<double>").alias("near"))
        cells, k = self.cells, self.k

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(cells.start(_matrix(batch.column("v")), k)), batch.column("v"), batch.column("n")], names=["leaf", "v", "n"])

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, found = _matrix(batch.column("v")), batch.column("near")
                ends = np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False))
                full, reach = np.diff(ends, prepend=0) == k, np.full(len(rows), np.inf)
                reach[full] = found.flatten().to_numpy()[ends[full] - 1]
                at, leaves = cells.reached(rows, reach)
                other = leaves != cells.start(rows, k)[at]
                at, leaves = at[other], leaves[other]
                order = np.argsort(at, kind="stable")
                lists = np.split(leaves[order], np.searchsorted(at[order], np.arange(1, len(rows)))) if len(rows) else []
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(lists, pa.int64())], names=["v", "n", "near", "more"])

        merged = [F.max("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near")]
        schema = "v array<double>, n bigint"
        found = self._joined(asked.select("v", "n").mapInArrow(start, f"leaf bigint, {schema}"))
        if found is None:
            return asked.select("v", "n", F.array().cast("array<double>").alias("near"))
        if max(self.sizes.values()) > BLOCK_ROWS:
            found = found.groupBy("v").agg(*merged)
        held = written(found.mapInArrow(rest, f"{schema}, near array<double>, more array<bigint>"), "found")
        more = self._joined(held.select(F.explode("more").alias("leaf"), "v", "n"))
        done = held.where(F.size("more") == 0).select("v", "n", "near")
        if more is None:
            return done
        return done.union(held.where(F.size("more") > 0).select("v", "n", "near").union(more).groupBy("v").agg(*merged))


def _distinct(targets: DataFrame) -> DataFrame:
    return written(targets.groupBy("v").agg(F.count("*").alias("n")), "asked")


def nearest(targets: DataFrame, originals: DataFrame, k: int = K, leaves: int | None = None) -> DataFrame:
    """targets (id, v; ids unique) with near: the k smallest distances to originals (v), ascending."""
    return targets.select("id", "v").join(Originals(originals, k, leaves).nearest(_distinct(targets)).drop("n"), "v").select("id", "v", "near")


def deviation(near: Column) -> Column:
    """Sample standard deviation of an array; NULL for fewer than two values."""
    n = F.size(near)
    mean = F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / n
    squares = F.aggregate(near, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(n >= 2, F.sqrt(F.greatest(F.lit(0.0), squares / (n - 1))))


def prepared(original: DataFrame, attributes: list[str], k: int = K) -> tuple[list[float], Originals]:
    """The attributes' factors, and the originals to be asked for k nearest ones."""
    if k < 2:
        raise ValueError("k must be at least 2")
    factors = scales(original, attributes)
    return factors, Originals(vectors(original, attributes, factors), k)


def spread(modified: DataFrame, original: DataFrame, attributes: list[str], k: int = K, id_column: Column | None = None) -> DataFrame:
    """(id, risk) of each modified tuple: the deviation of the distances to its k nearest originals."""
    if k < 2:
        raise ValueError("k must be at least 2")
    factors = scales(original, attributes)
    ids = id_column if id_column is not None else F.concat_ws("|", q("seq").cast("string"), q("dup_path"))
    targets = vectors(modified.withColumn("id", ids), attributes, factors, "id")
    found = nearest(targets, vectors(original, attributes, factors), k)
    return found.select("id", deviation(F.col("near")).alias("risk")).where(F.col("risk").isNotNull())


def summary(risks: DataFrame) -> DataFrame:
    """One row (n, mean, min, max, q95, q99); a quantile is the value at floor(q * (n - 1)), zeros if there is none.

    risks: (risk), or (risk, n) where a row stands for n tuples. Values are counted, the distinct ones dealt into ranges;
    the ranges' sums tell which range holds a rank, and only that range is gone through.
    """
    risks = written(risks.select("risk", F.col("n") if "n" in risks.columns else F.lit(1).cast("bigint").alias("n")), "risks")
    base = risks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce(x, F.lit(0.0)).alias(name) for name, x in (("mean", F.sum(F.col("risk") * F.col("n")) / F.sum("n")), ("min", F.min("risk")), ("max", F.max("risk")))])
    counted = risks.groupBy("risk").agg(F.sum("n").alias("n")).repartitionByRange("risk").withColumn("part", F.spark_partition_id())
    counted = written(counted, "ranges")
    before, starts = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in counted.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        starts.append((part, before, before + n))
        before += n
    picked = {}
    for name, share in (("q95", 0.95), ("q99", 0.99)):
        rank = int(share * (before - 1))
        picked[name] = 0.0
        for part, low, high in starts:
            if low <= rank < high:
                upto = F.sum("n").over(Window.partitionBy("part").orderBy("risk"))
                rows = counted.where(F.col("part") == part).withColumn("upto", upto + F.lit(low))
                picked[name] = rows.where(F.col("upto") > rank).agg(F.min("risk")).first()[0]
    return base.withColumns({name: F.lit(value) for name, value in picked.items()})


def cardinality_factor(n_original: int, n_modified: int) -> float:
    if n_original == 0:
        return 1.0 if n_modified == 0 else 0.0
    r = n_modified / n_original
    return min(r, 1 / r) if r else 0.0


def privacy_score(modified: DataFrame, original: DataFrame, attributes: list[str], metric: PrivacyMetric = PrivacyMetric.MEAN, k: int = K, known: tuple[list[float], Originals] | None = None) -> float:
    """known: what prepared() gave for the originals, where several streams are scored."""
    factor = cardinality_factor(original.count(), modified.count())
    if factor == 0.0:
        return 0.0
    factors, originals = known or prepared(original, attributes, k)
    found = originals.nearest(_distinct(vectors(modified, attributes, factors)))
    risks = found.select(deviation(F.col("near")).alias("risk"), "n").where(F.col("risk").isNotNull())
    if metric is PrivacyMetric.Q99:
        stat = summary(risks).first()["q99"]
    else:
        stat = risks.agg(F.max("risk") if metric is PrivacyMetric.MAX else F.sum(F.col("risk") * F.col("n")) / F.sum("n")).first()[0]
    return factor / (1.0 + (stat or 0.0))
