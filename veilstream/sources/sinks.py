"""Where results go: headerless result files, tables of solutions, grammar files."""

from __future__ import annotations

from collections.abc import Callable
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.sources.streams import attributes_of, q


def collected(stream: DataFrame) -> DataFrame:
    """What an analysis hands out: all events but empty-window markers."""
    return stream.where(F.col("event_type") != "EMPTY_WINDOW")


def write_results(stream: DataFrame, path: str) -> None:
    """key, timestamp and attributes as CSV without a header."""
    collected(stream).select("key", "ts", *[q(c) for c in attributes_of(stream)]).write.mode("overwrite").option("header", False).csv(path)


def write_solutions(spark: SparkSession, rows: list[dict], path: str) -> None:
    columns = list(rows[0]) if rows else ["run"]
    spark.createDataFrame([tuple(str(r[c]) for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_grammar(text: str, path: str) -> None:
    _write_text(text, path)


def _svg(body: list[str], x: tuple[str, float, float], y: tuple[str, float, float]) -> str:
    """A drawing of 400 by 300 with axes; x, y: label, least and largest value."""
    axes = '<path d="M50 20V260H380" fill="none" stroke="black"/>'
    marks = [f'<text x="50" y="275">{x[1]:.3g}</text><text x="350" y="275">{x[2]:.3g}</text>', f'<text x="5" y="260">{y[1]:.3g}</text><text x="5" y="28">{y[2]:.3g}</text>']
    names = f'<text x="180" y="292">{escape(x[0])}</text><text x="55" y="15">{escape(y[0])}</text>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="400" height="300" font-size="11">{axes}{"".join(marks)}{names}{"".join(body)}</svg>\n'


def _scaled(values: list[float]) -> tuple[float, float, Callable[[float], float]]:
    low, high = min(values, default=0.0), max(values, default=1.0)
    return low, high, lambda v: (v - low) / (high - low) if high > low else 0.5


def write_scatter(points: list[tuple[float, float]], x: str, y: str, path: str) -> None:
    """Points of one population by two objectives."""
    (x0, x1, fx), (y0, y1, fy) = (_scaled([p[k] for p in points]) for k in (0, 1))
    dots = [f'<circle cx="{50 + 330 * fx(a):.1f}" cy="{260 - 240 * fy(b):.1f}" r="3"/>' for a, b in points]
    _write_text(_svg(dots, (x, x0, x1), (y, y0, y1)), path)


def write_lines(lines: dict[str, list[float]], x: str, y: str, path: str) -> None:
    """A line for each name, its values one step apart."""
    low, high, f = _scaled([v for line in lines.values() for v in line])
    steps = max((len(line) for line in lines.values()), default=1)
    at = lambda k: 50 + 330 * k / max(1, steps - 1)
    drawn = [f'<polyline fill="none" stroke="hsl({360 * n // max(1, len(lines))},70%,40%)" points="{" ".join(f"{at(k):.1f},{260 - 240 * f(v):.1f}" for k, v in enumerate(line))}"><title>{escape(name)}</title></polyline>' for n, (name, line) in enumerate(lines.items())]
    _write_text(_svg(drawn, (x, 0, steps - 1), (y, low, high)), path)


def _write_text(text: str, path: str) -> None:
    if "://" in path:  # a store that Spark knows
        spark = SparkSession.active()
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
        out.write(bytearray(text.encode()))
        out.close()
        return
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)
