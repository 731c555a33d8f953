"""Pipelines of modifiers as data, with their text form."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Condition(Enum):
    LT = "lt"
    GT = "gt"

    @property
    def sign(self) -> str:
        return "<" if self is Condition.LT else ">"


class Aggregate(Enum):
    MIN = "min"
    AVG = "avg"
    MAX = "max"


@dataclass(frozen=True)
class Filter:
    attribute: str
    condition: Condition
    value: float

    def __str__(self) -> str:
        return f"filter({self.attribute} {self.condition.sign} {self.value:.4f})"


@dataclass(frozen=True)
class Duplicate:
    probability: float

    def __str__(self) -> str:
        return f"map_duplicate(probability={self.probability:.2f})"


@dataclass(frozen=True)
class Noise:
    attribute: str
    percentage: float

    def __str__(self) -> str:
        return f"map_noise(attribute={self.attribute}, percentage={self.percentage:.2f})"


@dataclass(frozen=True)
class RandomInRange:
    attribute: str

    def __str__(self) -> str:
        return f"map_rir(attribute={self.attribute})"


@dataclass(frozen=True)
class MovingAggregate:
    attribute: str
    function: Aggregate
    window: int

    def __str__(self) -> str:
        return f"map_aggregate(attribute={self.attribute}, function={self.function.value}, window={self.window})"


Node = Filter | Duplicate | Noise | RandomInRange | MovingAggregate


@dataclass(frozen=True)
class Pipeline:
    nodes: tuple[Node, ...] = ()

    def __str__(self) -> str:
        return "Pipeline { " + " | ".join(map(str, self.nodes)) + " }" if self.nodes else "Pipeline {}"


def simplified(pipeline: Pipeline) -> tuple[Pipeline, bool]:
    """Adjacent filters on one attribute merged to the narrowest pair; true if they leave no value at all."""
    out: list[Node] = []
    at, nodes = 0, pipeline.nodes
    while at < len(nodes):
        run = []
        while at < len(nodes) and isinstance(nodes[at], Filter):
            run.append(nodes[at])
            at += 1
        for name in dict.fromkeys(f.attribute for f in run):
            low = max((f.value for f in run if f.attribute == name and f.condition is Condition.GT), default=None)
            high = min((f.value for f in run if f.attribute == name and f.condition is Condition.LT), default=None)
            if low is not None and high is not None and low >= high:
                return pipeline, True
            out += [Filter(name, Condition.GT, low)] if low is not None else []
            out += [Filter(name, Condition.LT, high)] if high is not None else []
        if at < len(nodes):
            out.append(nodes[at])
            at += 1
    return Pipeline(tuple(out)), False
