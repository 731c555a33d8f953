"""Problems and experiments by files: a CSV file, a grammar file, and the text form of an experiment."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from veilstream.metrics.privacy import PrivacyMetric
from veilstream.operators.analysis import ANALYSES, AnalysisSpec
from veilstream.plans import grammar as g
from veilstream.plans.experiment import Preset, run_experiment
from veilstream.plans.problem import ALL, Problem
from veilstream.sources.streams import attributes_of, read_csv

#: The problems by their builders' names, with their objectives.
BUILDERS = {"anonymizationProblem": ALL, "medicalDataAnonymizationProblem": ALL, "anonymizationProblem2O": ("privacy", "results"), "anonymizationProblem2OPerf": ("performance", "privacy")}


def read_grammar(spark: SparkSession, path: str) -> g.Grammar:
    """A grammar file from anywhere Spark can read."""
    return g.parse_grammar("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def analysis_for(attributes: list[str]) -> AnalysisSpec:
    """The customary analysis whose averaged attributes are there."""
    for analysis in ANALYSES.values():
        if set(analysis.averaged) <= set(attributes):
            return analysis
    raise ValueError(f"no analysis for the attributes {', '.join(attributes)}")


def problem_from_files(spark: SparkSession, builder: str, input_csv_path: str, grammar_path: str, privacy_metric: str = "K_ANONYMITY_CARDINALITY", key_column: str = "", **more) -> Problem:
    """A problem by its builder's name; the analysis follows from the file's attributes."""
    stream = read_csv(spark, input_csv_path, key_column).events
    return Problem(stream, analysis_for(attributes_of(stream)), BUILDERS[builder], PrivacyMetric(privacy_metric), g.is_filter_only(read_grammar(spark, grammar_path)), **more)


@dataclass(frozen=True)
class Experiment:
    builder: str
    input_csv_path: str
    grammar_path: str
    privacy_metric: str
    key_column: str
    evaluations: int
    seeds: tuple[int, ...]
    folder: str  # with {name} and {startTime}


def read_experiment(text: str) -> Experiment:
    """What the text form says of runs, problem and output; plots and columns of results are always the same."""

    def value(pattern: str, default: str | None = None) -> str:
        found = re.search(pattern, text)
        if not found and default is None:
            raise ValueError(f"the experiment lacks {pattern}")
        return found[1] if found else default

    first, step, last = (int(x) for x in re.search(r"seed\s*=\s*\[\s*(\d+)\s*:\s*(\d+)\s*:\s*(\d+)\s*\]", text).groups())
    return Experiment(
        value(r"anonym\.problem\.(\w+)"),
        value(r'inputCsvPath\s*=\s*"([^"]*)"'),
        value(r'grammarPath\s*=\s*"([^"]*)"'),
        value(r'privacyMetric\s*=\s*"?(\w+)', "K_ANONYMITY_CARDINALITY"),
        value(r'keyColumn\s*=\s*"([^"]*)"', ""),
        int(value(r"nOfQualityEvaluations\(\s*n\s*=\s*(\d+)")),
        tuple(range(first, last + 1, step)),
        value(r"\$basePath\s*=\s*''([^']*)''", "{^^.name}/{^^.startTime}/").replace("^^.", ""),
    )


def run_file(spark: SparkSession, path: str, output: str = ".", evaluations: int | None = None, threads: int = 1, verbose: bool = False, **problem) -> str:
    """Run the experiment of a file; the folder that its results went to."""
    e = read_experiment(Path(path).read_text())
    stream = read_csv(spark, e.input_csv_path, e.key_column).events
    rules = read_grammar(spark, e.grammar_path)
    folder = f"{output}/" + e.folder.replace("{name}", Path(path).stem).replace("{startTime}", time.strftime("%Y-%m-%d--%H-%M-%S")).rstrip("/")
    preset = Preset(analysis_for(attributes_of(stream)), (), PrivacyMetric(e.privacy_metric), BUILDERS[e.builder], e.key_column, e.evaluations, e.seeds)
    run_experiment(stream, preset, folder, evaluations, threads, verbose, rules, **problem)
    return folder
