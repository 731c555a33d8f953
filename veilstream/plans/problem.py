"""The quality of a pipeline: privacy, results similarity and performance similarity, all to be made large."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame

from veilstream.metrics.fidelity import results_similarity
from veilstream.metrics.performance import performance_similarity
from veilstream.metrics.privacy import K, Originals, PrivacyMetric, prepared, privacy_score
from veilstream.operators.analysis import ANALYSES, AnalysisSpec, analyse
from veilstream.operators.modifiers import run_pipeline
from veilstream.operators.profile import profile_stages
from veilstream.plans.grammar import Grammar, Tree, is_filter_only, to_pipeline
from veilstream.plans.ir import Pipeline
from veilstream.sources.streams import attributes_of, time_bounds

ALL = ("performance", "privacy", "results")


@dataclass
class Problem:
    """A stream, its analysis and the objectives; what concerns the original only is worked out once."""

    stream: DataFrame
    analysis: AnalysisSpec
    objectives: tuple[str, ...] = ALL
    privacy_metric: PrivacyMetric = PrivacyMetric.MEAN
    filter_only: bool = False
    k: int = K
    seed: int = 0
    known: dict[str, dict[str, float]] = field(default_factory=dict)

    def __post_init__(self):
        self.stream = self.stream.cache()
        if self.stream.isEmpty():
            raise ValueError("the stream is empty")
        self.attributes = attributes_of(self.stream)
        self.bounds = time_bounds(self.stream)
        original = analyse(self.stream, self.analysis, DataFrame.cache)  # the windows serve both
        self.truth = original.output.cache()
        self.profile = profile_stages(original, *self.bounds, self.analysis.resolution).cache()
        for name, made in (("results", self.truth), ("performance", self.profile)):
            if name in self.objectives:
                made.count()
        original.windows.unpersist()

    @cached_property
    def originals(self) -> tuple[list[float], Originals]:
        return prepared(self.stream, self.attributes, self.k)

    def quality(self, pipeline: Pipeline | None) -> dict[str, float]:
        """Scores by objective, in the order of names; zeros if the pipeline is missing or fails."""
        if pipeline is None:
            return dict.fromkeys(self.objectives, 0.0)
        name = str(pipeline)
        if name not in self.known:
            try:
                self.known[name] = self._quality(pipeline)
            except Exception:  # noqa: BLE001 - a pipeline that cannot run is worth nothing
                if self.stream.sparkSession.sparkContext._jsc.sc().isStopped():
                    raise
                logging.getLogger(__name__).exception("no scores for %s", name)
                self.known[name] = dict.fromkeys(self.objectives, 0.0)
        return self.known[name]

    def _quality(self, pipeline: Pipeline) -> dict[str, float]:
        modified = run_pipeline(self.stream, pipeline, self.seed).cache()
        result = analyse(modified, self.analysis, DataFrame.cache)
        try:
            scores = {}
            for name in self.objectives:
                if name == "privacy":
                    scores[name] = privacy_score(modified, self.stream, self.attributes, self.privacy_metric, self.k, self.originals)
                elif name == "results":
                    scores[name] = results_similarity(self.truth, result.output, self.analysis.averaged, self.analysis.tolerance)
                else:
                    scores[name] = performance_similarity(self.profile, profile_stages(result, *self.bounds, self.analysis.resolution), self.filter_only)
            return scores
        finally:
            result.windows.unpersist()
            modified.unpersist()

    def quality_of_tree(self, tree: Tree | None) -> dict[str, float]:
        return self.quality(to_pipeline(tree) if tree is not None else None)


def anonymization_problem(stream: DataFrame, analysis: str, grammar: Grammar, privacy_metric: str = "K_ANONYMITY_CARDINALITY", **more) -> Problem:
    """Three objectives."""
    if analysis not in ANALYSES:
        raise ValueError(f"unknown analysis {analysis}; known: {', '.join(ANALYSES)}")
    return Problem(stream, ANALYSES[analysis], privacy_metric=PrivacyMetric(privacy_metric), filter_only=is_filter_only(grammar), **more)


medical_data_anonymization_problem = anonymization_problem


def anonymization_problem_2o(stream: DataFrame, analysis: str, grammar: Grammar, privacy_metric: str = "K_ANONYMITY_CARDINALITY", **more) -> Problem:
    """Privacy and results."""
    return anonymization_problem(stream, analysis, grammar, privacy_metric, objectives=("privacy", "results"), **more)


def anonymization_problem_2o_perf(stream: DataFrame, analysis: str, grammar: Grammar, privacy_metric: str = "K_ANONYMITY_CARDINALITY", **more) -> Problem:
    """Privacy and performance."""
    return anonymization_problem(stream, analysis, grammar, privacy_metric, objectives=("performance", "privacy"), **more)
