"""Experiments: named presets, runs over seeds, and their tables of solutions and traces.

Run as a program: python -m veilstream.plans.experiment (-p PRESET -i INPUT | -f FILE) -o OUTPUT [-e EVALUATIONS] [-nt THREADS] [-v]
"""

from __future__ import annotations

import argparse
import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from veilstream.plans import grammar as g
from veilstream.plans.problem import ALL, Problem
from veilstream.metrics.privacy import PrivacyMetric
from veilstream.operators.analysis import ANALYSES
from veilstream.plans.search import nsga2, percentile
from veilstream.sources.sinks import write_lines, write_scatter, write_solutions
from veilstream.sources.streams import read_csv


@dataclass(frozen=True)
class Preset:
    analysis: str
    operators: tuple[str, ...]
    metric: PrivacyMetric
    objectives: tuple[str, ...]
    key: str
    evaluations: int
    seeds: tuple[int, ...]


#: The customary experiments.
PRESETS = {
    "experiment": Preset("trajectories", g.RIR, PrivacyMetric.Q99, ALL, "user", 500, (1,)),
    "medical_data": Preset("trajectories", g.RIR, PrivacyMetric.Q99, ALL, "user", 500, (1,)),
    "experiment_2obj_results": Preset("air_quality", g.AGGREGATES, PrivacyMetric.MAX, ("privacy", "results"), "SensorID", 5000, (1, 2, 3, 4, 5)),
    "experiment_2obj_performance": Preset("air_quality", g.AGGREGATES, PrivacyMetric.MAX, ("performance", "privacy"), "SensorID", 5000, (1, 2, 3, 4, 5)),
    "readme_example": Preset("air_quality", g.AGGREGATES, PrivacyMetric.MAX, ALL, "SensorID", 5000, (1,)),
}


def run_experiment(stream: DataFrame, preset: Preset, output: str | None = None, evaluations: int | None = None, threads: int = 1, verbose: bool = False, rules: g.Grammar | None = None, **problem) -> tuple[list[dict], list[dict]]:
    """(solutions, traces): the individuals at percentiles 100 and 75 by each objective, and percentiles by generation.

    rules: the grammar, where it does not follow from the preset's operators.
    """
    spark = stream.sparkSession
    made = Problem(stream, ANALYSES[preset.analysis] if isinstance(preset.analysis, str) else preset.analysis, preset.objectives, preset.metric, g.is_filter_only(rules) if rules else preset.operators == g.FILTERS, **problem)
    rules = rules or g.parse_grammar(g.generate_grammar(made.attributes, preset.operators))
    solutions, traces = [], []
    for seed in preset.seeds:
        people = []
        evaluate = lambda tree: tuple(made.quality_of_tree(tree).values())
        for generation, people in enumerate(nsga2(rules, evaluate, evaluations or preset.evaluations, seed, threads=threads)):
            row = {"seed": seed, "generation": generation, "best_size": min(p.tree.size() for p in people)}
            for k, name in enumerate(preset.objectives):
                for p in (50, 75, 100):  # and what the individual at that percentile has of the other objectives
                    chosen = percentile(people, k, p).quality
                    row |= {f"{name}_p{p}": chosen[k]} | {f"{name}_p{p}_{o}": chosen[j] for j, o in enumerate(preset.objectives) if j != k}
            traces.append(row)
            if verbose:
                print(row)
        if output:
            for i, j in itertools.combinations(range(len(preset.objectives)), 2):
                x, y = preset.objectives[i], preset.objectives[j]
                write_scatter([(p.quality[i], p.quality[j]) for p in people], x, y, f"{output}/scatter-{x}-vs-{y}-{seed:03d}.svg")
        row = {"seed": f"{seed:03d}"}
        for p in (100, 75):
            for k, name in enumerate(preset.objectives):
                chosen = percentile(people, k, p)
                row |= {f"p{p}_{name}_{o}": chosen.quality[j] for j, o in enumerate(preset.objectives)} | {f"p{p}_{name}_solution": str(g.to_pipeline(chosen.tree))}
        solutions.append(row)
    if output:
        write_solutions(spark, solutions, f"{output}/solutions")
        write_solutions(spark, traces, f"{output}/traces")
        for name in [c for c in traces[0] if "_p75" in c]:
            by_seed = {str(s): [t[name] for t in traces if t["seed"] == s] for s in preset.seeds}
            write_lines(by_seed, "generation", name, f"{output}/{name}.svg")
    return solutions, traces


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("-p", "--preset", choices=sorted(PRESETS))
    what.add_argument("-f", "--file", help="the text form of an experiment")
    p.add_argument("-i", "--input")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-e", "--evaluations", type=int)
    p.add_argument("-nt", "--threads", type=int, default=1)
    p.add_argument("-v", "--verbose", action="store_true")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.config("spark.scheduler.mode", "FAIR").getOrCreate()
    if a.file:
        from veilstream.plans.files import run_file

        run_file(spark, a.file, a.output, a.evaluations, a.threads, a.verbose)
        return
    if not a.input:
        p.error("a preset needs an input")
    preset = PRESETS[a.preset]
    run_experiment(read_csv(spark, a.input, preset.key).events, preset, a.output, a.evaluations, a.threads, a.verbose)


if __name__ == "__main__":
    main()
