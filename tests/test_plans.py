import random

import pytest
from test_operators import random_rows, stream

from veilstream.operators.analysis import AnalysisSpec, at_least
from veilstream.plans import grammar as g
from veilstream.plans.experiment import PRESETS, Preset, run_experiment
from veilstream.plans.ir import Condition, Filter, Pipeline, RandomInRange
from veilstream.plans.problem import Problem, anonymization_problem
from veilstream.plans.search import crowding, fronts, nsga2
from veilstream.metrics.privacy import PrivacyMetric
from veilstream.sources.sinks import write_results
from veilstream.sources.streams import column_stats, header_attributes, read_csv

SPEC = AnalysisSpec("t", ("a", "b"), at_least("a", -4.0, "b", 0.0), at_least("a", -9.0, "b", 0.0))


def test_grammar_round_trip():
    text = g.generate_grammar(["CO(GT)", "T"], g.AGGREGATES)
    rules = g.parse_grammar(text)
    assert rules["<operator>"] == [["<filter>"], ["<map_duplicate>"], ["<map_noise>"], ["<map_aggregate>"]]
    assert rules["<attribute>"] == [["'CO(GT)'"], ["'T'"]] and rules["<value>"][0] == ["<dig>", ".", "<dig>", "<dig>", "E", "<sign>", "<dig>"]
    assert g.is_filter_only(g.parse_grammar(g.generate_grammar(["a"], g.FILTERS))) and not g.is_filter_only(rules)
    rng = random.Random(1)
    for _ in range(50):
        tree = g.derive(rules, rng, max_depth=12)
        pipeline = g.to_pipeline(tree)
        assert pipeline.nodes and all(getattr(n, "attribute", "T") in ("CO(GT)", "T") for n in pipeline.nodes)


def test_tree_to_pipeline():
    leaf = lambda s, *c: g.Tree(s, [x if isinstance(x, g.Tree) else g.Tree(x) for x in c])
    value = leaf("<value>", *"1.23", "E", "+", "0")
    f = leaf("<operator>", leaf("<filter>", leaf("<attribute>", "'T'"), leaf("<condition>", "gt"), value))
    broken = leaf("<operator>", leaf("<filter>", leaf("<attribute>", "'T'"), leaf("<condition>", "odd"), value))
    rir = leaf("<operator>", leaf("<map_rir>", leaf("<attribute>", "'T'")))
    tree = leaf("<pipeline>", f, leaf("<pipeline>", broken, leaf("<pipeline>", rir)))
    assert g.to_pipeline(tree) == Pipeline((Filter("T", Condition.GT, 1.23), RandomInRange("T")))
    assert g.to_pipeline(g.Tree("<pipeline>")) == Pipeline()


def test_sorting():
    q = [(1.0, 0.0), (0.0, 1.0), (0.5, 0.5), (0.4, 0.4), (0.0, 0.0)]
    assert fronts(q) == [[0, 1, 2], [3], [4]]
    assert crowding(q, [0, 1, 2])[2] == 2.0
    rules = g.parse_grammar(g.generate_grammar(["a"], g.FILTERS))
    score = lambda tree: (float(len(g.to_pipeline(tree).nodes)), -float(tree.size()))
    a, b = ([[p.quality for p in people] for people in nsga2(rules, score, 60, seed=4, population=20)] for _ in range(2))
    assert a == b and len(a) == 3


def test_problem(spark):
    problem = Problem(stream(spark, random_rows(150)), SPEC, k=5)
    same = problem.quality(Pipeline())
    assert list(same) == ["performance", "privacy", "results"] and same["performance"] == 1.0 == same["results"]
    nothing = problem.quality(Pipeline((Filter("a", Condition.GT, 1e9),)))
    assert nothing["privacy"] == 0.0 == nothing["results"]
    assert problem.quality(None) == dict.fromkeys(problem.objectives, 0.0)
    with pytest.raises(ValueError):
        Problem(stream(spark, random_rows(3)).where("false"), SPEC)
    with pytest.raises(ValueError):
        anonymization_problem(stream(spark, random_rows(3)), "unknown", {})


def test_a_problem_files_its_originals_once(spark, monkeypatch):
    """However many pipelines are scored, and with the score that each has by itself."""
    from veilstream.metrics.privacy import privacy_score
    from veilstream.operators.modifiers import run_pipeline
    from veilstream.plans import problem as module

    calls, plain = [], module.prepared
    monkeypatch.setattr(module, "prepared", lambda *a: calls.append(a) or plain(*a))
    problem = Problem(stream(spark, random_rows(80)), SPEC, k=5)
    for value in (-1.0, 0.5):
        pipeline = Pipeline((Filter("a", Condition.GT, value),))
        assert problem.quality(pipeline)["privacy"] == pytest.approx(privacy_score(run_pipeline(problem.stream, pipeline), problem.stream, problem.attributes, k=5)) != 0.0
    assert len(calls) == 1


def test_experiment(spark, tmp_path):
    preset = Preset(SPEC, g.FILTERS, PrivacyMetric.MEAN, ("privacy", "results"), "", 3, (1,))
    solutions, traces = run_experiment(stream(spark, random_rows(60)), preset, str(tmp_path), k=5)
    assert len(solutions) == 1 and "p75_privacy_solution" in solutions[0] and len(traces) == 1
    assert len(PRESETS) == 5
    assert (tmp_path / "solutions").exists()
    assert traces[0]["privacy_p75_results"] >= 0.0
    dots = (tmp_path / "scatter-privacy-vs-results-001.svg").read_text()
    assert dots.count("<circle") == 3 and (tmp_path / "privacy_p75.svg").read_text().count("<polyline") == 1 and (tmp_path / "results_p75_privacy.svg").exists()


CSV = """SensorID,timestamp,CO(GT),note,ID,T,void
1, 0 ,2.5,x,9,1d,
1,3600000,NaN,y,9,0x1p3,
SensorID,timestamp,CO(GT),note,ID,T,void
2,bad,1,z,9,2,
2,7200000,,"a,b",9,3,nan
"""


def test_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(CSV.replace("SensorID,timestamp,CO(GT),note,ID,T,void\n2", "2"))
    loaded = read_csv(spark, str(path), "SensorID")
    rows = loaded.events.orderBy("seq").collect()
    assert loaded.attributes == ["CO(GT)", "T", "void"]
    assert [(r["ts"], r["key"], r["CO(GT)"], r["T"]) for r in rows] == [(0, "1", 2.5, 1.0), (3600000, "1", None, 8.0), (7200000, "2", None, 3.0)]
    assert read_csv(spark, str(path)).events.first()["key"] == "GLOBAL"
    assert header_attributes(str(path), ["timestamp", "ID", "SensorID"]) == ["CO(GT)", "note", "T", "void"]
    stats = {r["attribute"]: r for r in column_stats(spark.read.option("header", True).csv(str(path)), ["CO(GT)", "note"]).collect()}
    assert stats["CO(GT)"]["max_value"] == 2.5 and stats["CO(GT)"]["max_digits"] == 1 and "note" not in stats
    write_results(loaded.events, str(tmp_path / "out"))
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "out").glob("*.csv")) == 3


def test_repeated_header_is_skipped(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("timestamp,a\n1,2\ntimestamp,a\n2,3\n")
    loaded = read_csv(spark, str(path))
    assert loaded.events.count() == 2 and loaded.attributes == ["a"]


def test_grammar_helpers():
    assert g.integer_rule("<int>", 1, 3) == "<int> ::= <digit> | <non_zero_digit> <digit> | <non_zero_digit> <digit> <digit>\n"
    assert g.fraction_rule("<frac>") == "<frac> ::= <digit>\n" and g.clean_name("PT08.S1(CO)") == "PT08_S1_CO"


EXPERIMENT = """$basePath = ''runs/{^^.name}/{^^.startTime}/''
ea.experiment(runs = (randomGenerator = (seed = [1:1:2]) * [m.defaultRG()]) * [ea.run(
  solver = ea.s.nsga2(stop = ea.sc.nOfQualityEvaluations(n = 2); representation = ea.r.cfgTree(grammar = ea.grammar.fromFile(path = "GRAMMAR")));
  problem = anonym.problem.anonymizationProblem2OPerf(inputCsvPath = "INPUT"; grammarPath = "GRAMMAR"; privacyMetric = K_ANONYMITY_CARDINALITY_MAX; keyColumn = "user"))])"""


def test_experiment_by_file(spark, tmp_path):
    from veilstream.plans.files import problem_from_files, read_experiment, run_file
    from veilstream.sources.sinks import write_grammar

    rng = random.Random(2)
    lines = [f"{rng.choice('xy')},{k * 600_000},{341097.79 + rng.uniform(-900, 900)},{111055.5 + rng.uniform(-900, 900)}" for k in range(80)]
    (tmp_path / "in.csv").write_text("user,timestamp,avg_X,avg_Y\n" + "\n".join(lines) + "\n")
    write_grammar(g.generate_grammar(["avg_X", "avg_Y"], g.RIR), f"file://{tmp_path}/grammar.bnf")
    text = EXPERIMENT.replace("INPUT", str(tmp_path / "in.csv")).replace("GRAMMAR", str(tmp_path / "grammar.bnf"))
    (tmp_path / "try.txt").write_text(text)
    e = read_experiment(text)
    assert (e.builder, e.seeds, e.evaluations, e.key_column, e.privacy_metric) == ("anonymizationProblem2OPerf", (1, 2), 2, "user", "K_ANONYMITY_CARDINALITY_MAX")
    problem = problem_from_files(spark, "anonymizationProblem2O", e.input_csv_path, e.grammar_path, e.privacy_metric, e.key_column, k=3)
    assert problem.quality(Pipeline()) == {"privacy": pytest.approx(problem.quality(Pipeline())["privacy"]), "results": 1.0} and not problem.filter_only
    folder = run_file(spark, str(tmp_path / "try.txt"), str(tmp_path / "out"), k=3)
    rows = spark.read.option("header", True).csv(f"{folder}/solutions").collect()
    assert "/out/runs/try/" in folder and [r["seed"] for r in rows] == ["001", "002"] and "p75_privacy_solution" in rows[0].asDict()
