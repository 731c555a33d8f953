import random

import pytest
from simulator import moving, sliding

from veilstream.operators.analysis import HOUR, AnalysisSpec, analyse, at_least, inside_box, sliding_average
from veilstream.operators.modifiers import run_pipeline
from veilstream.operators.profile import dense, difference, profile
from veilstream.plans.ir import Aggregate, Condition, Duplicate, Filter, MovingAggregate, Noise, Pipeline, RandomInRange, simplified

SCHEMA = "seq bigint, dup_path string, ts bigint, key string, event_type string, a double, b double"


def stream(spark, rows):
    return spark.createDataFrame([(k, "", r[0], r[1], "NORMAL", r[2], r[3]) for k, r in enumerate(rows)], SCHEMA)


def random_rows(n=300, seed=1):
    rng = random.Random(seed)
    ts, out = 0, []
    for _ in range(n):
        ts += rng.choice([0, 60_000, 900_000, HOUR, 4 * HOUR])
        out.append((ts, rng.choice("xyz"), rng.choice([None, rng.uniform(-5, 5)]), rng.choice([None, rng.uniform(0, 9), 2.0])))
    return out


@pytest.mark.parametrize("function", list(Aggregate))
@pytest.mark.parametrize("n", [1, 3, 10])
@pytest.mark.parametrize("bits", [2, 20])
def test_moving_aggregate(spark, function, n, bits):
    rows = random_rows(120)
    got = run_pipeline(stream(spark, rows), Pipeline((MovingAggregate("a", function, n),)), bits=bits).orderBy("seq").collect()
    want = moving([r[2] for r in rows], function.value, n)
    assert [None if g["a"] is None else round(g["a"], 9) for g in got] == [None if w is None else round(w, 9) for w in want]
    assert [g["b"] for g in got] == [r[3] for r in rows]


def test_random_in_range_in_blocks(spark):
    rows = random_rows(120)
    one, many = (run_pipeline(stream(spark, rows), Pipeline((RandomInRange("a"),)), bits=b).orderBy("seq").collect() for b in (20, 2))
    assert one == many
    low = high = None
    for r, g in zip(rows, one):
        if r[2] is None:
            assert g["a"] is None
            continue
        low, high = (r[2], r[2]) if low is None else (min(low, r[2]), max(high, r[2]))
        assert low <= g["a"] <= high
    first = next(k for k, r in enumerate(rows) if r[2] is not None)
    assert one[first]["a"] == pytest.approx(rows[first][2])  # a range of one value gives that value


def test_filters_duplicates_noise(spark):
    s = stream(spark, random_rows(100))
    assert run_pipeline(s, Pipeline((Filter("absent", Condition.LT, 1.0),))).count() == 0
    assert all(r["a"] > 1 for r in run_pipeline(s, Pipeline((Filter("a", Condition.GT, 1.0),))).collect())
    twice = run_pipeline(s, Pipeline((Duplicate(1.0), Duplicate(1.0)))).orderBy("seq", "dup_path").collect()
    assert [r["dup_path"] for r in twice[:4]] == ["00", "01", "10", "11"]
    assert [r["event_type"] for r in twice[:4]] == ["NORMAL", "DUPLICATE", "DUPLICATE", "DUPLICATE"]
    same = run_pipeline(s, Pipeline((Noise("a", 0.0),))).orderBy("seq").collect()
    assert [r["a"] for r in same] == [r[2] for r in random_rows(100)]
    assert run_pipeline(s, Pipeline()).collect() == s.collect()
    empty = s.where("false")
    for node in (Filter("a", Condition.GT, 0), Duplicate(0.5), Noise("a", 0.1), RandomInRange("a"), MovingAggregate("a", Aggregate.AVG, 3)):
        assert run_pipeline(empty, Pipeline((node,))).count() == 0


def test_draws_do_not_depend_on_partitions(spark):
    p = Pipeline((Duplicate(0.5), Noise("a", 0.2), RandomInRange("b")))
    s = stream(spark, random_rows(200))
    assert sorted(run_pipeline(s.repartition(7), p, 3).collect(), key=str) == sorted(run_pipeline(s.coalesce(1), p, 3).collect(), key=str)


def test_sliding_average_against_steps(spark):
    for seed in (1, 2, 3):
        rows = random_rows(200, seed)
        events = [{"seq": k, "ts": r[0], "key": r[1], "a": r[2], "b": r[3]} for k, r in enumerate(rows)]
        out = sliding_average(stream(spark, rows), ("a", "b"), 3 * HOUR, HOUR).collect()
        results, markers = sliding(events, ("a", "b"), 3 * HOUR, HOUR)
        assert sorted((r["key"], r["ts"], round(r["a"], 9), round(r["b"], 9)) for r in out if r["event_type"] != "EMPTY_WINDOW") == results
        assert sorted(r["ts"] for r in out if r["event_type"] == "EMPTY_WINDOW") == markers
        assert all(r["key"] == "-1" and r["a"] is None for r in out if r["event_type"] == "EMPTY_WINDOW")


def test_half_open_windows_and_tail(spark):
    s = stream(spark, [(0, "x", 1.0, 1.0), (HOUR, "x", 3.0, 1.0), (3 * HOUR, "x", 5.0, 1.0)])
    spec = AnalysisSpec("t", ("a",), None, lambda df: df["a"] > -9)
    got = sorted((r["ts"], r["a"]) for r in analyse(s, spec).output.collect())
    assert got == [(0, 1.0), (HOUR, 2.0)]  # the window [1 h, 4 h) is still open
    from dataclasses import replace

    assert sorted((r["ts"], r["a"]) for r in analyse(s, replace(spec, flush_tail=True)).output.collect())[-1] == (3 * HOUR, 4.0)


def test_conditions(spark):
    s = stream(spark, [(0, "x", 2.0, 40.0), (1, "x", None, 50.0), (2, "x", 4.0, 39.0)])
    assert s.where(at_least("a", 2.0, "b", 40.0)(s)).count() == 1
    box = stream(spark, [(0, "x", 0.0, 0.0), (1, "x", 2.0, 0.0), (2, "x", 1.9, -1.9)])
    assert box.where(inside_box("a", "b", 0, 0, 2)(box)).count() == 2


def test_profiles(spark):
    s = stream(spark, [(0, "x", 1.0, None), (1, "x", 1.0, None), (HOUR, "y", 1.0, None), (5 * HOUR, "z", 1.0, None)])
    p = profile(s, "s", 0, 4 * HOUR, HOUR)
    cells = {(r["bucket"], r["tuples"], r["keys"]) for r in p.collect()}
    assert cells == {(0, 2, 1), (1, 1, 1), (4, 1, 1)}  # later events fall into the last bucket
    assert dense(p, ["s"], 0, 4 * HOUR, HOUR).count() == 5
    assert all(r["tuples"] == 0 == r["keys"] for r in difference(p, p).collect())
    for bad in (lambda: profile(s, "", 0, 1, 1), lambda: profile(s, "s", 2, 1, 1), lambda: profile(s, "s", 0, 1, 0)):
        with pytest.raises(ValueError):
            bad()


def test_simplifier():
    lt, gt = (lambda v: Filter("a", Condition.LT, v)), (lambda v: Filter("a", Condition.GT, v))
    assert simplified(Pipeline((lt(3), gt(1), lt(2)))) == (Pipeline((gt(1), lt(2))), False)
    assert simplified(Pipeline((lt(1), gt(2))))[1]
    assert not simplified(Pipeline((lt(1), MovingAggregate("a", Aggregate.AVG, 3), gt(2))))[1]
    assert str(Pipeline((Filter("CO(GT)", Condition.LT, 1.23), Noise("T", 0.05)))) == "Pipeline { filter(CO(GT) < 1.2300) | map_noise(attribute=T, percentage=0.05) }"
    assert str(Pipeline()) == "Pipeline {}"


def test_plans_grow_with_the_number_of_operators(spark, tmp_path):
    """A stateful operator reads its input twice, and what is before it is not worked out again."""
    path = str(tmp_path / "s.parquet")
    stream(spark, random_rows(50)).write.parquet(path)
    for node in (MovingAggregate("a", Aggregate.AVG, 3), RandomInRange("a")):
        for n in (1, 2, 4):
            plan = run_pipeline(spark.read.parquet(path), Pipeline((node,) * n))._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan") <= 2
