import math
import random

import pytest
from test_operators import random_rows, stream

from veilstream.metrics.fidelity import f1_counts, results_similarity, similar
from veilstream.metrics.performance import performance_similarity
from veilstream.metrics.privacy import PrivacyMetric, cardinality_factor, privacy_score, spread, summary
from veilstream.operators.profile import profile
from pyspark.sql import functions as F


def test_similar(spark):
    cases = [(0.0, 0.0, True), (0.0, 1e-10, True), (0.0, 1.0, False), (10.0, 11.5, True), (10.0, 11.6, False), (None, 1.0, False), (1.0, None, False)]
    df = spark.createDataFrame([c[:2] for c in cases], "t double, p double")
    assert [r[0] for r in df.select(similar(F.col("t"), F.col("p"), 0.15)).collect()] == [c[2] for c in cases]


def test_results_similarity(spark):
    s = stream(spark, [(k, "x", float(k + 1), 1.0) for k in range(20)])
    assert results_similarity(s, s, ("a", "b"), 0.1) == 1.0
    assert results_similarity(s, s.where("false"), ("a", "b"), 0.1) == 0.0
    assert results_similarity(s.where("false"), s.where("false"), ("a", "b"), 0.1) == 0.0
    half = s.where("seq < 10")
    assert f1_counts(s, half, ("a",), 0.1).first()["f1"] == pytest.approx(2 * 10 / 30)


def test_performance(spark):
    p = profile(stream(spark, random_rows(80)), "s", 0, 10**9, 3_600_000)
    assert performance_similarity(p, p) == 1.0
    assert performance_similarity(p, None) == 0.0
    none = performance_similarity(p, p.where("false"))
    assert none == pytest.approx(1 - math.sqrt(2 / 5))  # each cell off by its whole, of at most (2, 1) times that
    assert performance_similarity(p, p.where("false"), filter_only=True) == pytest.approx(0.0)
    assert performance_similarity(p.where("false"), p.where("false")) == 1.0


def brute(original, modified, k):
    n = len(original[0])
    inv = []
    for d in range(n):
        v = [o[d] for o in original if o[d] is not None]
        m = sum(v) / len(v) if v else 0
        s = math.sqrt(sum((x - m) ** 2 for x in v) / (len(v) - 1)) if len(v) > 1 else 0
        inv.append(1 / s if s > 1e-9 else 1.0)
    out = []
    for m in modified:
        if all(x is None for x in m):
            continue
        ds = []
        for o in original:
            both = [((m[d] - o[d]) * inv[d]) ** 2 for d in range(n) if m[d] is not None and o[d] is not None]
            if both:
                ds.append(math.sqrt(sum(both) / len(both)))
        near = sorted(ds)[:k]
        if len(near) > 1:
            mean = sum(near) / len(near)
            out.append(math.sqrt(sum((x - mean) ** 2 for x in near) / (len(near) - 1)))
    return sorted(out)


def test_privacy(spark):
    rng = random.Random(5)
    rows = [(k, "x", rng.choice([None, rng.gauss(0, 3)]), rng.choice([None, rng.random()])) for k in range(60)]
    s = stream(spark, rows)
    m = s.where("seq % 3 > 0")
    values = [r[2:] for r in rows]
    want = brute(values, [v for k, v in enumerate(values) if k % 3], 7)
    got = sorted(r["risk"] for r in spread(m, s, ["a", "b"], 7).collect())
    assert got == pytest.approx(want)
    stats = summary(spread(m, s, ["a", "b"], 7)).first()
    assert stats["max"] == pytest.approx(want[-1]) and stats["q95"] == pytest.approx(want[int(0.95 * (len(want) - 1))])
    assert privacy_score(m, s, ["a", "b"], PrivacyMetric.MAX, 7) == pytest.approx(40 / 60 / (1 + want[-1]))
    assert privacy_score(s.where("false"), s, ["a", "b"]) == 0.0
    with pytest.raises(ValueError):
        spread(m, s, ["a"], 1)


@pytest.mark.parametrize("leaves, block", [(1, 50_000), (8, 50_000), (64, 7)])
def test_nearest_in_cells(spark, monkeypatch, leaves, block):
    """Any number of cells and blocks finds what all pairs have, with missing values, many equal rows and far ones."""
    from veilstream.metrics import privacy

    monkeypatch.setattr(privacy, "BLOCK_ROWS", block)
    rng = random.Random(leaves)
    value = lambda: rng.choice([None, 0.0, rng.gauss(0, 1), rng.gauss(5, 0.1), 100.0])
    rows = [(k, [value(), value(), value()]) for k in range(300)]
    rows = [r for r in rows if any(x is not None for x in r[1])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {r["id"]: r["near"] for r in privacy.nearest(df.where("id % 3 = 0"), df.where("id % 2 = 0").select("v"), 5, leaves).collect()}
    for k, v in rows:
        if k % 3 == 0:
            both = [[(a, b) for a, b in zip(v, w) if a is not None and b is not None] for i, w in rows if i % 2 == 0]
            assert got[k] == pytest.approx(sorted(math.sqrt(sum((a - b) ** 2 for a, b in x) / len(x)) for x in both if x)[:5])


def test_work_of_a_tuple_does_not_grow_with_the_originals(monkeypatch):
    """Cells are cut as finely as asked, also where most values are equal, and in a cell few points are looked at."""
    import numpy as np

    from veilstream.metrics import privacy

    rng, plain, seen = np.random.default_rng(2), privacy.distances, []
    ties = np.stack([np.where(rng.random(4000) < 0.6, 9.0, rng.random(4000)), rng.random(4000)], axis=1)
    cells = privacy.Cells(ties, 64)(ties)
    assert len(np.unique(cells)) >= 32 and np.bincount(np.unique(cells, return_inverse=True)[1]).max() < 400
    monkeypatch.setattr(privacy, "distances", lambda a, b: seen.append(len(a) * len(b)) or plain(a, b))
    for n in (2000, 32_000):
        points, numbers, rows = rng.random((n, 2)), rng.integers(1, 4, n), rng.random((200, 2))
        seen.clear()
        got = privacy.Boxes(points, numbers).nearest(rows, 10)
        assert sum(seen) / 200 < 1200
        every = np.repeat(points, numbers, axis=0)
        assert np.allclose(got, [np.sort(np.sqrt(((every - r) ** 2).sum(axis=1) / 2))[:10] for r in rows])


def test_cells_grow_with_the_originals(spark, monkeypatch):
    """As many cells as points need, equal originals as one point; a prepared stream can be asked again."""
    from veilstream.metrics import privacy

    monkeypatch.setattr(privacy, "CELL_ROWS", 20)
    rng = random.Random(6)
    values = [(k, [rng.random(), rng.choice([None, rng.random()])]) for k in range(700)]
    df = spark.createDataFrame(values * 3, "id bigint, v array<double>")
    originals = privacy.Originals(df, 5)
    assert len(originals.sizes) > 16 and sum(originals.sizes.values()) == 700
    for part in ("id % 90 = 0", "id % 80 = 1"):
        rows = originals.nearest(df.where(part).groupBy("v").count().withColumnRenamed("count", "n")).collect()
        assert len(rows) > 5 and all(r["n"] == 3 for r in rows)
        for r in rows:
            both = [[(a, b) for a, b in zip(r["v"], w) if a is not None and b is not None] for _, w in values for _ in range(3)]
            assert r["near"] == pytest.approx(sorted(math.sqrt(sum((a - b) ** 2 for a, b in x) / len(x)) for x in both)[:5])


def test_cardinality():
    assert cardinality_factor(10, 10) == 1.0 and cardinality_factor(10, 5) == 0.5 == cardinality_factor(5, 10)
    assert cardinality_factor(0, 0) == 1.0 and cardinality_factor(0, 3) == 0.0 and cardinality_factor(3, 0) == 0.0


def test_predictions_take_the_first_similar_truth(spark):
    """For equal times and keys, against the steps one by one."""
    made = lambda values: stream(spark, [(0, "x", v, 1.0) for v in values])
    rng = random.Random(3)
    assert f1_counts(made([1.0, 10.0]), made([10.0]), ("a",), 0.1).first()["matched"] == 1
    for _ in range(4):
        truth, predicted = ([rng.choice([1.0, 1.05, 1.1, 2.0, None]) for _ in range(rng.randint(1, 6))] for _ in range(2))
        left, matched = list(truth), 0
        for p in predicted:
            hit = next((k for k, t in enumerate(left) if None not in (t, p) and abs(t - p) / abs(t) <= 0.06), None)
            if hit is not None:
                left.pop(hit)
                matched += 1
        assert f1_counts(made(truth), made(predicted), ("a",), 0.06).first()["matched"] == matched
