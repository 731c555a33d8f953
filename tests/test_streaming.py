from test_operators import random_rows, stream

from veilstream.operators.analysis import AnalysisSpec, analyse, at_least
from veilstream.operators.modifiers import run_pipeline
from veilstream.plans.ir import Aggregate, Condition, Duplicate, Filter, MovingAggregate, Noise, Pipeline, RandomInRange
from veilstream.streaming.analysis import run_to_table, sliding_average_stream, stream_of_files, windows_stream
from veilstream.streaming.modifiers import run_pipeline_stream

SPEC = AnalysisSpec("t", ("a", "b"), at_least("a", -4.0, "b", 0.0), at_least("a", -9.0, "b", 0.0))


def files(spark, tmp_path, rows):
    whole = stream(spark, rows)
    for k in range(3):  # in the order of events
        n = len(rows)
        whole.where(f"seq >= {k * n // 3} and seq < {(k + 1) * n // 3}").coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    target = tmp_path / "in"
    target.mkdir()
    for k in range(3):
        (next((tmp_path / f"part{k}").glob("*.parquet"))).rename(target / f"{k}.parquet")
    return whole, stream_of_files(spark, str(target), whole.schema)


def rounded(df):
    return sorted(((r["seq"], r["dup_path"], r["ts"], r["key"], None if r["a"] is None else round(r["a"], 9), None if r["b"] is None else round(r["b"], 9)) for r in df.collect()), key=str)


def test_analysis_as_in_batch(spark, tmp_path):
    whole, arriving = files(spark, tmp_path, random_rows(200))
    query = run_to_table(sliding_average_stream(arriving, SPEC), "analysed")
    query.awaitTermination()
    batch = analyse(whole, SPEC)
    assert rounded(spark.table("analysed")) == rounded(batch.output)
    run_to_table(windows_stream(arriving, SPEC), "windows").awaitTermination()
    assert [r[3] for r in rounded(spark.table("windows"))].count("-1") > 5
    assert rounded(spark.table("windows")) == rounded(batch.stages["afterAggregate"])


def test_modifiers_as_in_batch(spark, tmp_path):
    whole, arriving = files(spark, tmp_path, random_rows(90))
    pipeline = Pipeline((Filter("b", Condition.LT, 8.0), Duplicate(0.4), Noise("b", 0.1), MovingAggregate("a", Aggregate.AVG, 4)))
    for name, p in (("m1", pipeline), ("m2", Pipeline((RandomInRange("a"),)))):
        query = run_to_table(run_pipeline_stream(arriving, p, 2), name)
        query.awaitTermination()
        assert rounded(spark.table(name)) == rounded(run_pipeline(whole, p, 2))


def test_csv_files(spark, tmp_path):
    from veilstream.streaming.analysis import stream_of_csv

    source = tmp_path / "csv"
    source.mkdir()
    (source / "1.csv").write_text("Timestamp,user,A,EventType\n1,u, 2.5 ,duplicate\nTimestamp,user,A,EventType\n2,v,NaN,odd\n")
    (source / "2.csv").write_text("Timestamp,user,A,EventType\nx,u,1,\n3,u,,\n")
    events = stream_of_csv(spark, str(source), ["Timestamp", "user", "A", "EventType"], ["a"], "USER")
    run_to_table(events, "lines").awaitTermination()
    got = [(r["ts"], r["key"], r["event_type"], r["a"]) for r in spark.table("lines").orderBy("seq").collect()]
    assert got == [(1, "u", "DUPLICATE", 2.5), (2, "v", "NORMAL", None), (3, "u", "NORMAL", None)]
