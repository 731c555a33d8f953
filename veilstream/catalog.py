"""Registered queries over the stream tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.metrics.fidelity import f1_counts
from veilstream.metrics.performance import largest_distance, performance_frame
from veilstream.metrics.privacy import cardinality_factor, spread, summary
from veilstream.operators.analysis import AnalysisSpec, analyse, at_least, inside_box
from veilstream.operators.modifiers import run_pipeline
from veilstream.operators.profile import dense, difference, profile, profile_stages
from veilstream.plans import grammar as g
from veilstream.plans.ir import Aggregate, Condition, Duplicate, Filter, MovingAggregate, Noise, Pipeline, RandomInRange
from veilstream.plans.problem import Problem
from veilstream.plans.search import nsga2
from veilstream.sources.scratch import scratch_root
from veilstream.sources.streams import attributes_of, column_stats, epoch_millis, from_table, from_text_rows, q, read_csv, time_bounds

Query = Callable[[SparkSession, str], DataFrame]
SPEC = AnalysisSpec("events", ("value", "k"), at_least("value", 2.0, "k", 40.0), at_least("value", 5.0, "k", 60.0))
BOX = AnalysisSpec("events_box", ("value", "k"), None, inside_box("value", "k", 25.0, 50.0, 20.0), 0.10)
MIXED = Pipeline((Filter("value", Condition.GT, 1.0), Duplicate(0.3), Noise("value", 0.05), MovingAggregate("k", Aggregate.AVG, 4), RandomInRange("value")))
THINNED = Pipeline((Filter("value", Condition.GT, 10.0), Noise("k", 0.10)))

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _register(name: str, query: Query, sql: str | None) -> None:
    _QUERIES[name] = query
    if sql:
        _ORACLES[name] = sql


def events(spark: SparkSession, sf_dir: str, missing: int = 0) -> DataFrame:
    """The events table as a stream; every missing-th event without a value."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.col("value") if not missing else F.when(F.col("event_id") % missing != 0, F.col("value"))
    k = F.get_json_object("props", "$.k").try_cast("double")
    return from_table(rows, F.col("event_id"), epoch_millis(F.col("ts")), F.col("user_id"), {"value": value, "k": k})


def _events_sql(missing: int = 0) -> str:
    value = "value" if not missing else f"case when event_id % {missing} <> 0 then value end"
    return f"select event_id as seq, '' as dup_path, epoch_us(ts) // 1000 as ts, cast(user_id as varchar) as key, 'NORMAL' as event_type, {value} as value, try_cast(json_extract_string(props, '$.k') as double) as k from events"


def shown(stream: DataFrame) -> DataFrame:
    """The columns that are compared, doubles rounded."""
    return stream.select("seq", "dup_path", "ts", "key", "event_type", *[F.round(q(a), 6).alias(a) for a in attributes_of(stream)])


_SHOWN = "seq, dup_path, ts, key, event_type, round(value, 6) as value, round(k, 6) as k"


def _uniform(salt: str) -> str:
    return f"(cast('0x' || substr(md5(concat_ws('|', '{salt}', dup_path, cast(seq as varchar))), 1, 13) as bigint) / 4503599627370496.0)"


def node_sql(node, number: int, seed: int = 0) -> str:
    """The SELECT of one modifier over a relation named s."""
    salt = f"{seed}/{number}"
    if isinstance(node, Filter):
        return f"select * from s where {node.attribute} {node.condition.sign} {node.value!r}"
    if isinstance(node, Duplicate):
        return f"select seq, dup_path || c as dup_path, ts, key, case when c = '1' then 'DUPLICATE' else event_type end as event_type, value, k from (select *, unnest(case when {_uniform(salt)} < {node.probability!r} then ['0', '1'] else ['0'] end) as c from s)"
    a = node.attribute
    if isinstance(node, Noise):
        normal = f"(sqrt(-2.0 * ln(1.0 - {_uniform(salt + '/r')})) * cos(2.0 * pi() * {_uniform(salt + '/a')}))"
        return f"select * replace ({a} * (1.0 + {node.percentage!r} * {normal}) as {a}) from s"
    if isinstance(node, RandomInRange):
        over = "over (order by seq, dup_path rows between unbounded preceding and current row)"
        return f"select * replace (case when {a} is not null then min({a}) {over} + {_uniform(salt)} * (max({a}) {over} - min({a}) {over}) end as {a}) from s"
    over = f"over (partition by {a} is null order by seq, dup_path rows between {node.window - 1} preceding and current row)"
    return f"select * replace (case when {a} is not null then {node.function.value}({a}) {over} end as {a}) from s"


def pipeline_sql(pipeline: Pipeline, missing: int = 0, seed: int = 0) -> str:
    out = _events_sql(missing)
    for number, node in enumerate(pipeline.nodes):
        out = f"with s as ({out}) {node_sql(node, number, seed)}"
    return out


def _modifier(name: str, pipeline: Pipeline, missing: int = 0, bits: int = 20) -> None:
    _register(name, lambda spark, d: shown(run_pipeline(events(spark, d, missing), pipeline, bits=bits)), f"select {_SHOWN} from ({pipeline_sql(pipeline, missing)})")


_modifier("filter_lt", Pipeline((Filter("value", Condition.LT, 20.0),)))
_modifier("filter_gt", Pipeline((Filter("value", Condition.GT, 20.0),)), 7)
_register("filter_unknown_attribute", lambda spark, d: shown(run_pipeline(events(spark, d), Pipeline((Filter("absent", Condition.GT, 0.0),)))), f"select {_SHOWN} from ({_events_sql()}) where false")
_modifier("map_duplicate_p", Pipeline((Duplicate(0.4),)))
_modifier("map_duplicate_always", Pipeline((Duplicate(1.0),)))
_modifier("map_duplicate_chain", Pipeline((Duplicate(0.5), Duplicate(0.5))))
_modifier("map_noise", Pipeline((Noise("value", 0.10),)), 7)
_modifier("map_rir", Pipeline((RandomInRange("value"),)), 7, 10)
_modifier("map_aggregate_avg", Pipeline((MovingAggregate("value", Aggregate.AVG, 5),)), 0, 10)
_modifier("map_aggregate_min", Pipeline((MovingAggregate("value", Aggregate.MIN, 3),)), 0, 10)
_modifier("map_aggregate_max", Pipeline((MovingAggregate("value", Aggregate.MAX, 10),)), 0, 10)
_modifier("map_aggregate_with_nulls", Pipeline((MovingAggregate("value", Aggregate.AVG, 4),)), 3, 8)
_modifier("pipeline_mixed", MIXED, 7, 10)
_modifier("pipeline_empty", Pipeline())


def analysis_sql(stream: str, before: str | None, after: str, flush: bool = False) -> str:
    """CTEs src, kept, windows (afterAggregate) and out (outputStream), to be followed by a SELECT."""
    return f"""
with src as ({stream}), kept as (select * from src {'where ' + before if before else ''}),
spread as (select *, (ts // 3600000 - o) * 3600000 as ws from kept, (select unnest([0, 1, 2]) as o)),
grouped as (select key, ws, ws + 10800000 as we, count(*) filter (where value is not null and k is not null) as n,
  avg(value) filter (where value is not null and k is not null) as av, avg(k) filter (where value is not null and k is not null) as ak,
  arg_max({{'seq': seq, 'dup_path': dup_path, 'ts': ts, 'event_type': event_type}}, (lpad(cast(seq as varchar), 20, '0') || dup_path)) filter (where value is not null and k is not null) as l
  from spread group by key, ws),
closed as (select *, coalesce(l.ts >= we - 3600000, false) as fresh from grouped {'' if flush else 'where we <= (select max(ts) from kept)'}),
windows as (select coalesce(case when fresh then l.seq end, -1) as seq, coalesce(case when fresh then l.dup_path end, '') as dup_path, case when fresh then l.ts else ws end as ts,
  case when fresh then key else '-1' end as key, case when fresh then l.event_type else 'EMPTY_WINDOW' end as event_type, case when fresh then av end as value, case when fresh then ak end as k from closed),
out as (select * from windows where event_type <> 'EMPTY_WINDOW' and {after})
"""


_BEFORE, _AFTER = "value >= 2.0 and k >= 40.0", "value >= 5.0 and k >= 60.0"
_INSIDE = "value > 5.0 and value < 45.0 and k > 30.0 and k < 70.0"


def _analysis(name: str, spec: AnalysisSpec, stage: str, before: str | None, after: str, relation: str, missing: int = 0) -> None:
    _register(name, lambda spark, d: shown(analyse(events(spark, d, missing), spec).stages[stage]), analysis_sql(_events_sql(missing), before, after, spec.flush_tail) + f"select {_SHOWN} from {relation}")


_analysis("analysis_two_attr", SPEC, "outputStream", _BEFORE, _AFTER, "out")
_analysis("analysis_flush_tail", replace(SPEC, flush_tail=True), "outputStream", _BEFORE, _AFTER, "out")
_analysis("analysis_box", BOX, "outputStream", None, _INSIDE, "out", 5)
_analysis("empty_window_markers", SPEC, "afterAggregate", _BEFORE, _AFTER, "windows")


def _carry(spark: SparkSession, d: str) -> DataFrame:
    """Averages of one attribute; the other comes from the window's last event."""
    spec = AnalysisSpec("carry", ("value",), None, lambda s: F.lit(True))
    return shown(analyse(events(spark, d, 3), spec).output)


_register("analysis_carry_last_event", _carry, f"""
with src as ({_events_sql(3)}), spread as (select *, (ts // 3600000 - o) * 3600000 as ws from src, (select unnest([0, 1, 2]) as o)),
grouped as (select key, ws + 10800000 as we, avg(value) as av, arg_max({{'seq': seq, 'ts': ts, 'k': k}}, seq) filter (where value is not null) as l from spread group by key, ws)
select l.seq as seq, '' as dup_path, l.ts as ts, key, 'NORMAL' as event_type, round(av, 6) as value, round(l.k, 6) as k from grouped
where we <= (select max(ts) from src) and l.ts >= we - 3600000""")

_BOUNDS = "bounds as (select min(ts) as lo, max(ts) as hi from src)"


def _cells(relation: str, name: str) -> str:
    bucket = "cast(greatest(0, least((hi - lo) // 3600000, cast(floor((ts - lo) / 3600000.0) as bigint))) as int)"
    return f"select '{name}' as stream, {bucket} as bucket, count(*) as tuples, count(distinct case when event_type <> 'EMPTY_WINDOW' then key end) as keys from {relation}, bounds group by 1, 2"


_STAGES = {"profile_source": ("sourceStream", "src"), "profile_after_filter": ("afterFilter1", "kept"), "profile_after_aggregate": ("afterAggregate", "windows"), "profile_output": ("outputStream", "out")}


def _stage_profile(stage: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        stream = events(spark, d)
        return profile(analyse(stream, SPEC).stages[stage], stage, *time_bounds(stream), SPEC.resolution)

    return query


for _name, (_stage, _relation) in _STAGES.items():
    _register(_name, _stage_profile(_stage), analysis_sql(_events_sql(), _BEFORE, _AFTER).rstrip() + f", {_BOUNDS} {_cells(_relation, _stage)}")


def _profiles_sql(prefix: str, stream: str) -> str:
    """A CTE for each stage of an analysis of a stream, and the profile of all of them as <prefix>p."""
    body = analysis_sql(stream, _BEFORE, _AFTER).strip().removeprefix("with ")
    cells = " union all ".join(_cells(r, s) for s, r in _STAGES.values())
    return f"{prefix}p as (with {body}, bounds as (select min(ts) as lo, max(ts) as hi from ({_events_sql()})) {cells})"


def _two_profiles(spark: SparkSession, d: str, pipeline: Pipeline) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    stream = events(spark, d)
    bounds = time_bounds(stream)
    changed = run_pipeline(stream, pipeline)
    return profile_stages(analyse(stream, SPEC), *bounds, SPEC.resolution), profile_stages(analyse(changed, SPEC), *bounds, SPEC.resolution), bounds


def _profile_dense(spark: SparkSession, d: str) -> DataFrame:
    stream = events(spark, d)
    bounds = time_bounds(stream)
    found = profile(analyse(stream, SPEC).output, "outputStream", *bounds, SPEC.resolution)
    return dense(found, ["outputStream"], *bounds, SPEC.resolution)


_register("profile_dense", _profile_dense, analysis_sql(_events_sql(), _BEFORE, _AFTER).rstrip() + f", {_BOUNDS}, p as ({_cells('out', 'outputStream')}) select 'outputStream' as stream, cast(b as int) as bucket, coalesce(tuples, 0) as tuples, coalesce(keys, 0) as keys from (select unnest(range(0, (hi - lo) // 3600000 + 1)) as b from bounds) left join p on p.bucket = b")

def _both_sql(pipeline: Pipeline) -> str:
    return f"with {_profiles_sql('a', _events_sql())}, {_profiles_sql('b', pipeline_sql(pipeline))}"


_BOTH = _both_sql(THINNED)
_register("profile_diff", lambda spark, d: difference(*_two_profiles(spark, d, THINNED)[:2]), _BOTH + " select coalesce(ap.stream, bp.stream) as stream, coalesce(ap.bucket, bp.bucket) as bucket, coalesce(ap.tuples, 0) - coalesce(bp.tuples, 0) as tuples, coalesce(ap.keys, 0) - coalesce(bp.keys, 0) as keys from ap full join bp on ap.stream = bp.stream and ap.bucket = bp.bucket")


def _performance(filter_only: bool) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        one, other, _ = _two_profiles(spark, d, THINNED)
        out = performance_frame(one, other, filter_only)
        return out.select(*[F.round(c, 6).alias(c) for c in out.columns])

    return query


def _performance_sql(factor: float, pipeline: Pipeline = THINNED) -> str:
    error = lambda c: f"case when coalesce(ap.{c}, 0) = 0 then case when coalesce(bp.{c}, 0) <> 0 then 1.0 else 0.0 end else pow((ap.{c} - coalesce(bp.{c}, 0)) / cast(ap.{c} as double), 2) end"
    return _both_sql(pipeline) + f""", e as (select sqrt(sum({error('tuples')} + {error('keys')})) as distance from ap full join bp on ap.stream = bp.stream and ap.bucket = bp.bucket),
m as (select sqrt(sum(case when tuples <> 0 then {factor} else 0.0 end + case when keys <> 0 then 1.0 else 0.0 end)) as d_max from ap)
select round(distance, 6) as distance, round(d_max, 6) as d_max, round(greatest(0.0, 1.0 - distance / d_max), 6) as similarity from e, m"""


_register("perf_similarity", _performance(False), _performance_sql(4.0))
_register("perf_similarity_filter_only", _performance(True), _performance_sql(1.0))
_register("dmax", lambda spark, d: largest_distance(_two_profiles(spark, d, THINNED)[0], False).select(F.round("d_max", 6).alias("d_max")), _BOTH + " select round(sqrt(sum(case when tuples <> 0 then 4.0 else 0.0 end + case when keys <> 0 then 1.0 else 0.0 end)), 6) as d_max from ap")


def _f1(pipeline: Pipeline, tolerance: float) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        stream = events(spark, d)
        truth, made = analyse(stream, SPEC).output, analyse(run_pipeline(stream, pipeline), SPEC).output
        return f1_counts(truth, made, SPEC.averaged, tolerance).withColumn("f1", F.round("f1", 6))

    return query


def _f1_sql(pipeline: Pipeline, tolerance: float) -> str:
    output = lambda stream: analysis_sql(stream, _BEFORE, _AFTER).strip().removeprefix("with ")
    near = lambda c: f"case when t.{c} is null or p.{c} is null then false when abs(t.{c}) < 1e-9 then abs(p.{c}) <= 1e-9 else abs(t.{c} - p.{c}) / abs(t.{c}) <= {tolerance} end"
    return f"""with t as (with {output(_events_sql())} select * from out), p as (with {output(pipeline_sql(pipeline))} select * from out),
m as (select count(*) as matched from t join p on t.ts = p.ts and t.key = p.key where {near('value')} and {near('k')})
select matched, (select count(*) from t) as n_truth, (select count(*) from p) as n_predicted,
 round(case when matched = 0 then 0.0 else 2.0 * matched / ((select count(*) from t) + (select count(*) from p)) end, 6) as f1 from m"""


_register("f1_tolerant", _f1(THINNED, 0.15), _f1_sql(THINNED, 0.15))
_register("f1_identity", _f1(Pipeline(), 0.15), _f1_sql(Pipeline(), 0.15))

_K = 10


def _people(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as originals and as modified ones: balance and nation, some balances missing, a filter and a factor."""
    rows = spark.read.parquet(f"{d}/supplier.parquet")
    balance = F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal").cast("double"))
    made = from_table(rows, F.col("s_suppkey"), F.lit(0), None, {"balance": balance, "nation": F.col("s_nationkey").cast("double")})
    return made, run_pipeline(made, Pipeline((Filter("nation", Condition.GT, 4.0),))).withColumn("balance", F.col("balance") * 1.1)


_PEOPLE = """o as (select s_suppkey as id, case when s_suppkey % 7 <> 0 then cast(s_acctbal as double) end as b, cast(s_nationkey as double) as n from supplier),
f as (select 1.0 / coalesce(case when stddev_samp(b) > 1e-9 then stddev_samp(b) end, 1.0) as fb, 1.0 / coalesce(case when stddev_samp(n) > 1e-9 then stddev_samp(n) end, 1.0) as fn from o),
os as (select id, b * fb as b, n * fn as n from o, f), ms as (select id, b * 1.1 * fb as b, n * fn as n from o, f where o.n > 4.0),
pairs as (select m.id, sqrt((coalesce(pow(m.b - os.b, 2), 0) + coalesce(pow(m.n - os.n, 2), 0)) / (case when m.b is not null and os.b is not null then 1 else 0 end + case when m.n is not null and os.n is not null then 1 else 0 end)) as dist from ms m, os),
ranked as (select *, row_number() over (partition by id order by dist) as r from pairs),
risk as (select id, stddev_samp(dist) as risk from ranked where r <= 10 group by id)"""


def _dispersion(spark: SparkSession, d: str) -> DataFrame:
    original, modified = _people(spark, d)
    return spread(modified, original, ["balance", "nation"], _K, F.col("seq")).select("id", F.round("risk", 6).alias("risk"))


def _privacy(stat: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        original, modified = _people(spark, d)
        row = summary(spread(modified, original, ["balance", "nation"], _K, F.col("seq")))
        factor = cardinality_factor(original.count(), modified.count())
        return row.select(F.round(F.lit(factor) / (1.0 + F.col(stat)), 6).alias("privacy"))

    return query


_register("knn_dispersion", _dispersion, f"with {_PEOPLE} select id, round(risk, 6) as risk from risk")
for _stat, _expr in {"mean": "avg(risk)", "max": "max(risk)", "q99": "list_sort(list(risk))[cast(floor(0.99 * (count(*) - 1)) as bigint) + 1]"}.items():
    _register(f"privacy_{_stat}", _privacy(_stat), f"with {_PEOPLE} select round((select count(*) from ms) / cast((select count(*) from o) as double) / (1.0 + {_expr}), 6) as privacy from risk")


def _factor(spark: SparkSession, d: str) -> DataFrame:
    original, modified = _people(spark, d)
    return spark.createDataFrame([(round(cardinality_factor(original.count(), modified.count()), 6),)], "factor double")


_register("cardinality_factor", _factor, f"with {_PEOPLE} select round((select count(*) from ms) / cast((select count(*) from o) as double), 6) as factor")


def _text_events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a file of text would have them: blanks, NaN and words among the numbers."""
    rows = spark.read.parquet(f"{d}/events.parquet")
    value = F.when(F.col("event_id") % 5 == 0, " ").when(F.col("event_id") % 7 == 0, "nan").otherwise(F.col("value").cast("string"))
    return rows.select(epoch_millis(F.col("ts")).cast("string").alias("timestamp"), F.col("user_id").cast("string").alias("user"), value.alias("value"), F.col("event_type").alias("kind"))


def _scan(spark: SparkSession, d: str) -> DataFrame:
    found = from_text_rows(_text_events(spark, d), "user")
    return found.events.groupBy("key").agg(F.count("*").alias("n"), F.count("value").alias("n_valid"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first_ts"), F.lit(",".join(found.attributes)).alias("attributes"))


_register("scan_infer_numeric", _scan, "select cast(user_id as varchar) as key, count(*) as n, count(case when event_id % 5 <> 0 and event_id % 7 <> 0 then 1 end) as n_valid, round(sum(case when event_id % 5 <> 0 and event_id % 7 <> 0 then value end), 4) as total, min(epoch_us(ts) // 1000) as first_ts, 'value' as attributes from events group by 1")
_register("column_stats", lambda spark, d: column_stats(_text_events(spark, d), ["value", "kind"]), """
select 'value' as attribute, min(value) as min_value, max(value) as max_value, min(length(replace(split_part(cast(value as varchar), '.', 1), '-', ''))) as min_digits, max(length(replace(split_part(cast(value as varchar), '.', 1), '-', ''))) as max_digits
from events where event_id % 5 <> 0 and event_id % 7 <> 0""")


def _csv(spark: SparkSession, d: str) -> DataFrame:
    """The events by way of headed CSV files with repeated headers and lines without a whole timestamp."""
    rows = _text_events(spark, d)
    whole = F.col("timestamp").cast("bigint")
    broken = F.when(whole % 11 == 0, "timestamp").when(whole % 13 == 0, F.concat(F.lit("x"), F.col("timestamp"))).otherwise(F.col("timestamp"))
    path = f"{scratch_root(spark)}/csv-{uuid.uuid4().hex}"
    rows.withColumn("timestamp", broken).write.option("header", True).csv(path)
    found = read_csv(spark, path, "USER")
    return found.events.groupBy("key").agg(F.count("*").alias("n"), F.count("value").alias("n_valid"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.lit(",".join(found.attributes)).alias("attributes"))


_register("csv_load", _csv, """
with e as (select *, epoch_us(ts) // 1000 as ms, event_id % 5 <> 0 and event_id % 7 <> 0 as valid from events)
select cast(user_id as varchar) as key, count(*) as n, count(case when valid then 1 end) as n_valid, round(sum(case when valid then value end), 4) as total, min(ms) as first_ts, max(ms) as last_ts, 'value' as attributes
from e where ms % 11 <> 0 and ms % 13 <> 0 group by 1""")

_TRIED = Pipeline((Filter("value", Condition.GT, 8.0), Noise("k", 0.05)))


def _quality(spark: SparkSession, d: str) -> DataFrame:
    """The three scores of one pipeline."""
    problem = _problem(spark, d)
    scores = problem.quality(_TRIED)
    return spark.createDataFrame([tuple(round(v, 6) for v in scores.values())], ", ".join(f"{n} double" for n in scores))


def _quality_sql(pipeline: Pipeline) -> str:
    gap = "sqrt((coalesce(pow((m.value - o.value) * fv, 2), 0) + coalesce(pow((m.k - o.k) * fk, 2), 0)) / (case when m.value is not null and o.value is not null then 1 else 0 end + case when m.k is not null and o.k is not null then 1 else 0 end))"
    return f"""with performance as (select similarity from ({_performance_sql(4.0, pipeline)})), results as (select f1 from ({_f1_sql(pipeline, SPEC.tolerance)})),
o as ({_events_sql()}), m as ({pipeline_sql(pipeline)}), f as (select 1.0 / stddev_samp(value) as fv, 1.0 / stddev_samp(k) as fk from o),
near as (select m.seq, m.dup_path, min({gap}, 10) as d from m, o, f group by 1, 2), risk as (select list_aggregate(d, 'stddev_samp') as r from near)
select (select similarity from performance) as performance, round(least((select count(*) from m) / cast((select count(*) from o) as double), (select count(*) from o) / cast((select count(*) from m) as double)) / (1.0 + (select avg(r) from risk)), 6) as privacy, (select f1 from results) as results"""


def _problem(spark: SparkSession, d: str) -> Problem:
    return Problem(events(spark, d), SPEC, k=10)


def _grammar_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rules of the four grammars, as their text is read."""
    sets = {"filters": g.FILTERS, "maps": g.MAPS, "aggregates": g.AGGREGATES, "rir": g.RIR}
    rules = {name: g.parse_grammar(g.generate_grammar(["value", "k"], operators)) for name, operators in sets.items()}
    rows = [(name, s, n, " ".join(o)) for name, grammar in rules.items() for s, options in grammar.items() for n, o in enumerate(options)]
    return spark.createDataFrame(rows, "grammar string, symbol string, n int, body string")


_GRAMMAR_SQL = """
with sets(grammar, operators) as (values ('filters', ['filter']), ('maps', ['filter', 'map_duplicate', 'map_noise']), ('aggregates', ['filter', 'map_duplicate', 'map_noise', 'map_aggregate']), ('rir', ['filter', 'map_rir'])),
bodies(needs, symbol, options) as (values
  ('filter', 'pipeline', ['<operator>', '<operator> <pipeline>']), ('filter', 'filter', ['<attribute> <condition> <value>']), ('map_duplicate', 'map_duplicate', ['<probability>']),
  ('map_noise', 'map_noise', ['<attribute> <percentage>']), ('map_rir', 'map_rir', ['<attribute>']), ('map_aggregate', 'map_aggregate', ['<attribute> <agg_fun> <window_size>']),
  ('filter', 'attribute', ['''value''', '''k''']), ('filter', 'condition', ['lt', 'gt']), ('filter', 'value', ['<dig> . <dig> <dig> E <sign> <dig>']),
  ('filter', 'dig', ['0', '1', '2', '3', '4', '5', '6', '7', '8', '9']), ('filter', 'sign', ['+', '-']), ('map_aggregate', 'agg_fun', ['min', 'avg', 'max']),
  ('map_aggregate', 'window_size', ['3', '4', '5', '6', '7', '8', '9', '10']), ('map_duplicate', 'probability', ['0.1', '0.2', '0.3', '0.4', '0.5', '0.6', '0.7', '0.8', '0.9', '1.0']), ('map_noise', 'percentage', ['0.01', '0.05', '0.10', '0.25'])),
rules as (select grammar, symbol, options from sets, bodies where list_contains(operators, needs) union all select grammar, 'operator', list_transform(operators, lambda o: '<' || o || '>') from sets)
select grammar, '<' || symbol || '>' as symbol, cast(unnest(range(len(options))) as int) as n, unnest(options) as body from rules"""


def _front(spark: SparkSession, d: str) -> DataFrame:
    problem = _problem(spark, d)
    rules = g.parse_grammar(g.generate_grammar(["value", "k"], g.FILTERS))
    people = []
    for people in nsga2(rules, lambda t: tuple(problem.quality_of_tree(t).values()), 6, seed=1, population=3, max_depth=6):
        pass
    return spark.createDataFrame([(str(g.to_pipeline(p.tree)), *p.quality) for p in people], "pipeline string, performance double, privacy double, results double")


_register("quality_three_objectives", _quality, _quality_sql(_TRIED))
_register("grammar_rules", _grammar_rules, _GRAMMAR_SQL)
_register("search_front", _front, None)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
