import random
import statistics

import pytest
from pyspark.sql import functions as F

from loomlog.functions.pricing import MAX_INLINE_RATES, RATE_COLUMNS, cost_expr, longest_prefixes, rates, unpriced_models, with_rates
from loomlog.operators import cost, series
from loomlog.plans.relations import Relations
from loomlog.sources.logs import read_log
from tests import logs
from tests.logs import assistant, result, text, tool, user

MILLION = {"input_tokens": 10**6, "output_tokens": 10**6}


@pytest.fixture
def rel(spark, tmp_path):
    return lambda records: Relations(read_log(spark, logs.write(tmp_path / "p", records)))


def test_repeated_message_ids_count_once(rel):
    r = rel([user("u1", "x"), assistant("a1", [text("a")], mid="m1", usage=MILLION), assistant("a2", [text("b")], ts="2026-01-01T10:00:02Z", mid="m1", usage=MILLION)])
    assert cost.session_cost(r.assistant_message_costs, r.rates).first().cost_usd == pytest.approx(30.0)
    assert r.assistant_message_costs.first().uuid == "a1"


@pytest.mark.parametrize("model,rate", [("claude-opus-4-99", 15.0), ("claude-opus-4-7-x", 5.0), ("claude-haiku-3-5", 0.8), ("", 0.0), (None, 0.0), ("<synthetic>", 0.0), ("other", 0.0)])
def test_longest_prefix_wins(spark, model, rate):
    df = spark.createDataFrame([(model,)], "model string")
    assert with_rates(df, rates(spark)).first().r_input == rate


def test_one_million_of_each(spark):
    df = spark.createDataFrame([("claude-opus-4-7", *[10**6] * 4, 10**6, 10**6)], "model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, cache_creation_5m long, cache_creation_1h long")
    assert with_rates(df, rates(spark)).select(cost_expr()).first()[0] == pytest.approx(46.75)


def test_old_cache_writes_are_billed_at_the_short_rate(rel):
    r = rel([assistant("a1", [], usage={"cache_creation_input_tokens": 10**6}), assistant("a2", [], usage={"cache_creation_input_tokens": 10**6, "cache_creation": {"ephemeral_1h_input_tokens": 10**6}})])
    rows = cost.token_usage(r.assistant_message_costs, r.rates).first()
    assert rows.cost_usd == pytest.approx(6.25 + 10)
    assert cost.token_usage(r.assistant_message_costs, r.rates, fallback="group").first().cost_usd == pytest.approx(10)


def test_unpriced_models(rel):
    r = rel([assistant("a1", [], model="other", usage=MILLION), assistant("a2", [], model="<synthetic>"), assistant("a3", [])])
    assert [(x.model, x.messages, x.tokens) for x in unpriced_models(r.assistant_message_costs, r.rates).collect()] == [("other", 1, 2 * 10**6)]


def test_long_rate_tables_meet_models_by_equality(spark):
    """100,000 prefixes, many nested, some twice; the same rates as the expression over the few that matter gives."""
    odd = [("m", 1.0), ("m1", 2.0), ("m1", 3.0), ("m12", 4.0), ("é", 5.0), ("", 9.0)]
    few = rates(spark, [(p, *[r] * 5) for p, r in odd])
    many = few.union(spark.range(100_000).select(F.concat(F.lit("x"), F.col("id").cast("string")), *[(F.col("id") + 10).cast("double") for _ in RATE_COLUMNS]))
    names = [None, "", "m", "m1", "m123", "m2", "M1", "él", "é", "zz", "x", "m1" + "9" * 100_000]
    models = spark.createDataFrame([(m,) for m in names], "model string")
    long, short = with_rates(models, many), with_rates(models, few)
    assert {r.model: r.r_input for r in long.collect()} == {r.model: r.r_input for r in short.collect()} and long.count() == len(names)
    assert {r.r_input for r in long.filter("model like 'm1%'").collect()} == {2.0, 4.0}
    more = spark.createDataFrame([("x999999",), ("x12",), ("x1a",)], "model string")
    assert {r.model: r.r_input for r in with_rates(more, many).collect()} == {"x999999": 100009.0, "x12": 22.0, "x1a": 11.0}
    assert many.count() > MAX_INLINE_RATES
    for plan in (long, longest_prefixes(models, many)):
        text_of = plan._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text_of and "NestedLoop" not in text_of
    assert longest_prefixes(models, few.limit(0)).count() == 0


def costs_of(spark, values):
    return spark.createDataFrame([(f"s{i:02d}", float(v)) for i, v in enumerate(values)], "session_id string, cost_usd double")


def test_pareto(spark):
    rows = cost.pareto(costs_of(spark, [100, 50, 30, 20, 10, 5, 5, 3, 2, 1, 0])).orderBy(F.col("cost_usd").desc(), "session_id").collect()
    assert len(rows) == 10 and rows[0].grand_total == 226
    assert [r.in_pareto for r in rows] == [True] * 4 + [False] * 6 and [r.is_cutoff for r in rows].index(True) == 3
    assert cost.pareto(costs_of(spark, [0])).count() == 0


def growth():
    return [
        assistant("a1", [tool("t1", "Read", file_path="/tmp/test/big.py")], usage={"input_tokens": 10}),
        user("u1", [text("also"), result("t1")], ts="2026-01-01T10:00:02Z", parent="a1"),
        assistant("a2", [text("ok")], ts="2026-01-01T10:00:03Z", parent="u1", usage={"cache_creation_input_tokens": 200_000}),
        user("u2", "plain", ts="2026-01-01T10:00:04Z"),
        assistant("a3", [text("ok")], ts="2026-01-01T10:00:05Z", parent="u2", usage={"cache_creation_input_tokens": 1000}),
    ]


def test_attribution_and_growth(rel):
    r = rel(growth())
    rows = {x.uuid: x for x in r.cost_attribution.collect()}
    assert rows["a2"].user_block_type == "tool_result" and rows["a2"].tool_name == "Read" and rows["a3"].user_block_type is None
    top = cost.bloat_buckets(r.cost_attribution, r.rates).collect()
    assert [(b.bucket, b.category, b.agent, b.tokens, b.top_uuid) for b in top] == [("file read: big.py", "Read", "Main", 200_000, "a2"), ("human input", "Conversation", "Main", 1000, "a3")]
    cells = {(c.category, c.agent): c.tokens for c in cost.bloat_rollup(r.cost_attribution, r.rates).collect()}
    assert len(cells) == 12 and cells["Created", "Subagent"] == 0 and cells["Total", "Total"] == 201_000
    assert {x.uuid for x in cost.between_messages(r.cost_attribution, "a3", "a2").collect()} == {"a2", "a3"}
    with pytest.raises(ValueError):
        cost.between_messages(r.cost_attribution, "a3", "nope")


def test_splits(rel):
    rows = growth() + [assistant("b1", [tool("k1", "Task", subagent_type="x")], session="s2", usage=MILLION), user("c1", "<command-name>/mine</command-name>", session="s3"), assistant("c2", [], session="s3", usage=MILLION), user("d1", "<command-name>/clear</command-name>", session="s4"), assistant("d2", [], session="s4", usage={"input_tokens": 10**6})]
    r = rel(rows)
    spent = cost.session_cost(r.assistant_message_costs, r.rates)
    side = lambda flags: {x.flag: (x.sessions, round(x.cost_usd, 2)) for x in cost.binary_split(spent, flags).collect()}
    assert side(cost.flag_subagent(r.assistant_message_costs, r.tool_calls))[True] == (1, 30.0)
    assert side(cost.flag_skill(r.message_commands))[True] == (1, 30.0) and side(cost.flag_skill(r.message_commands))[False][0] == 3
    assert side(cost.flag_huge_reads(r.cost_attribution, spent, r.rates))[True][0] == 1
    day = cost.session_cost(r.assistant_message_costs, r.rates, ("2026-01-01 10:00:04", "2026-01-02 00:00:00"))
    assert [x.session_id for x in day.collect()] == ["s1"]
    whole = cost.cost_portfolio(r.assistant_message_costs, r.raw_messages, r.tool_calls, r.message_commands, r.rates)
    assert whole.count() == 6


def test_fold_and_peaks(spark):
    rows = [(f"d{d}", f"g{g:02d}", float(100 - g + d)) for g in range(11) for d in range(2)]
    df = spark.createDataFrame(rows, "bucket string, grp string, cost_usd double")
    folded = cost.fold_top_groups(df)
    assert folded.select("grp").distinct().count() == 8 and folded.filter("grp = 'Other' and bucket = 'd0'").first().cost_usd == sum(100 - g for g in range(7, 11))
    assert cost.fold_with_keepset(df, cost.keep_set(df)).count() == folded.count()
    peaks = cost.group_peaks(df).orderBy("grp").collect()
    assert [(p.grp, p.bucket) for p in peaks] == [("g00", "d1"), ("g01", "d1"), ("g02", "d1"), ("g03", "d1")]
    assert peaks[1].center == pytest.approx(101 + 50)


def test_invocations(rel):
    rows = [assistant("a1", [tool("k1", "Task", subagent_type="x")], ts="2026-01-01T10:00:00Z")]
    rows += [assistant(f"b{i}", [], ts=f"2026-01-01T10:00:0{i}Z", side=True, usage=MILLION) for i in range(3)]
    rows += [assistant("a2", [tool("k2", "Agent", subagent_type=""), tool("k3", "Task", description="untyped")], ts="2026-01-01T10:00:05Z"), assistant("b9", [], ts="2026-01-01T10:00:09Z", side=True, usage=MILLION), assistant("a9", [], ts="2026-01-01T10:00:09Z", usage=MILLION)]
    r = rel(rows)
    got = cost.invocation_costs(r.cost_attribution, r.tool_calls, r.rates).orderBy("rank").collect()
    assert [(g.label, g.messages, g.first_uuid) for g in got] == [("#1 x", 3, "b0"), ("#2 (unknown)", 1, "b9")]
    assert cost.invocation_costs(r.cost_attribution, r.tool_calls, r.rates, top=1).orderBy("rank").collect()[1].label == "Other"


def points(spark, increments):
    cum, rows = 0.0, []
    for i, inc in enumerate(increments):
        cum += inc
        rows.append(("s", i, f"u{i}", inc, cum))
    return spark.createDataFrame(rows, "session_id string, idx int, uuid string, inc_usd double, cum_usd double")


def test_spikes_and_slopes(spark):
    ramp = points(spark, [0.0005] * 10 + [0.004] * 10)
    assert series.spikes(ramp).count() == 0 and series.slopes(ramp, series.spikes(ramp)).count() >= 1
    flat = points(spark, [0.001] * 15)
    assert series.slopes(flat, series.spikes(flat)).count() == 0
    jump = points(spark, [0.0] * 14 + [0.5])
    assert [s.idx for s in series.spikes(jump).collect()] == [14] and series.slopes(jump, series.spikes(jump)).count() == 0
    assert series.spikes(points(spark, [1.0] * 5)).count() == 0
    hill = points(spark, [0.001] * 12 + [0.03] * 3 + [0.001] * 12 + [0.019] * 8)
    kept = {s.idx for s in series.spikes(hill).collect()}
    assert kept == {12, 13, 14} and all(min(abs(s.idx - k) for k in kept) > 5 for s in series.slopes(hill, series.spikes(hill)).collect())


def test_medians_equal_sorting_and_lags_equal_looking_up(spark):
    draw = random.Random(5)
    values = {f"n{n}": [draw.choice([0.0, 0.25, draw.random(), 1e-9, 1e9]) for _ in range(n)] for n in [*range(6, 24), 100, 999, 1000, 5001]}
    values |= {"big": [draw.lognormvariate(0, 4) for _ in range(40_000)], "equal": [0.5] * 3000, "two": [0.0] * 2000 + [1.0] * 2000, "few": [1.0] * 5, "nulls": [None, None, *[3.0, 1.0] * 4]}
    rows = [(k, i, v, draw.random()) for k, vs in values.items() for i, v in enumerate(vs)]
    s = spark.createDataFrame(rows, "session_id string, idx int, inc_usd double, cum_usd double").repartition(7)
    got = {r.session_id: (r._n, r._m) for r in series._medians(s).collect()}
    assert got == {k: (len(v), statistics.median(x for x in v if x is not None)) for k, v in values.items() if len(v) >= 6}
    at = {r[:2]: r[3] for r in rows}
    for cell in (5, 7, 4096):
        assert all(r._then == at.get((r.session_id, r.idx - 5)) for r in series.series_lag(s, "cum_usd", 5, cell).collect())
    assert series.series_lag(s, "cum_usd", 5, 7).count() == len(rows) and series._medians(s.limit(0)).count() == 0


def test_downsample_and_markers(spark):
    s = points(spark, [0.01] * 249 + [5.0])
    d = series.downsample(s)
    assert d.count() == 84 and d.agg(F.max("size")).first()[0] == 3 and d.agg(F.max("cum_usd")).first()[0] == pytest.approx(7.49)
    assert series.downsample(points(spark, [1.0] * 200)).count() == 200
    assert [(m.idx, m.point) for m in series.place_markers(series.spikes(s), d).collect()] == [(249, 83)]
