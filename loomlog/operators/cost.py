"""Cost rollups, attribution to causes, Pareto and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.pricing import RATE_COLUMNS, cost_expr, priced, with_rates
from loomlog.functions.text import BUILT_IN_COMMANDS, bucket_expr, category_expr
from loomlog.operators.joins import spread_left_join
from loomlog.operators.relations import blocks
from loomlog.operators.running import in_order
from loomlog.sources.scratch import stored

PARETO_CUTOFF = 0.80
HUGE_READ_TOKENS, HUGE_READ_SHARE = 100_000, 0.10
MAX_GROUPS, LABEL_GROUPS, LABEL_MIN_SHARE = 8, 4, 0.04
TOP_BUCKETS, TOP_INVOCATIONS = 20, 12
CATEGORIES, AGENTS = ("Read", "Created", "Conversation"), ("Main", "Subagent")
_TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cache_creation_5m", "cache_creation_1h"]


def in_window(df: DataFrame, window: tuple | None, column: str = "timestamp") -> DataFrame:
    """Rows of a half-open time window; None keeps all."""
    if window is None:
        return df
    start, end = (F.lit(x).cast("timestamp") for x in window)
    return df.filter((F.col(column) >= start) & (F.col(column) < end))


def session_cost(costs: DataFrame, rates: DataFrame, window: tuple | None = None) -> DataFrame:
    return priced(in_window(costs, window), rates).groupBy("session_id").agg(F.sum("cost_usd").alias("cost_usd"))


def token_usage(costs: DataFrame, rates: DataFrame, session_id: str | None = None, fallback: str = "row") -> DataFrame:
    """Token sums and cost by model. fallback="group" bills old cache writes after summing, as only whole models without split writes then have any."""
    rows = costs if session_id is None else costs.filter(F.col("session_id") == session_id)
    sums = [F.sum(c).alias(c) for c in _TOKENS]
    if fallback == "group":
        return with_rates(rows.groupBy("model").agg(F.count("*").alias("messages"), *sums), rates).withColumn("cost_usd", cost_expr()).drop(*[f"r_{c}" for c in RATE_COLUMNS])
    return priced(rows, rates).groupBy("model").agg(F.count("*").alias("messages"), *sums, F.sum("cost_usd").alias("cost_usd"))


def token_totals(usage: DataFrame) -> DataFrame:
    """One row over all models."""
    return usage.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("messages", *_TOKENS)], F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))


def cost_by_model(costs: DataFrame, rates: DataFrame) -> DataFrame:
    """Messages, tokens and cost by model, dearest first; missing and empty models are "(unknown)"."""
    model = F.when(F.coalesce("model", F.lit("")) == "", "(unknown)").otherwise(F.col("model"))
    return priced(costs, rates).groupBy(model.alias("model")).agg(F.count("*").alias("messages"), *[F.sum(c).alias(c) for c in _TOKENS], F.sum("cost_usd").alias("cost_usd")).orderBy(F.col("cost_usd").desc(), "model")


def cost_breakdown(costs: DataFrame, sessions: DataFrame, rates: DataFrame, bucket: str = "day", by: str = "model", window: tuple | None = None) -> DataFrame:
    """(bucket, grp, cost_usd) of positive cost by day, or by hour of day, and by model, project or in total."""
    when = F.date_format("timestamp", "yyyy-MM-dd") if bucket == "day" else F.date_format("timestamp", "HH:00")
    group = {"model": F.coalesce("model", F.lit("unknown")), "project": F.coalesce("project", F.lit("unknown")), "total": F.lit("Total")}[by]
    cells = priced(in_window(costs, window), rates).select("session_id", when.alias("bucket"), "model", "cost_usd")
    cells = cells.groupBy("session_id", "bucket", "model").agg(F.sum("cost_usd").alias("cost_usd")).join(sessions.select("session_id", "project"), "session_id", "left")
    positive = cells.groupBy("bucket", F.coalesce("model", F.lit("unknown")).alias("model"), F.coalesce("project", F.lit("unknown")).alias("project")).agg(F.sum("cost_usd").alias("cost_usd")).filter("cost_usd > 0")
    return positive.groupBy("bucket", group.alias("grp")).agg(F.sum("cost_usd").alias("cost_usd"))


def _largest(totals: DataFrame, count: int) -> DataFrame:
    """(grp, rank) of the `count` largest groups, however many there are."""
    order = [F.col("total").desc(), F.col("grp")]
    return totals.orderBy(*order).limit(count).select("grp", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def keep_set(df: DataFrame, cap: int = MAX_GROUPS) -> DataFrame:
    """The groups that keep their name: all of up to `cap`, else the cap - 1 largest."""
    first = _largest(df.groupBy("grp").agg(F.sum("cost_usd").alias("total")), cap + 1)
    return first.withColumn("_groups", F.count("*").over(Window.partitionBy())).filter((F.col("_groups") <= cap) | (F.col("rank") < cap)).select("grp")


def fold_with_keepset(df: DataFrame, keep: DataFrame) -> DataFrame:
    """Groups outside the keep set become "Other"."""
    named = df.join(F.broadcast(keep.select("grp").distinct().withColumn("_kept", F.lit(True))), "grp", "left")
    return named.groupBy("bucket", F.when(F.col("_kept"), F.col("grp")).otherwise("Other").alias("grp")).agg(F.sum("cost_usd").alias("cost_usd"))


def fold_top_groups(df: DataFrame, cap: int = MAX_GROUPS) -> DataFrame:
    return fold_with_keepset(df, keep_set(df, cap))


def group_peaks(df: DataFrame, top: int = LABEL_GROUPS, min_share: float = LABEL_MIN_SHARE) -> DataFrame:
    """(grp, bucket, value, center) of the peak bucket of each of the largest groups, if it is a fair share of all cost.

    center is the middle of the group's part when larger groups are stacked below it; of equal
    peaks the first bucket counts.
    """
    totals = stored(df.groupBy("grp").agg(F.sum("cost_usd").alias("total")))
    ranks = _largest(totals, top).crossJoin(F.broadcast(totals.agg(F.sum("total").alias("grand"))))
    cells = df.join(F.broadcast(ranks), "grp")
    stacked = cells.withColumn("below", F.coalesce(F.sum("cost_usd").over(Window.partitionBy("bucket").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    first = Window.partitionBy("grp").orderBy(F.col("cost_usd").desc(), "bucket")
    peak = stacked.withColumn("_n", F.row_number().over(first)).filter("_n = 1 and grand > 0")
    return peak.filter(F.col("cost_usd") >= min_share * F.col("grand")).select("grp", "bucket", F.col("cost_usd").alias("value"), (F.col("below") + F.col("cost_usd") / 2).alias("center"))


def cost_attribution(costs: DataFrame, msgs: DataFrame, calls: DataFrame, window: tuple | None = None) -> DataFrame:
    """Each priced message with the block of its parent user message that caused it, and that call's name and input.

    A tool result at any place beats other blocks; of equals the lowest index counts.
    """
    own = in_window(costs, window)
    parents = blocks(msgs.filter("type = 'user'")).select(F.col("uuid").alias("parent_uuid"), "block_idx", F.try_variant_get("block", "$.type", "string").alias("block_type"), F.try_variant_get("block", "$.tool_use_id", "string").alias("tool_use_id"))
    rank = F.struct(F.when(F.col("block_type") == "tool_result", 0).otherwise(1), F.col("block_idx"))
    # One block for each parent first: the same choice as for each message, on fewer rows.
    chosen = parents.groupBy("parent_uuid").agg(F.min_by(F.struct("block_type", "tool_use_id"), rank).alias("b")).select("parent_uuid", F.col("b.block_type").alias("user_block_type"), F.col("b.tool_use_id").alias("tool_use_id"))
    # Calls are met by parent, before the messages: fewer rows, and most messages share parents with none.
    caused = spread_left_join(chosen, calls.select("tool_use_id", "tool_name", "tool_input"), "tool_use_id", ["parent_uuid"]).drop("tool_use_id")
    joined = spread_left_join(own, caused, "parent_uuid", ["uuid"], counted=own)
    return joined.select("session_id", "uuid", "timestamp", "is_sidechain", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cache_creation_5m", "cache_creation_1h", "user_block_type", "tool_name", "tool_input")


def attributed(attribution: DataFrame, rates: DataFrame) -> DataFrame:
    """Attribution with bucket, category, agent, cost_usd and write_cost_usd."""
    tool, raw, block = F.col("tool_name"), F.col("tool_input"), F.col("user_block_type")
    agent = F.when(F.coalesce("is_sidechain", F.lit(False)), "Subagent").otherwise("Main")
    return priced(attribution, rates).withColumns({"bucket": bucket_expr(tool, raw, block), "category": category_expr(tool, block), "agent": agent})


def bloat_buckets(attribution: DataFrame, rates: DataFrame, top: int | None = TOP_BUCKETS) -> DataFrame:
    """Cache writes by cause and agent with the message that cost most, dearest first, and each cause's share of the tokens."""
    grown = attributed(attribution, rates).filter("cache_creation_tokens > 0")
    first = F.struct("write_cost_usd", -F.unix_micros("timestamp"))
    out = grown.groupBy("bucket", "category", "agent").agg(F.sum("cache_creation_tokens").alias("tokens"), F.sum("write_cost_usd").alias("cost_usd"), F.max_by("uuid", first).alias("top_uuid"), F.max("write_cost_usd").alias("top_cost_usd"))
    out = stored(out)  # a row for each cause, read for the total and for the shares
    total = out.agg(F.sum("tokens").alias("_all"))
    out = out.crossJoin(F.broadcast(total)).withColumn("pct", 100.0 * F.col("tokens") / F.col("_all")).drop("_all")
    return out if top is None else out.orderBy(F.col("cost_usd").desc(), "bucket", "agent").limit(top)


def bloat_rollup(attribution: DataFrame, rates: DataFrame) -> DataFrame:
    """Tokens and cost of cache writes by category and agent with margins ("Total"); all cells exist."""
    spark = attribution.sparkSession
    cells = spark.createDataFrame([(c, a) for c in CATEGORIES for a in AGENTS], "category string, agent string")
    grown = attributed(attribution, rates).filter("cache_creation_tokens > 0").groupBy("category", "agent").agg(F.sum("cache_creation_tokens").alias("tokens"), F.sum("write_cost_usd").alias("cost_usd"))
    full = cells.join(grown, ["category", "agent"], "left").fillna(0, ["tokens", "cost_usd"])
    return full.cube("category", "agent").agg(F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd")).fillna("Total", ["category", "agent"])


def message_index(attribution: DataFrame) -> DataFrame:
    """Attribution with idx, the place of a message in its session from 0."""
    return in_order(attribution, ["session_id"], ["timestamp", "uuid"], number="idx")


def between_messages(attribution: DataFrame, first: str, last: str) -> DataFrame:
    """Messages of a session between two of them, both included, in either order."""
    indexed = message_index(attribution)
    ends = {r["uuid"]: (r["session_id"], r["idx"]) for r in indexed.filter(F.col("uuid").isin(first, last)).select("uuid", "session_id", "idx").limit(3).collect()}
    if first not in ends or last not in ends or ends[first][0] != ends[last][0]:
        raise ValueError("both messages must be priced messages of one session")
    low, high = sorted((ends[first][1], ends[last][1]))
    return indexed.filter((F.col("session_id") == ends[first][0]) & F.col("idx").between(low, high)).drop("idx")


def binary_split(session_costs: DataFrame, flags: DataFrame) -> DataFrame:
    """Sessions, cost, mean and share of cost with and without a flag; both rows exist."""
    spark = session_costs.sparkSession
    sides = spark.createDataFrame([(True,), (False,)], "flag boolean")
    own = flags.groupBy("session_id").agg(F.max("flag").alias("_f"))
    rows = session_costs.join(own, "session_id", "left").select(F.coalesce("_f", F.lit(False)).alias("flag"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"))
    grouped = sides.join(rows.groupBy("flag").agg(F.count("*").alias("sessions"), F.sum("cost_usd").alias("cost_usd")), "flag", "left").fillna(0, ["sessions", "cost_usd"])
    return _shares(grouped, Window.partitionBy()).select(*_SHARES)


_SHARES = ["flag", "sessions", "cost_usd", "mean_usd", "pct_cost"]


def _shares(sides: DataFrame, whole) -> DataFrame:
    """Both sides of splits with mean and share of cost; a split is two rows."""
    all_ = F.sum("cost_usd").over(whole)
    mean = F.when(F.col("sessions") > 0, F.col("cost_usd") / F.col("sessions")).otherwise(0.0)
    return sides.withColumns({"mean_usd": mean, "pct_cost": F.when(all_ > 0, 100.0 * F.col("cost_usd") / all_).otherwise(0.0)})


def flag_subagent(costs: DataFrame, calls: DataFrame) -> DataFrame:
    """Sessions with sidechain usage or a call of a sub-agent."""
    side = costs.filter("is_sidechain").select("session_id")
    return side.unionByName(calls.filter(F.col("tool_name").isin("Task", "Agent")).select("session_id")).distinct().withColumn("flag", F.lit(True))


def flag_huge_reads(attribution: DataFrame, session_costs: DataFrame, rates: DataFrame, min_tokens: int = HUGE_READ_TOKENS, min_share: float = HUGE_READ_SHARE) -> DataFrame:
    """Sessions whose cache writes for reads are many tokens and a fair share of the session's cost."""
    return _read_writes(attribution, rates).join(session_costs, "session_id", "left").select("session_id", _is_huge(min_tokens, min_share).alias("flag"))


def _read_writes(attribution: DataFrame, rates: DataFrame) -> DataFrame:
    read = attributed(attribution, rates).filter("category = 'Read' and cache_creation_tokens <> 0")
    return read.groupBy("session_id").agg(F.sum("cache_creation_tokens").alias("tokens"), F.sum("write_cost_usd").alias("read_usd"))


def _is_huge(min_tokens: int, min_share: float):
    share = F.when(F.col("cost_usd") > 0, F.col("read_usd") / F.col("cost_usd")).otherwise(0.0)
    return (F.col("tokens") >= min_tokens) & (share >= min_share)


def flag_skill(commands: DataFrame) -> DataFrame:
    """Sessions that used a command of their own."""
    return commands.filter(~F.col("command").isin(BUILT_IN_COMMANDS)).select("session_id").distinct().withColumn("flag", F.lit(True))


def pareto(session_costs: DataFrame, cutoff: float = PARETO_CUTOFF, partitions: int | None = None) -> DataFrame:
    """Sessions of positive cost, dearest first, with running sums; in_pareto up to and with the row that reaches the cutoff.

    A prefix sum in two phases: range partitions by (cost descending, id) are summed, then each
    adds what stands before it, so no window spans all rows. The partitions are written once, so
    that both phases read the same rows.
    """
    spark = session_costs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = session_costs.filter("cost_usd > 0").select("session_id", "cost_usd").repartitionByRange(n, F.col("cost_usd").desc(), "session_id").withColumn("_part", F.spark_partition_id())
    laid = stored(laid)
    sums = laid.groupBy("_part").agg(F.sum("cost_usd").alias("_sum"))
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(order), F.lit(0.0)).alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias("grand_total"))
    within = Window.partitionBy("_part").orderBy(F.col("cost_usd").desc(), "session_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = laid.withColumn("_run", F.sum("cost_usd").over(within)).join(F.broadcast(before), "_part").withColumn("cumulative", F.col("_before") + F.col("_run"))
    frac, last = F.col("cumulative") / F.col("grand_total"), (F.col("cumulative") - F.col("cost_usd")) / F.col("grand_total")
    inside = last < cutoff - 1e-12
    return rows.select("session_id", "cost_usd", "cumulative", "grand_total", frac.alias("cum_frac"), inside.alias("in_pareto"), (inside & (frac >= cutoff - 1e-12)).alias("is_cutoff"))


def cost_portfolio(costs: DataFrame, msgs: DataFrame, calls: DataFrame, commands: DataFrame, rates: DataFrame, window: tuple | None = None) -> DataFrame:
    """The three splits of one window: cost and huge reads are those of the window, sub-agents and skills of all time."""
    spark, scoped = costs.sparkSession, session_cost(costs, rates, window)
    read = _read_writes(cost_attribution(costs, msgs, calls, window), rates)
    side, skill = (f.select("session_id", F.lit(True).alias(name)) for f, name in ((flag_subagent(costs, calls), "_side"), (flag_skill(commands), "_skill")))
    rows = scoped.join(read, "session_id", "left").join(side, "session_id", "left").join(skill, "session_id", "left")
    flags = {"subagent": F.col("_side"), "huge_reads": _is_huge(HUGE_READ_TOKENS, HUGE_READ_SHARE), "skill": F.col("_skill")}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("split"), F.coalesce(f, F.lit(False)).alias("flag")) for n, f in flags.items()])).alias("x")
    sums = rows.select("cost_usd", each).groupBy("x.split", "x.flag").agg(F.count("*").alias("sessions"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"))
    sides = spark.createDataFrame([(n, f) for n in flags for f in (True, False)], "split string, flag boolean")
    return _shares(sides.join(sums, ["split", "flag"], "left").fillna(0, ["sessions", "cost_usd"]), Window.partitionBy("split")).select("split", *_SHARES)


def invocations(calls: DataFrame) -> DataFrame:
    """Calls of sub-agents with a type, numbered in each session by time: the invocations."""
    kind = F.get_json_object("tool_input", "$.subagent_type")
    typed = calls.filter(F.col("tool_name").isin("Task", "Agent")).select("session_id", "called_at", "tool_use_id", kind.alias("subagent_type")).filter("subagent_type is not null")
    return typed.withColumn("inv", F.row_number().over(Window.partitionBy("session_id").orderBy("called_at", "tool_use_id")) - 1)


def with_invocation(attribution: DataFrame, calls: DataFrame) -> DataFrame:
    """Attribution with inv: for sidechain messages the latest invocation of the session at or before their time.

    An as-of join as one scan over calls and messages together, calls first at equal times.
    """
    side = F.coalesce(F.col("is_sidechain"), F.lit(False))
    return _as_of(attribution, invocations(calls)).withColumn("inv", F.when(side, F.col("inv")))


def _as_of(rows: DataFrame, inv: DataFrame) -> DataFrame:
    """rows with inv and subagent_type of the last invocation of their session at or before their time."""
    kinds = {f.name: f.dataType for f in rows.schema}
    left = inv.select("session_id", F.col("called_at").alias("_at"), F.lit(0).alias("_side"), F.struct("inv", "subagent_type").alias("_inv"), *[F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c != "session_id"])
    right = rows.select("session_id", F.col("timestamp").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(left.schema["_inv"].dataType).alias("_inv"), *[c for c in kinds if c != "session_id"])
    seen = in_order(left.unionByName(right), ["session_id"], ["_at", "_side", "_inv"], lasts={"_inv": "_inv"}).filter("_side = 1")
    return seen.select(*kinds, "_inv.inv", "_inv.subagent_type")


def invocation_costs(attribution: DataFrame, calls: DataFrame, rates: DataFrame, top: int = TOP_INVOCATIONS) -> DataFrame:
    """Cost of each session's invocations, ranked; the dearest by name, the rest as one row "Other"."""
    # Only sidechain messages, and of them only what is summed, go through the as-of scan.
    side = priced(attribution.filter("is_sidechain"), rates).select("session_id", "timestamp", "uuid", "cost_usd")
    rows = _as_of(side, invocations(calls)).filter("inv is not null")
    per = rows.groupBy("session_id", "inv", "subagent_type").agg(F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("messages"), F.min_by("uuid", F.struct("timestamp", "uuid")).alias("first_uuid"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("cost_usd").desc(), "inv"))
    ranked = per.withColumn("rank", rank)
    named = F.col("rank") <= top
    label = F.when(named, F.concat(F.lit("#"), F.col("rank").cast("string"), F.lit(" "), F.when(F.col("subagent_type") == "", "(unknown)").otherwise(F.col("subagent_type")))).otherwise("Other")
    return ranked.groupBy("session_id", F.least("rank", F.lit(top + 1)).alias("rank"), label.alias("label")).agg(F.sum("cost_usd").alias("cost_usd"), F.sum("messages").alias("messages"), F.count("*").alias("invocations"), F.min(F.when(named, F.col("first_uuid"))).alias("first_uuid"))
