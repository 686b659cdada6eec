"""Cost series of sessions: running sums, down-sampling, spikes and slopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.pricing import priced
from loomlog.operators.cost import attributed, with_invocation
from loomlog.operators.running import in_order

RAW_LIMIT, MAX_BUCKETS = 200, 120
SPIKE_MIN_N, SPIKE_TOP, SPIKE_FLOOR, SPIKE_FACTOR = 6, 6, 0.02, 1.5
SLOPE_MIN_N, SLOPE_TOP, SLOPE_WINDOW, SLOPE_SIGMAS, SLOPE_RADIUS, SLOPE_MIN_RISES = 10, 8, 5, 1.5, 5, 2
#: How far the bracket of a median reaches to both sides, as a part of the messages; messages in a cell of a lag.
MEDIAN_SLACK, LAG_CELL = 0.001, 4096


def cost_series(attribution: DataFrame, rates: DataFrame) -> DataFrame:
    """(session_id, idx, uuid, timestamp, agent, category, inc_usd, cum_usd) of each message in order."""
    rows = attributed(attribution, rates).select("session_id", "uuid", "timestamp", "agent", "category", F.col("cost_usd").alias("inc_usd"))
    out = in_order(rows, ["session_id"], ["timestamp", "uuid"], number="idx", sums={"cum_usd": "inc_usd"})
    return out.select("session_id", F.col("idx").cast("int").alias("idx"), *rows.columns[1:], "cum_usd")


def cumulative_cost(attribution: DataFrame, rates: DataFrame, by: str = "agent", calls: DataFrame | None = None) -> DataFrame:
    """(session_id, idx, uuid, series, inc_usd, cum_usd): each series' running cost at each of its messages.

    by is "agent", "category" or "invocation" (sidechain messages only; needs calls).
    """
    if by == "invocation":
        rows = priced(with_invocation(attribution, calls), rates).withColumn("series", F.col("inv").cast("string"))
    else:
        rows = attributed(attribution, rates).withColumn("series", F.col(by))
    order = ["timestamp", "uuid"]
    placed = in_order(rows.select("session_id", *order, "series", F.col("cost_usd").alias("inc_usd")), ["session_id"], order, number="idx").filter("series is not null")
    running = in_order(placed, ["session_id", "series"], order, sums={"cum_usd": "inc_usd"})
    return running.select("session_id", F.col("idx").cast("int").alias("idx"), "uuid", "series", "inc_usd", "cum_usd")


def downsample(series: DataFrame, raw_limit: int = RAW_LIMIT, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """(session_id, point, size, messages, first_uuid, last_uuid, inc_usd, cum_usd): long sessions in at most max_buckets points."""
    n = series.groupBy("session_id").agg(F.count("*").alias("_n"))
    size = F.when(F.col("_n") > raw_limit, F.ceil(F.col("_n") / max_buckets)).otherwise(1)
    cells = series.join(n, "session_id").withColumn("size", size.cast("int")).withColumn("point", F.floor(F.col("idx") / F.col("size")).cast("int"))
    points = cells.groupBy("session_id", "point", "size").agg(F.count("*").alias("messages"), F.min_by("uuid", "idx").alias("first_uuid"), F.max_by("uuid", "idx").alias("last_uuid"), F.sum("inc_usd").alias("inc_usd"))
    order = Window.partitionBy("session_id").orderBy("point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return points.withColumn("cum_usd", F.sum("inc_usd").over(order))


def _medians(series: DataFrame) -> DataFrame:
    """(session_id, _n, _m): messages and median cost of each session with enough of them, exact.

    A quantile sketch brackets the middle, at a slack ten times its error; the values between are
    counted one by one, those below as a whole. So no task sorts a session: what is ordered are the
    distinct values in two thousandths of its messages. A sketch beyond its error would be an error.
    """
    within = F.percentile_approx("inc_usd", F.array(*[F.lit(0.5 + d) for d in (-MEDIAN_SLACK, MEDIAN_SLACK)]), int(10 / MEDIAN_SLACK))
    sessions = series.groupBy("session_id").agg(F.count("*").alias("_n"), F.count("inc_usd").alias("_k"), within.alias("_b")).filter(F.col("_n") >= SPIKE_MIN_N)
    low, high = F.col("_b")[0], F.col("_b")[1]
    up_to = series.select("session_id", "inc_usd").join(sessions, "session_id").filter(F.col("inc_usd") <= high)
    counts = up_to.groupBy("session_id", "_n", "_k", F.when(F.col("inc_usd") >= low, F.col("inc_usd")).alias("_v")).agg(F.count("*").alias("_c"))
    order = Window.partitionBy("session_id").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first, last = F.floor((F.col("_k") - 1) / 2), F.ceil((F.col("_k") - 1) / 2)
    placed = counts.withColumn("_to", F.sum("_c").over(order)).withColumn("_from", F.col("_to") - F.col("_c")).filter("_v is not null")
    middle = F.avg(F.when((F.col("_to") > first) & (F.col("_from") <= last), F.col("_v")))
    held = (F.min(F.col("_from") - first) <= 0) & (F.max(F.col("_to") - last) > 0)
    return placed.groupBy("session_id").agg(F.max("_n").alias("_n"), F.when(held, middle).otherwise(F.raise_error(F.lit("median outside its bracket")).cast("double")).alias("_m"))


def spikes(series: DataFrame) -> DataFrame:
    """(session_id, idx, uuid, inc_usd, cum_usd): single dear messages, the largest few of each session."""
    over = series.join(_medians(series), "session_id").filter(F.col("inc_usd") >= F.greatest(F.lit(SPIKE_FLOOR), SPIKE_FACTOR * F.col("_m")))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("inc_usd").desc(), "idx"))
    return over.withColumn("_r", rank).filter(F.col("_r") <= SPIKE_TOP).select("session_id", "idx", "uuid", "inc_usd", "cum_usd")


def series_lag(series: DataFrame, value: str, back: int, cell: int = LAG_CELL) -> DataFrame:
    """series with _then: value `back` messages earlier in the session, null if there is none.

    Sessions are cut into cells of messages, each with the last few of the cell before, so that
    one shuffle is enough and no task holds a session.
    """
    own = F.floor(F.col("idx") / cell)
    cells = F.when(F.col("idx") % cell >= cell - back, F.array(own, own + 1)).otherwise(F.array(own))
    earlier = Window.partitionBy("session_id", "_cell").orderBy("idx").rangeBetween(-back, -back)
    dealt = series.withColumn("_cell", F.explode(cells)).withColumn("_then", F.max(value).over(earlier))
    return dealt.filter(F.col("_cell") == own).drop("_cell")


def slopes(series: DataFrame, spike_rows: DataFrame) -> DataFrame:
    """(session_id, idx, uuid, inc_usd, cum_usd): steep stretches away from spikes, the steepest few of each session."""
    rise = series_lag(series, "cum_usd", SLOPE_WINDOW).withColumn("rise", F.col("cum_usd") - F.col("_then"))
    up = F.when(F.col("rise") > 0, F.col("rise"))
    stats = rise.groupBy("session_id").agg(F.count("*").alias("_n"), F.count(up).alias("_k"), F.stddev_pop(up).alias("_sd")).filter((F.col("_n") >= SLOPE_MIN_N) & (F.col("_k") >= SLOPE_MIN_RISES) & (F.col("_sd") > 0))
    near = spike_rows.groupBy("session_id").agg(F.collect_list("idx").alias("_spikes"))  # a handful at most
    steep = rise.join(stats, "session_id").join(near, "session_id", "left").filter(F.col("rise") >= F.greatest(SLOPE_SIGMAS * F.col("_sd"), F.lit(SPIKE_FLOOR)))
    apart = ~F.coalesce(F.exists("_spikes", lambda s: F.abs(F.col("idx") - s) <= SLOPE_RADIUS), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("rise").desc(), "idx"))
    return steep.filter(apart).withColumn("_r", rank).filter(F.col("_r") <= SLOPE_TOP).select("session_id", "idx", "uuid", "inc_usd", "cum_usd")


def markers(series: DataFrame) -> DataFrame:
    """Spikes and slopes with their kind."""
    spike_rows = spikes(series)
    return spike_rows.withColumn("kind", F.lit("spike")).unionByName(slopes(series, spike_rows).withColumn("kind", F.lit("slope")))


def place_markers(marks: DataFrame, points: DataFrame) -> DataFrame:
    """Markers with the down-sampled point they stand at."""
    shape = points.groupBy("session_id").agg(F.max("size").alias("_size"), F.count("*").alias("_points"))
    return marks.join(shape, "session_id").withColumn("point", F.least(F.floor(F.col("idx") / F.col("_size")).cast("int"), F.col("_points").cast("int") - 1)).drop("_size", "_points")
