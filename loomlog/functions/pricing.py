"""Pricing of tokens: a rate table, longest-prefix lookup, and cost as a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# US dollars per million tokens as
# (prefix, input, cache write 5 minutes, cache write 1 hour, cache read, output).
DEFAULT_RATES = [
    ("claude-opus-4-7", 5.0, 6.25, 10.0, 0.50, 25.0),
    ("claude-opus-4-6", 5.0, 6.25, 10.0, 0.50, 25.0),
    ("claude-opus-4-5", 5.0, 6.25, 10.0, 0.50, 25.0),
    ("claude-opus-4-1", 15.0, 18.75, 30.0, 1.50, 75.0),
    ("claude-opus-4", 15.0, 18.75, 30.0, 1.50, 75.0),
    ("claude-opus-3", 15.0, 18.75, 30.0, 1.50, 75.0),
    ("claude-sonnet-4-6", 3.0, 3.75, 6.0, 0.30, 15.0),
    ("claude-sonnet-4-5", 3.0, 3.75, 6.0, 0.30, 15.0),
    ("claude-sonnet-4", 3.0, 3.75, 6.0, 0.30, 15.0),
    ("claude-sonnet-3-7", 3.0, 3.75, 6.0, 0.30, 15.0),
    ("claude-haiku-4-5", 1.0, 1.25, 2.0, 0.10, 5.0),
    ("claude-haiku-3-5", 0.80, 1.0, 1.60, 0.08, 4.0),
]
RATE_COLUMNS = ["input", "cache_write_5m", "cache_write_1h", "cache_read", "output"]


def rates(spark: SparkSession, rows=DEFAULT_RATES) -> DataFrame:
    """The rate table; pass other rows of the same six columns to replace it."""
    return spark.createDataFrame(rows, "prefix string, input double, cache_write_5m double, cache_write_1h double, cache_read double, output double")


#: Rate rows up to which prefixes are matched by one expression.
MAX_INLINE_RATES = 500


def longest_prefixes(models: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(model, prefix): the longest of the prefixes that begins each distinct model; models without one are left out.

    A model is cut at the lengths that prefixes have and meets them by equality, so that neither a
    long table nor many models lead to a loop over pairs. The lengths are one value.
    """
    known = prefixes.select("prefix").filter("prefix <> ''").distinct()
    lengths = known.agg(F.collect_set(F.length("prefix"))).scalar()
    cut = models.select("model").filter("model <> ''").distinct().withColumn("_lengths", lengths)
    starts = cut.select("model", F.explode(F.filter("_lengths", lambda n: n <= F.length("model"))).alias("_n"))
    return starts.withColumn("prefix", F.expr("substring(model, 1, _n)")).join(known, "prefix").groupBy("model").agg(F.max_by("prefix", "_n").alias("prefix"))


def with_rates(df: DataFrame, rate_table: DataFrame) -> DataFrame:
    """Add r_<rate> columns by the longest prefix of `model`; null, empty and unknown models get zeros.

    A rate table is a handful of rows, which become an expression; a longer one is matched with the
    distinct models, whose rates the rows then meet by equality. Of rows with the same prefix, the
    one with the lowest rates counts.
    """
    rows = rate_table.select("prefix", *RATE_COLUMNS).limit(MAX_INLINE_RATES + 1).collect()
    if len(rows) > MAX_INLINE_RATES:
        known = rate_table.groupBy("prefix").agg(F.min(F.struct(*RATE_COLUMNS)).alias("_rate"))
        matched = longest_prefixes(df, rate_table).join(known, "prefix").drop("prefix")
        joined = df.join(matched, "model", "left")
        return joined.select(*[df[c] for c in df.columns], *[F.coalesce(F.col(f"_rate.{c}"), F.lit(0.0)).alias(f"r_{c}") for c in RATE_COLUMNS])
    rows = sorted((r for r in rows if r["prefix"]), key=lambda r: (-len(r["prefix"]), r["prefix"], [(x is not None, x) for x in r[1:]]))
    place = F.lit(0)
    for i, row in reversed(list(enumerate(rows, 1))):
        place = F.when(F.col("model").startswith(row["prefix"]), i).otherwise(place)
    rate = lambda c: F.coalesce(F.element_at(F.array(F.lit(0.0), *[F.lit(r[c]).cast("double") for r in rows]), F.col("_rate") + 1), F.lit(0.0))
    return df.withColumn("_rate", place).withColumns({f"r_{c}": rate(c) for c in RATE_COLUMNS}).drop("_rate")


def billed_5m() -> Column:
    """5-minute cache writes, old records' total where neither class of write is given."""
    split = (F.col("cache_creation_5m") == 0) & (F.col("cache_creation_1h") == 0)
    return F.when(split, F.col("cache_creation_tokens")).otherwise(F.col("cache_creation_5m"))


def cache_write_cost() -> Column:
    return (billed_5m() * F.col("r_cache_write_5m") + F.col("cache_creation_1h") * F.col("r_cache_write_1h")) / 1e6


def cost_expr() -> Column:
    """Dollars of one row with token and r_ columns."""
    return (F.col("input_tokens") * F.col("r_input") + F.col("output_tokens") * F.col("r_output") + F.col("cache_read_tokens") * F.col("r_cache_read")) / 1e6 + cache_write_cost()


def priced(costs: DataFrame, rate_table: DataFrame) -> DataFrame:
    """Costs with cost_usd and write_cost_usd (cache writes only)."""
    return with_rates(costs, rate_table).withColumns({"cost_usd": cost_expr(), "write_cost_usd": cache_write_cost()}).drop(*[f"r_{c}" for c in RATE_COLUMNS])


def unpriced_models(costs: DataFrame, rate_table: DataFrame) -> DataFrame:
    """(model, messages, tokens) of models without a rate, the synthetic one left out."""
    named = costs.filter("model <> '' and model <> '<synthetic>'").groupBy("model").agg(F.count("*").alias("messages"), F.sum(F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")).alias("tokens"))
    return named.join(longest_prefixes(named, rate_table), "model", "left_anti")
