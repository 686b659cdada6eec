"""Left joins whose rows do not gather in one task when keys are null or very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.sources.scratch import stored


def frequent_keys(keys: DataFrame, key: str, parts: int) -> DataFrame:
    """(key, _pieces) of keys with more than two fair shares of the rows, of `parts` shares: at most parts / 2 rows.

    A key's pieces are an eighth of a fair share each, so that several in one task do not weigh much;
    all keys together have at most 8.5 x parts.
    """
    counts = keys.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_c"))
    total = keys.agg(F.count("*").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).filter(F.col("_c") * parts > 2 * F.col("_all")).select(key, F.ceil(8 * F.col("_c") * parts / F.col("_all")).cast("int").alias("_pieces"))


def spread_left_join(left: DataFrame, right: DataFrame, key: str, spread: list[str], counted: DataFrame | None = None) -> DataFrame:
    """left.join(right, key, "left"), with null keys and, if `counted` is given, frequent keys spread over all tasks.

    Rows are dealt by (key, salt). Null keys meet nothing, so they take many salts without a
    copy of anything; the salt comes from the columns `spread` of the left side, so a
    task that is run again deals its rows alike. counted: the left side's keys (any table with the
    column `key` will do, say a cheaper one); they are aggregated once, and right rows of frequent
    keys are repeated once a piece, those of other keys not at all. The right side is shuffled, never
    broadcast: it grows with the log, and its size is estimated far too small through VARIANT columns.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces, copies = F.lit(1), F.array(F.lit(0))
    if counted is not None:
        frequent = F.broadcast(stored(frequent_keys(counted.select(key), key, n)))  # at most n / 2 rows
        left, right = left.join(frequent, key, "left"), right.join(frequent, key, "left")
        pieces = F.coalesce("_pieces", F.lit(1))
        copies = F.sequence(F.lit(0), pieces - 1)
    of = lambda m: F.pmod(F.xxhash64(*spread), m).cast("int")
    dealt = left.withColumn("_salt", F.when(F.col(key).isNull(), of(F.lit(64 * n))).otherwise(of(pieces)))
    there = right.filter(F.col(key).isNotNull()).withColumn("_salt", F.explode(copies))
    if counted is not None:
        dealt, there = dealt.drop("_pieces"), there.drop("_pieces")
    return dealt.join(there.hint("merge"), [key, "_salt"], "left").drop("_salt")
