"""Sharding by rendezvous (highest random weight) hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import dense_slots, id_and_text

SHARDS = 24


def shard_cost(key: Column, shard: int, weight: float) -> Column:
    """Exponential draw of a (key, shard) pair with rate `weight`; the least one owns the key."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return -F.log(unit) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Struct (cost, shard) of the owner of a key; a null key counts as an empty one.

    Only the key, the shard's number and its weight decide, so adding a shard moves rows only
    into it and changing a weight moves rows only from or to that shard. Equal costs go to the
    lower shard. A shard of weight zero owns nothing.
    """
    k = F.coalesce(key.cast("string"), F.lit(""))
    costs = [F.struct(shard_cost(k, i, w).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    if not costs:
        raise ValueError("at least one shard needs a positive weight")
    return F.least(*costs) if len(costs) > 1 else costs[0]


def assign_shards(df: DataFrame, weights: Sequence[float], key_col: str = "doc_id", out: str = "shard") -> DataFrame:
    """Add the owning shard of each row's key, keeping all columns (a column named `out` is replaced)."""
    return df.withColumn(out, rendezvous(F.col(f"`{key_col}`"), weights)["shard"].cast("int"))


def write_shards(df: DataFrame, path: str, weights: Sequence[float], key_col: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Write each shard's rows to its own folder shard=<n>; large shards spread over several tasks and files."""
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded = assign_shards(df, weights, key_col)
    sharded.repartition(spread, "shard", F.pmod(F.xxhash64(F.col(f"`{key_col}`")), F.lit(8))).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def shard_report(df: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of the assignment to `n_shards` shards of equal weight, one row per input row.

    size is the text's UTF-8 bytes (null: none) plus 8; slot numbers a shard's rows from 0 in id
    order (ties by size, then checksum); grown_shard is the shard among one more. Null ids share
    the empty key. An empty table gives no rows; repeated rows get a slot each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = id_and_text(df, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), rendezvous(F.col("doc_id"), [1.0] * n_shards).alias("_own")
    )
    new = shard_cost(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), n_shards, 1.0)
    rows = rows.select("doc_id", "size", "text_crc32", "law", F.col("_own.shard").cast("int").alias("shard"), F.when(new < F.col("_own.cost"), F.lit(n_shards)).otherwise(F.col("_own.shard")).cast("int").alias("grown_shard"))
    return dense_slots(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
