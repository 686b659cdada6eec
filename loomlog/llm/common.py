"""What the operators of this subpackage share: input columns, written intermediate tables, dense numbering."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.llm.tokenfiles import release

#: Words are runs of characters other than ASCII white space.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, as (doc_id long, text string); other columns cannot clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; only a local master may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="loomlog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives executors. options are the writer's."""
    path = scratch_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, fn: Callable, schema: str, holds: bool = False) -> DataFrame:
    """mapInArrow; unless fn holds an object between tasks, workers first let go of what another stage built."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        return fn(batches)

    return df.mapInArrow(fn if holds else run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of a column, null as empty; bytes that are no UTF-8 become U+FFFD."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def dense_slots(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the given order.

    Rows are range-partitioned by (group, order), so that a group of any size spreads over
    many tasks; each partition numbers its own rows and adds the counts of those before it.
    """
    keys = [F.col(c) for c in (*group, *order)]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = written(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", *group).orderBy(*order)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.groupBy("_part", *group).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same: Column = F.lit(True)
    o = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in ("_part", *group)], "_before")
    for c in ("_part", *group):
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    numbered = laid.withColumn("_here", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(o), same, "left").withColumn(out, (F.col("_before") + F.col("_here")).cast("long")).select(*df.columns, out)
