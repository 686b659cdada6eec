"""Files of the queries that write logs first."""

import os

from pyspark.sql import functions as F

from loomlog.plans import queries


def test_one_file_for_each_group(spark, tmp_path):
    lines = spark.range(1000).select((F.col("id") % 5).alias("g"), F.concat(F.lit("line "), (F.col("id") % 5).cast("string")).alias("value"))
    queries._group_files(lines, 5, str(tmp_path))
    files = [(tmp_path / f).read_text().splitlines() for f in os.listdir(tmp_path) if f.startswith("part-")]
    assert sorted((len(f), *set(f)) for f in files) == [(200, f"line {g}") for g in range(5)]
