"""Numbers, running sums and last values along groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.sources.scratch import stored


def in_order(rows: DataFrame, group: list[str], order: list[str], number: str | None = None, sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None) -> DataFrame:
    """rows with a number from 0 and, by output name, running sums and last non-null values in each group.

    Two phases, so that a group with a large part of all rows spreads over many tasks: rows are
    range-partitioned by (group, order) and written once, each partition scans its own rows, and
    what stands in earlier partitions of the same group is added. Only groups that cross a border
    between partitions have such rows, fewer than there are partitions, which bounds the broadcast.
    Null groups are one group.
    """
    sums, lasts = sums or {}, lasts or {}
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = stored(rows.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()))
    place = F.struct(*order)
    cells = laid.groupBy("_part", *group).agg(
        F.count("*").alias("_n"),
        *[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_l_{o}") for o, c in lasts.items()],
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select(
        F.col("_part").alias("_at_part"),
        *[F.col(c).alias(f"_g_{c}") for c in group],
        F.sum("_n").over(earlier).alias("_n"),
        *[F.sum(f"_s_{o}").over(earlier).alias(f"_s_{o}") for o in sums],
        *[F.last(f"_l_{o}", ignorenulls=True).over(earlier).alias(f"_l_{o}") for o in lasts],
    ).filter("_n is not null")
    here = Window.partitionBy("_part", *group).orderBy(*order)
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = laid.withColumns(
        {"_i": F.row_number().over(here) - 1}
        | {f"_hs_{o}": F.sum(c).over(so_far) for o, c in sums.items()}
        | {f"_hl_{o}": F.last(c, ignorenulls=True).over(so_far) for o, c in lasts.items()}
    )
    same = F.col("_part") == F.col("_at_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    out = {number: (F.coalesce("_n", F.lit(0)) + F.col("_i")).cast("long")} if number else {}
    out |= {o: F.coalesce(F.col(f"_s_{o}") + F.col(f"_hs_{o}"), f"_hs_{o}", f"_s_{o}") for o in sums}
    out |= {o: F.coalesce(f"_hl_{o}", f"_l_{o}") for o in lasts}
    return scanned.join(F.broadcast(before), same, "left").withColumns(out).select(*[c for c in rows.columns if c not in out], *out)
