import random

from pyspark.sql import functions as F

from loomlog.operators.running import in_order


def brute(rows):
    """rows: (g, t, x, y) in order of g and t."""
    out, state = set(), {}
    for g, t, x, y in rows:
        n, total, last = state.get(g, (0, None, None))
        total = total if x is None else x + (total or 0)
        last = last if y is None else y
        out.add((g, t, n, total, last))
        state[g] = (n + 1, total, last)
    return out


def test_a_group_over_many_partitions(spark):
    rng = random.Random(3)
    rows = [(g, t, None if rng.random() < 0.2 else rng.randrange(9), rng.choice([None, None, "a", "b"])) for g, n in (("hot", 300), (None, 7), ("x", 1), ("y", 12)) for t in range(n)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "g string, t int, x long, y string")
    got = in_order(df, ["g"], ["t"], number="n", sums={"total": "x"}, lasts={"y": "y"})
    assert {(r.g, r.t, r.n, r.total, r.y) for r in got.collect()} == brute(rows)
    assert in_order(df.filter("false"), ["g"], ["t"], number="n").count() == 0


def test_long_group_is_numbered(spark):
    df = spark.range(4000).select(F.lit("s").alias("g"), F.col("id").alias("t"))
    assert in_order(df, ["g"], ["t"], number="n").filter("n <> t").count() == 0
