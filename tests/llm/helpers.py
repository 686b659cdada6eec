"""Awkward documents that every operator has to survive."""

from pyspark.sql import DataFrame, SparkSession

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank again and again while it rains today"),
    (1, "The quick brown fox jumps over the lazy dog near the river bank again and again while it rains today"),
    (2, None),
    (3, ""),
    (4, " \t\n\x0b\x0c\r "),
    (5, "É ß 𝒳 naïve mot\r\nline\nline\n line"),
    (None, "no id here"),
    (6, "a" * 3000 + " " + "b1 " * 4000),
    (7, "don't  stop   the\n\n\nmusic!!! 12345 \x1c x\x1dy"),
]


def documents(spark: SparkSession, rows=AWKWARD) -> DataFrame:
    """Rows as documents, with columns that clash with operators' own."""
    data = [(i, t, "en", None, -1, "x", 9) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, n_words string, shard int")
