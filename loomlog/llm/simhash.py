"""Near duplicates by SimHash and an inverted index over the fingerprint's bytes by position.

Fingerprints that differ in at most two bits share at least six of their eight positional bytes.
A posting list of one positional byte would hold a 256th of all fingerprints, so lists are keyed
by combinations of four: of four byte pairs at least two agree, which six combinations cover. A
pair met in a list is tallied over all eight positions, kept from six shared bytes on, counted
only in its first common list, and verified bit by bit. Lists longer than LONG_LIST are searched
through midpoints instead of pairs: two fingerprints differ in at most two bits exactly if a
flip of at most one bit each makes them equal, so each writes 33 midpoints and all that meet in
one are linked to the least of them. That is exact, and linear in the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import id_and_text, map_arrow, texts_of, written
from loomlog.llm.components import components

SEED, SHINGLE, RADIUS = 42, 3, 2
MIN_SHARED_BYTES = 8 - RADIUS
LONG_LIST = 48
#: Shingles whose bits are summed at once, so that very long texts need bounded memory.
STEP = 1 << 15


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: The six ways to take two of four byte pairs, as 64-bit masks.
MASKS = [_signed(sum(0xFFFF << (16 * p) for p in pair)) for pair in combinations(range(4), 2)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash: majority over the XXH64 of all shingles, repeats included; no word: zero."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for low in range(0, n, STEP):
        part = words[low : low + STEP + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", keep_hash: bool = False) -> DataFrame:
    """(doc_id, fp long), one row per input row; with keep_hash also text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(low, 256) for b in batches for low in range(0, b.num_rows, 256)):
            found = pa.array([fingerprint(x, shingle) for x in texts_of(part.column(1))], pa.int64())
            yield pa.record_batch([part.column(0), found, *part.columns[2:]], names=["doc_id", "fp", *part.schema.names[2:]])

    docs = id_and_text(df, id_col, text_col)
    if keep_hash:
        docs = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return map_arrow(docs, run, "doc_id long, fp long" + ", text_hash long" * keep_hash)


def _mask(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MASKS]), c + 1)


def _shared_bytes(diff: Column) -> Column:
    """Positions at which both fingerprints have the same byte."""
    out = F.lit(0)
    for i in range(8):
        out = out + F.shiftrightunsigned(diff, 8 * i).bitwiseAND(F.lit(255)).eqNullSafe(F.lit(0)).cast("int")
    return out


def links(fps: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b) links between distinct fingerprints of column fp that differ in 1 or 2 bits.

    All such pairs in lists of up to `long_list`; in longer ones enough of them to connect
    whatever is connected.
    """
    postings = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for c, m in enumerate(MASKS)])).alias("p")).select("fp", "p.c", "p.key")
    sizes = postings.groupBy("c", "key").agg(F.count("*").alias("n")).filter("n > 1")
    lists = written(postings.join(sizes, ["c", "key"]))
    left, right = lists.filter(F.col("n") <= long_list).select("c", "key", F.col("fp").alias("a")), lists.filter(F.col("n") <= long_list).select("c", "key", F.col("fp").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(diff.bitwiseAND(F.lit(m)) == 0, F.lit(c)) for c, m in enumerate(MASKS)])
    met = left.join(right, ["c", "key"]).filter("a < b").filter(first == F.col("c"))
    pairs = met.filter(_shared_bytes(diff) >= MIN_SHARED_BYTES).filter(F.bit_count(diff) <= RADIUS).select("a", "b")
    flips = [F.col("fp")] + [F.when(_mask(F.col("c")).bitwiseAND(F.lit(_signed(1 << i))) == 0, F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)))) for i in range(64)]
    middle = lists.filter(F.col("n") > long_list).select("c", "fp", F.explode(F.array_compact(F.array(*flips))).alias("z"))
    hubs = middle.groupBy("c", "z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = middle.join(hubs, ["c", "z"]).filter("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars.distinct())


def _labelled(fps: DataFrame) -> DataFrame:
    """(fp, least id, label) of each fingerprint; label names its component."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    return nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id), one row per input row.

    component_id is the least id reachable over links of at most two differing bits; equal texts
    have distance zero, texts without a word fingerprint zero. Null ids take part and are nobody's
    least id (null if the component has no other); repeated rows stay. An empty table gives no rows.
    """
    fps = written(fingerprints(df, shingle, id_col, text_col))
    labelled = _labelled(fps)
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return fps.join(labelled.join(least, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of df of each component, the one with the least id, all columns kept.

    Null ids come after all others; of rows with the least id, the text's hash decides. Different
    texts under one id, null included, are judged each by its own component.
    """
    names = df.columns
    docs = id_and_text(df, id_col, text_col)
    fps = written(fingerprints(docs, shingle, keep_hash=True))
    keys = fps.groupBy("doc_id", "text_hash").agg(F.first("fp").alias("fp"), F.count("*").alias("n"))
    # The least row of each fingerprint first, so that many copies of a text are no hot key of the join.
    rows = keys.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n")).alias("x"))
    first = rows.join(_labelled(fps).select("fp", "label"), "fp").groupBy("label").agg(F.min("x").alias("x"))
    keep = first.select(F.col("x.doc_id").alias("_doc"), F.col("x.text_hash").alias("_text"), F.col("x.n").alias("_rows"))
    # The caller's row is one column, so that no name of its can clash.
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("_hash"))
    kept = row.join(keep, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_text")))
    once = kept.filter("_rows = 1").select("_row.*")
    return once.unionByName(kept.filter("_rows > 1").dropDuplicates(["_doc", "_text"]).select("_row.*"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
