"""Near duplicates by MinHash bands and sequential Bayesian verification.

Texts with the same set of shingles are one class. Classes whose signatures agree in a whole band
are candidates; BANDS bands of ROWS hashes miss a pair at the threshold 0.85 with probability
(1 - 0.85**8)**40, some 3e-6, and likelier pairs less often. A candidate's signatures are compared a
batch of hashes at a time: with m of n equal, the posterior of the similarity under a uniform prior
is a beta distribution, and the pair goes once the probability that it reaches the threshold is
below MISS. Survivors are confirmed on the full sets.

A band's list that is long is first compared with one of its members, its hub, in chunks; what
is linked through hubs is one component by then. Then the members of every list that are not yet in
one component are compared block by block. Pairs that fail leave no rows, and no list is
held by one task, but lists of many texts that are alike and still not linked cost the square of
their length in comparisons.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import id_and_text, map_arrow, texts_of, written
from loomlog.llm.components import components

SHINGLE, PERCENT = 5, 85
BANDS, ROWS, MISS = 40, 8, 1e-5
#: Hashes that are compared before the posterior is looked at again.
BATCH = 64
#: Members of a list that are compared in one block.
BLOCK = 256
#: Shingles that are hashed by all permutations at once.
STEP = 4096
#: Rows of a comparison that are held at once; a block is never cut.
HELD = 1 << 14
SEED = 11


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z in lower case; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(words) - shingle + 1))


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of `count` permutations of 32-bit numbers, the same everywhere."""
    drawn = np.array([xxhash.xxh32_intdigest(str(i)) for i in range(2 * count)], np.uint32)
    return drawn[:count] | np.uint32(1), drawn[count:]


def signature(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Least number of the set under each permutation."""
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for low in range(0, len(folded), STEP):
        np.minimum(least, (folded[low : low + STEP, None] * factors + shifts).min(axis=0), out=least)
    return least


def least_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Fewest of n equal bytes at which the similarity reaches the threshold with probability `miss` or more.

    Bytes of different minima agree once in 256, which raises the threshold. After m matches
    the posterior is Beta(m + 1, n - m + 1); its tail is a binomial sum.
    """
    p = percent / 100 + (1 - percent / 100) / 256
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def signatures(df: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, k1, k2, n_shingles, bytes binary), one row per input row.

    k1 and k2 are 128 bits of the set; bytes holds the low byte of each minimum, band after band (without words: null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = permutations(bands * rows)
        for part in (b.slice(low, 256) for b in batches for low in range(0, b.num_rows, 256)):
            k1, k2, size, low = [], [], [], []
            for text in texts_of(part.column(2)):
                hashes = shingle_hashes(text, shingle)
                whole = xxhash.xxh3_128_intdigest(hashes.tobytes())
                least = signature(hashes, factors, shifts)
                k1.append(whole >> 64)
                k2.append(whole & 0xFFFFFFFFFFFFFFFF)
                size.append(len(hashes))
                low.append((least & np.uint32(255)).astype(np.uint8).tobytes() if len(hashes) else None)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.record_batch([part.column(0), part.column(1), signed(k1), signed(k2), pa.array(size, pa.int64()), pa.array(low, pa.binary())], names=["doc_id", "text_hash", "k1", "k2", "n_shingles", "bytes"])

    docs = id_and_text(df, id_col, text_col).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return map_arrow(docs, run, "doc_id long, text_hash long, k1 long, k2 long, n_shingles long, bytes binary")


def _comparison(percent: int, miss: float, width: int, bands: int, everywhere: bool):
    """Rows (band, key, part, side, node, label, n, bytes), each part together, to (a, b): pairs that survive.

    Within a part, rows of different sides meet, and rows of side -1 each other; pairs of one label
    are known. Unless `everywhere`, a pair comes from the first band in which it meets.
    """
    stops = [(low, min(low + BATCH, width)) for low in range(0, width, BATCH)]
    needed = [least_matches(high, percent, miss) for _, high in stops]

    def compared(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        band, key, part, side, node, label, n = (table[i].to_numpy() for i in range(7))
        same = (band[1:] == band[:-1]) & (key[1:] == key[:-1]) & (part[1:] == part[:-1])
        run = np.concatenate(([0], np.cumsum(~same)))
        sig = np.frombuffer(b"".join(table[7].to_pylist()), np.uint8).reshape(-1, width)
        a, b = [], []
        for d in range(1, len(run)):
            p = np.flatnonzero(run[d:] == run[:-d])
            if not len(p):
                break
            q = p + d
            ok = (label[p] != label[q]) & ((side[p] == -1) | (side[p] != side[q])) & (100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q]))
            p, q = p[ok], q[ok]
            equal = np.zeros(len(p), np.int64)
            for (low, high), least in zip(stops, needed):
                equal += (sig[p, low:high] == sig[q, low:high]).sum(axis=1)
                ok = equal >= least
                p, q, equal = p[ok], q[ok], equal[ok]
            if not everywhere and len(p):
                agree = (sig[p] == sig[q]).reshape(len(p), bands, -1).all(axis=2)
                ok = agree.argmax(axis=1) == band[p]
                p, q = p[ok], q[ok]
            a.append(np.minimum(node[p], node[q]))
            b.append(np.maximum(node[p], node[q]))
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0) if a else np.zeros((0, 2), np.int64)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if rows >= HELD:
                # Up to where the next batch's first group began.
                last = [held[-1].column(i)[-1] for i in range(3)]
                ends = np.flatnonzero(~np.logical_and.reduce([batch.column(i).to_numpy() == last[i].as_py() for i in range(3)]))
                cut = int(ends[0]) if len(ends) else batch.num_rows
                held.append(batch.slice(0, cut))
                if cut < batch.num_rows:
                    yield compared(held)
                    held, rows, batch = [], 0, batch.slice(cut)
                else:
                    continue
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield compared(held)

    return run


def _compared(rows: DataFrame, percent: int, miss: float, width: int, bands: int, everywhere: bool) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.select("band", "key", "part", "side", "node", "label", "n", "bytes").repartition(n, "band", "key", "part").sortWithinPartitions("band", "key", "part", "side", "node")
    return map_arrow(laid, _comparison(percent, miss, width, bands, everywhere), "a long, b long").distinct()


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) of class numbers whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(low, 64) for b in batches for low in range(0, b.num_rows, 64)):
            sets = [shingle_hashes(x, shingle).view(np.int64) for x in texts_of(part.column(1))]
            flat = pa.array(np.concatenate(sets), pa.int64())
            yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in sets]), pa.int32()), flat)], names=["node", "hashes"])

    pairs = written(pairs)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = classes.join(nodes, "node", "left_semi").select("node", "doc_id", "text_hash")
    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"), "text")
    found = texts.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")))
    # Rows repeated as a whole give a class several times; any of them will do.
    sets = written(map_arrow(found.select("node", "text"), run, "node long, hashes array<long>").groupBy("node").agg(F.first("hashes").alias("hashes")))
    # A hub has many pairs, so they are dealt by hub and slot; a slot's copy of the set is made only where it has a pair.
    slots = max(64, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(slots)).alias("sa"), F.pmod(F.xxhash64("a"), F.lit(slots)).alias("sb"))
    side = dealt
    for c in "ab":
        own = dealt.select(c, f"s{c}").distinct().join(sets.withColumnRenamed("node", c).withColumnRenamed("hashes", f"h{c}"), c)
        side = side.join(own, [c, f"s{c}"])
    both = F.size(F.array_intersect("ha", "hb"))
    return side.withColumn("both", both.cast("long")).filter(100 * F.col("both") >= percent * (F.size("ha") + F.size("hb") - F.col("both"))).select("a", "b")


def near_duplicates(df: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, miss: float = MISS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id), one row per input row.

    Texts are linked if their shingle sets' Jaccard similarity reaches `percent`; component_id is
    the least id reachable, class_id the least id of the same set. Texts without words are linked
    with nothing and stand for themselves. Null ids take part and are nobody's least id, unless the
    component has no other. Repeated rows stay. An empty table gives no rows.
    """
    docs, width = id_and_text(df, id_col, text_col), bands * rows
    signed = written(signatures(docs, shingle, bands, rows))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash"))
    reps = signed.filter("n_shingles > 0").groupBy("k1", "k2").agg(first.alias("x")).select("k1", "k2", "x.doc_id", "x.text_hash")
    same = [signed[c].eqNullSafe(reps[c]) for c in ("doc_id", "text_hash", "k1", "k2")]
    picked = signed.join(reps, same[0] & same[1] & same[2] & same[3], "left_semi").dropDuplicates(["k1", "k2"])
    classes = written(picked.withColumn("node", F.monotonically_increasing_id()))
    keys = [F.xxhash64(F.substring("bytes", i * rows + 1, rows)) for i in range(bands)]
    postings = classes.select("node", F.posexplode(F.array(*keys)).alias("band", "key"))
    sizes = postings.groupBy("band", "key").agg(F.count("*").alias("members")).filter("members > 1")
    lists = written(postings.join(sizes, ["band", "key"]))
    carried = classes.select("node", F.col("n_shingles").alias("n"), "bytes")

    # Hubs: of a long list, the member with most company over all lists, as the origin of many copies has.
    company = lists.groupBy("node").agg(F.sum("members").alias("company"))
    long_lists = lists.filter(F.col("members") > block)
    hubs = long_lists.join(company, "node").groupBy("band", "key", "members").agg(F.max_by("node", F.struct("company", "node")).alias("node"))
    chunks = F.ceil(F.col("members") / block).cast("int")
    chunk = F.pmod(F.xxhash64("node"), chunks.cast("long")).cast("int")
    star = long_lists.select("band", "key", chunk.alias("part"), F.lit(1).alias("side"), "node").unionByName(hubs.select("band", "key", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("part"), F.lit(0).alias("side"), "node"))
    star = star.withColumn("label", F.when(F.col("side") == 0, F.lit(-1).cast("long")).otherwise(F.col("node")))
    # The hub among its own members would be a pair of itself.
    met = _compared(star.join(carried, "node"), percent, miss, width, bands, True).filter("a <> b")
    links = written(_confirmed(met, classes, docs, shingle, percent))
    labels = written(components(links)).withColumnRenamed("label", "known")

    # Lists with members of several components, in blocks: each pair of blocks is a part.
    labelled = written(lists.join(labels, "node", "left").select("node", "band", "key", "members", F.coalesce("known", "node").alias("label")))
    mixed = labelled.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("band", "key")
    blocks, own = F.ceil(F.col("members") / block).cast("int"), F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / block)).cast("int")
    dealt = labelled.join(mixed, ["band", "key"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select("band", "key", (high * (high + 1) / 2 + low).cast("int").alias("part"), F.when(low == high, -1).when(F.col("own") == low, 0).otherwise(1).alias("side"), "node", "label")
    rest = _confirmed(_compared(dealt.join(carried, "node"), percent, miss, width, bands, False), classes, docs, shingle, percent)
    found = components(links.unionByName(rest))

    least = classes.select("k1", "k2", "node", F.col("doc_id").alias("class_id")).join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    whole = least.join(least.groupBy("label").agg(F.min("class_id").alias("component_id")), "label").select("k1", "k2", "class_id", "component_id")
    placed = signed.select("doc_id", "n_shingles", "k1", "k2").filter("n_shingles > 0").join(whole, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id", "class_id")
    return placed.unionByName(signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id")))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT w.doc_id, count(g) AS n_shingles FROM w LEFT JOIN g ON g.doc_id = w.doc_id GROUP BY w.doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n_shingles + nb.n_shingles - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT n.doc_id, n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN least ON least.doc_id = n.doc_id
"""
