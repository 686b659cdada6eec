"""An inverted index of segments: an update adds one, tombstones hide what it replaces, sizes tell which to merge.

Below the index's folder, nothing that is written is changed later:
  segments/<name>/postings/term_bucket=<n>   (term, doc, tf, len) in term order
  segments/<name>/docs                       (doc, part, len, digest)
  tombstones/<name>                          (doc, before): the doc's rows in segments numbered below `before` are gone
  versions                                   a row for each version, written last: readers see whole versions only
One writer at a time. A doc is live in at most one segment.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.operators.search import Index, term_bucket
from loomlog.sources.scratch import remove_folder, stored, subfolders

#: As many segments of like size are merged into one.
FAN = 4
#: Postings that a task sorts before they are shuffled: the sort behind the shuffle meets long runs.
RUN = 1 << 20
#: Bytes other than a-z become spaces.
LETTERS = bytes(i if 97 <= i <= 122 else 32 for i in range(256))
POSTINGS = "term string, doc {doc}, tf long, len long, term_bucket int"
DOCS = "doc {doc}, part long, len long, digest decimal(38,0)"
VERSION = "version long, source string, doc_type string, segments array<struct<name:string,seq:long,docs:long>>, tombstones array<string>, n_docs long, n_texts long, total_len long"


@dataclass
class Version:
    version: int = 0
    source: str | None = None
    doc_type: str = "string"
    segments: list = field(default_factory=list)  # (name, seq, docs)
    tombstones: list = field(default_factory=list)
    n_docs: int = 0
    n_texts: int = 0
    total_len: int = 0


def current(spark: SparkSession, out: str) -> Version:
    """The newest version; version 0, which holds nothing, if there is none."""
    if "versions" not in subfolders(spark, out):
        return Version()
    row = spark.read.schema(VERSION).parquet(f"{out}/versions").orderBy(F.col("version").desc()).first()
    return Version(**(row.asDict() | {"segments": [tuple(s) for s in row["segments"]]})) if row else Version()


def _tombstones(spark: SparkSession, out: str, v: Version) -> DataFrame:
    schema = f"doc {v.doc_type}, before long"
    folders = [f"{out}/tombstones/{t}" for t in v.tombstones]
    rows = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    return rows.groupBy("doc").agg(F.max("before").alias("before"))


def _live(spark: SparkSession, out: str, v: Version, what: str, segments: list | None = None) -> DataFrame:
    """Rows of the segments that no tombstone hides, with the number of their segment."""
    schema = (POSTINGS if what == "postings" else DOCS).format(doc=v.doc_type)
    read = [spark.read.schema(schema).parquet(f"{out}/segments/{name}/{what}").withColumn("seq", F.lit(seq).cast("long")) for name, seq, _ in (v.segments if segments is None else segments)]
    if not read:
        return spark.createDataFrame([], f"{schema}, seq long")
    rows = functools.reduce(DataFrame.unionByName, read)
    if not v.tombstones:
        return rows
    gone = _tombstones(spark, out, v).withColumnRenamed("doc", "_doc")
    return rows.join(gone, (F.col("doc") == F.col("_doc")) & (F.col("seq") < F.col("before")), "left_anti")


def open_index(spark: SparkSession, out: str) -> Index:
    """The newest version for `search.bm25`: postings of a query's terms come from the terms' buckets alone, with the lengths of their docs."""
    v = current(spark, out)
    postings, docs = _live(spark, out, v, "postings").drop("seq"), _live(spark, out, v, "docs").select("doc", "len")
    totals = spark.createDataFrame([(v.n_docs, v.total_len / v.n_texts if v.n_texts else None)], "n_docs long, avg_len double")
    return Index(postings, docs, None, totals)


def _lengths(rows: DataFrame) -> DataFrame:
    """(doc, part, x, len) of rows (doc, part, x, low): how many terms the lower-case bytes hold, null if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lens = [None if t is None else len(t.translate(LETTERS).split()) for t in b.column(3).to_pylist()]
            yield pa.record_batch([*b.columns[:3], pa.array(lens, pa.int64())], names=["doc", "part", "x", "len"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, part long, x long, len long")


def _postings(rows: DataFrame) -> DataFrame:
    """(term, doc, tf, len) of rows (doc, len, low), in runs by term and doc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, lens, sizes, terms, tfs = [], [], [], [], []

        def ordered(kind: pa.DataType) -> pa.RecordBatch:
            coded = pa.array(terms, pa.binary()).dictionary_encode()
            place = np.empty(len(coded.dictionary), np.int64)
            place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
            of = np.repeat(np.arange(len(docs)), sizes)
            doc = pa.array(docs, kind).take(pa.array(of))
            order = pc.sort_indices(pa.table({"term": place[coded.indices.to_numpy()], "doc": doc}), sort_keys=[("term", "ascending"), ("doc", "ascending")])
            out = [coded.take(order).dictionary_decode().cast(pa.string()), doc.take(order), pa.array(tfs, pa.int64()).take(order), pa.array(np.array(lens, np.int64)[of]).take(order)]
            return pa.record_batch(out, names=["term", "doc", "tf", "len"])

        for b in batches:
            for doc, n, text in zip(*(c.to_pylist() for c in b.columns)):
                if found := Counter(text.translate(LETTERS).split()):
                    docs.append(doc)
                    lens.append(n)
                    sizes.append(len(found))
                    terms.extend(found)
                    tfs.extend(found.values())
                if len(terms) >= RUN:
                    yield ordered(b.schema.field(0).type)
                    docs, lens, sizes, terms, tfs = [], [], [], [], []
        if terms:
            yield ordered(b.schema.field(0).type)

    return rows.mapInArrow(run, f"term string, doc {rows.schema['doc'].dataType.simpleString()}, tf long, len long")


def _write_segment(postings: DataFrame, docs: DataFrame, out: str) -> str:
    name = uuid.uuid4().hex
    bucketed = postings.select("term", "doc", "tf", "len", term_bucket(F.col("term")).alias("term_bucket"))
    # Rebalancing splits the bucket of a very frequent term over several tasks and files.
    bucketed.hint("rebalance", "term_bucket").sortWithinPartitions("term_bucket", "term", "doc").write.partitionBy("term_bucket").parquet(f"{out}/segments/{name}/postings")
    docs.select("doc", "part", "len", "digest").sortWithinPartitions("part").write.parquet(f"{out}/segments/{name}/docs")
    return name


def _merge(spark: SparkSession, out: str, v: Version) -> Version:
    """Merge segments of like size until fewer than FAN of any size are left; tombstones that hide nothing more go."""
    while True:
        tiers: dict[int, list] = {}
        for s in v.segments:
            tiers.setdefault(int(math.log(s[2] + 1, FAN)), []).append(s)
        full = next((t for _, t in sorted(tiers.items()) if len(t) >= FAN), None)
        if full is None:
            return v
        docs = stored(_live(spark, out, v, "docs", full))
        rest, n = [s for s in v.segments if s not in full], docs.count()
        if n:
            # What was hidden is left out, so the merged rows may take the greatest number.
            rest.append((_write_segment(_live(spark, out, v, "postings", full), docs, out), max(s[1] for s in full), n))
        oldest, kept = min((s[1] for s in rest), default=0), []
        if rest and v.tombstones:
            name = uuid.uuid4().hex
            _tombstones(spark, out, v).filter(F.col("before") > oldest).write.parquet(f"{out}/tombstones/{name}")
            kept = [name]
        v = Version(v.version, v.source, v.doc_type, rest, kept, v.n_docs, v.n_texts, v.total_len)


def sync(corpus: DataFrame, out: str, parts: list[int] | None = None, source: str | None = None) -> Version:
    """Bring the index up to date with corpus (doc, part, content_text) and publish the new version.

    corpus has all rows of the given parts (None: of all); other parts stay as they are, and a doc
    never moves from one part to another. Docs are compared by a digest of their texts: new and changed ones make up a new segment, tombstones hide
    these and the ones gone from their parts in older segments. Rows of one doc count as one text;
    a null text is a doc without terms that does not count in the average length; rows without a doc are not indexed.
    """
    spark, v = corpus.sparkSession, current(corpus.sparkSession, out)
    corpus = corpus.filter("doc is not null").select("doc", F.col("part").cast("long").alias("part"), "content_text")
    doc_type = corpus.schema["doc"].dataType.simpleString() if v.version == 0 else v.doc_type
    v, seq = Version(v.version + 1, source, doc_type, v.segments, v.tombstones, v.n_docs, v.n_texts, v.total_len), v.version + 1
    low = F.lower("content_text").cast("binary").alias("low")
    texts = _lengths(corpus.select("doc", "part", F.xxhash64(F.coalesce("content_text", F.lit(""))).alias("x"), low))
    now = texts.groupBy("doc").agg(F.min("part").alias("part"), F.sum("len").alias("len"), F.sum(F.col("x").cast("decimal(20,0)")).cast("decimal(38,0)").alias("digest"), F.count("*").alias("rows"))
    own = _live(spark, out, v, "docs")
    old = (own if parts is None else own.filter(F.col("part").isin(parts))).select("doc", F.struct("part", "len", "digest").alias("o"))
    both = now.select("doc", F.struct("part", "len", "digest").alias("n"), "rows").join(old, "doc", "full")
    changed = F.col("n").isNotNull() & (F.col("o").isNull() | (F.col("n") != F.col("o")))
    # One row for each doc that changes: what it becomes (null: gone) and what it was.
    diff = stored(both.filter(changed | F.col("n").isNull()))
    sums = diff.agg(F.count("n"), F.count("o"), F.count("n.len"), F.count("o.len"), F.coalesce(F.sum("n.len"), F.lit(0)), F.coalesce(F.sum("o.len"), F.lit(0)), F.max("rows")).first()
    v.n_docs, v.n_texts, v.total_len = v.n_docs + sums[0] - sums[1], v.n_texts + sums[2] - sums[3], v.total_len + sums[4] - sums[5]
    added = diff.filter("n is not null").select("doc", "n.*")
    if sums[1]:
        name = uuid.uuid4().hex
        diff.filter("o is not null").select("doc", F.lit(seq).cast("long").alias("before")).write.parquet(f"{out}/tombstones/{name}")
        v.tombstones = [*v.tombstones, name]
    if sums[0]:
        postings = _postings(corpus.filter("content_text is not null").join(added.select("doc", "len"), "doc").select("doc", "len", low))
        if sums[6] > 1:  # only docs of several rows have a term twice
            postings = postings.groupBy("doc", "len", "term").agg(F.sum("tf").alias("tf"))
        v.segments = [*v.segments, (_write_segment(postings, added, out), seq, sums[0])]
    v = _merge(spark, out, v)
    spark.createDataFrame([(v.version, v.source, v.doc_type, v.segments, v.tombstones, v.n_docs, v.n_texts, v.total_len)], VERSION).coalesce(1).write.mode("append").parquet(f"{out}/versions")
    return v


def vacuum_index(spark: SparkSession, out: str, keep: int = 2) -> int:
    """Delete segments and tombstones that none of the `keep` newest versions names, those of failed updates too; returns their number."""
    rows = spark.read.schema(VERSION).parquet(f"{out}/versions").orderBy(F.col("version").desc()).limit(keep).collect()
    live = {s["name"] for r in rows for s in r["segments"]} | {t for r in rows for t in r["tombstones"]}
    gone = [f"{out}/{kind}/{x}" for kind in ("segments", "tombstones") for x in subfolders(spark, f"{out}/{kind}") if x not in live]
    for path in gone:
        remove_folder(spark, path)
    return len(gone)
