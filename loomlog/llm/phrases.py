"""Phrase collocations from count streams kept in prefix order and in suffix order.

Words are counted as texts; the frequent ones get dense numbers, and the texts are written once as
rows of numbers. Phrases of two words and more are counted level by level by the numbers of their
words, packed into longs, so that counts are exact and no task reports texts. A phrase can only be
frequent if its parts are: the frequent phrases of a level go to the next pass as a bit table of
bounded size, in which a wrong hit costs work and changes no result. Phrases get their texts last,
once each.

The frequent phrases are then laid out twice, ordered by their words and by their words from the
end, each order dealt by range. One scan of the prefix order, with a stack of the phrases that
begin the present one, gives the count of every first part and the greatest count among extensions
to the right; the suffix order gives last parts and extensions to the left. The two streams meet in
a merge join. What a scan needs from earlier partitions are the parts of its first phrase, at most
four rows a partition.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import dense_slots, map_arrow, written

LONGEST, MIN_COUNT, TOP = 5, 100, 2000
NO_LANG = "und"
#: Bytes of text that are split at once.
STEP = 1 << 21
#: Phrases that a task holds before it adds them up.
HELD = 3 << 20
#: Distinct words whose counts a task holds before it reports them.
WORDS_HELD = 1 << 18
#: Frequent words that a task knows at once; more are looked up in as many passes.
SLICE = 1 << 19
#: The bit table of frequent hashes has between 2**20 and 2**MAX_BITS bits.
MAX_BITS = 27

BREAKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z in lower case, whatever ends a piece as line feed, tabs as spaces.
TABLE = bytes(10 if i in BREAKS else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))
MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of some texts: start, end and piece of each, in order; texts are separated by a break."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        self.langs, self.texts = langs, texts
        self.raw = b"\n".join(texts).translate(TABLE)
        b = np.frombuffer(self.raw, np.uint8)
        apart = np.concatenate(([True], (b == 32) | (b == 10), [True]))
        edge = apart[1:] != apart[:-1]
        at = np.flatnonzero(edge)
        self.start, self.end = at[::2], at[1::2]
        self.piece = np.cumsum(b == 10, dtype=np.int32)[self.start] if len(b) else self.start

    def by_lang(self) -> Iterator[tuple[str, list[bytes]]]:
        """The words of each run of texts of one language, in order."""
        words = self.raw.split()
        ends = np.searchsorted(self.start, np.cumsum([len(t) + 1 for t in self.texts])).tolist()
        begin = 0
        for i, lang in enumerate(self.langs):
            if i + 1 == len(ends) or lang != self.langs[i + 1]:
                yield lang, words[begin : ends[i]]
                begin = ends[i]


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(a * np.uint64(0xA0761D6478BD642F | 1) + b)


def _known(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    bits = int(len(table) * 64).bit_length() - 1
    at = h >> np.uint64(64 - bits)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _utf8(text: bytes) -> bytes:
    """The text, bytes that are no UTF-8 as U+FFFD."""
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Words of some MB of texts at a time; a longer text is cut between pieces."""
    langs: list[str] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            rest, lang = _utf8(text.as_py() or b""), NO_LANG if lang is None else lang
            while rest:
                part, cut = rest, STEP
                if len(rest) > STEP:
                    part = rest[:STEP]
                    cut = max(part.rfind(bytes([c])) for c in BREAKS) + 1
                    if not cut:  # one piece fills it: up to that piece's end
                        ends = [x for x in (rest.find(bytes([c]), STEP) for c in BREAKS) if x >= 0]
                        cut = min(ends, default=len(rest) - 1) + 1
                    part = rest[:cut]
                rest = rest[cut:]
                langs.append(lang)
                texts.append(part)
                size += len(part)
                if size >= STEP:
                    yield Words(langs, texts)
                    langs, texts, size = [], [], 0
    if texts:
        yield Words(langs, texts)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, a) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def batch(lang: str, found: Counter) -> pa.RecordBatch:
            return pa.record_batch([pa.array([lang] * len(found)), pa.array([w.decode() for w in found]), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "c"])

        for words in _blocks(batches):
            for lang, own in words.by_lang():
                seen.setdefault(lang, Counter()).update(own)
            if sum(map(len, seen.values())) > WORDS_HELD:
                while seen:
                    yield batch(*seen.popitem())
        while seen:
            yield batch(*seen.popitem())

    return map_arrow(docs, run, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("a"))


def _numbered(docs: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """(ids binary) of blocks of docs (lang, text): the numbers of their words in words (lang, word, id), ids below n, as 32-bit integers; -1: another word or the end of a piece."""
    spark, rows = docs.sparkSession, None
    for least in range(0, n, SLICE):
        own = words.filter((F.col("id") >= least) & (F.col("id") < least + SLICE)).select("lang", "word", "id").toArrow()
        by: dict[str, dict[bytes, int]] = {}
        for lang, word, i in zip(own["lang"].to_pylist(), own["word"].to_pylist(), own["id"].to_pylist()):
            by.setdefault(lang, {})[word.encode()] = i
        table, last = spark.sparkContext.broadcast(by), least + SLICE >= n

        def blocks(batches: Iterator[pa.RecordBatch], first: bool = not least) -> Iterator[tuple[Words, bytes | None]]:
            if first:
                yield from ((w, None) for w in _blocks(batches))
            else:
                for b in batches:
                    yield from ((Words(langs.as_py(), texts.as_py()), ids.as_py()) for ids, langs, texts in zip(*b.columns))

        def run(batches: Iterator[pa.RecordBatch], table=table, last: bool = last, blocks=blocks) -> Iterator[pa.RecordBatch]:
            known = table.value
            for words, before in blocks(batches):
                found: list[int] = []
                for lang, own in words.by_lang():
                    get = known.get(lang, {}).get
                    found.extend(map(get, own, repeat(-1)))
                at = np.arange(len(found)) + np.cumsum(np.diff(words.piece, prepend=words.piece[:1]) > 0)
                ids = np.full(len(at) and at[-1] + 1, -1, np.int32)
                ids[at] = found
                if before is not None:
                    ids = np.maximum(ids, np.frombuffer(before, np.int32))
                out = [pa.array([ids.tobytes()], pa.binary())]
                out += [] if last else [pa.array([words.langs]), pa.array([words.texts], pa.list_(pa.binary()))]
                yield pa.record_batch(out, names=["ids", "langs", "texts"][: len(out)])

        rows = written(map_arrow(docs if rows is None else rows, run, "ids binary" + ("" if last else ", langs array<string>, texts array<binary>")))
    return rows


def _tally(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns, and how often they stand there, or the sums of their counts."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else None if counts is None else np.argsort(columns[0])
    columns = [np.sort(c) if order is None else c[order] for c in columns]
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    sums = np.diff(at, append=len(new)) if counts is None else np.add.reduceat(counts[order], at) if len(at) else counts
    return [c[at] for c in columns], sums


def _frequent_phrases(numbered: DataFrame, size: int, bits: int, tables: list, least: int) -> DataFrame:
    """(k0, k1, ... long, a) of phrases of `size` words that occur `least` times or more: numbers of `bits` bits, as many in a long as there is room for; tables: bit tables of the smaller sizes from two words on."""
    per = 63 // bits
    names = [f"k{i}" for i in range(-(-size // per))]

    def rows(columns: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([*map(pa.array, columns), pa.array(counts.astype(np.int64))], names=[*names, "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [t.value for t in tables]
        parts: list[tuple[list[np.ndarray], np.ndarray]] = []

        def summed() -> pa.RecordBatch:
            columns = [np.concatenate([p[0][i] for p in parts]) for i in range(len(names))]
            counts = np.concatenate([p[1] for p in parts])
            parts.clear()
            return rows(*_tally(columns, counts))

        for batch in batches:
            for block in batch.column(0):
                ids = np.frombuffer(block.as_py(), np.int32)
                at = np.flatnonzero(ids >= 0)
                for level in range(2, size + 1):
                    at = at[:-1][np.diff(at) == 1]
                    if level < size:
                        at = at[_known(known[level - 2], _hashed([ids[at + i] for i in range(level)]))]
                if not len(at):
                    continue
                columns = []
                for first in range(0, size, per):
                    key = ids[at + first].astype(np.int64)
                    for i in range(first + 1, min(first + per, size)):
                        key = key << bits | ids[at + i]
                    columns.append(key)
                found, n = _tally(columns)
                parts.append((found, n.astype(np.int32)))
                if sum(len(p[1]) for p in parts) >= HELD:
                    yield summed()
        if parts:
            yield summed()

    counts = map_arrow(numbered, run, ", ".join(f"{k} long" for k in names) + ", c long").groupBy(*names).agg(F.sum("c").alias("a"))
    return written(counts.filter(F.col("a") >= least))


def _hashed(ids: list[np.ndarray]) -> np.ndarray:
    """Of phrases, given the numbers of their first words, of their second ones and so on."""
    h = _mixed(ids[0].astype(np.uint64))
    for x in ids[1:]:
        h = _joined(h, _mixed(x.astype(np.uint64)))
    return h


def _unpacked(size: int, bits: int) -> Column:
    """The numbers of a phrase's words from its longs."""
    per = 63 // bits
    within = lambda i: min(per, size - i // per * per)
    return F.array(*[F.shiftright(f"k{i // per}", bits * (within(i) - 1 - i % per)).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(size)])


def _hashes(phrases: DataFrame, size: int) -> DataFrame:
    """(h long) of phrases (ids array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            yield pa.record_batch([pa.array(_hashed(list(ids.T)).view(np.int64))], names=["h"])

    return map_arrow(phrases.select("ids"), run, "h long")


def _bit_table(spark: SparkSession, hashes: DataFrame, max_bits: int):
    """Broadcast bits of the hashes, some 32 bits each, at most 2**max_bits: at most 2**(max_bits - 6) rows reach the driver."""
    bits = min(max_bits, max(20, (32 * hashes.count()).bit_length()))
    at = F.shiftrightunsigned("h", 64 - bits)
    rows = hashes.groupBy(F.shiftright(at, 6).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("m")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[rows["i"].to_numpy()] = rows["m"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(table)


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = MIN_COUNT, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """From docs (lang, text): (lang, phrase, a) of all phrases of up to `longest` words that occur `least` times or more, and (lang, n)."""
    spark = docs.sparkSession
    every = written(word_counts(docs))
    words = written(dense_slots(every.filter(F.col("a") >= least), [], ["lang", "word"], "id"))
    n = words.count()
    found, tables, bits = words.select("lang", F.col("word").alias("phrase"), "a"), [], max(1, (n - 1).bit_length())
    numbered = _numbered(docs, words, n) if n and longest > 1 else None
    levels: list[DataFrame] = []
    for size in range(2, longest + 1 if n else 2):
        phrases = _frequent_phrases(numbered, size, bits, tables, least).select(_unpacked(size, bits).alias("ids"), "a")
        levels.append(phrases)
        if size < longest:
            tables.append(_bit_table(spark, _hashes(phrases, size), max_bits))
    if levels:
        placed = functools.reduce(DataFrame.unionByName, levels).select("ids", "a", F.posexplode("ids").alias("at", "id"))
        known = words.select("id", "lang", "word")
        texts = placed.join(F.broadcast(known) if n <= SLICE else known, "id").groupBy("ids").agg(F.min("lang").alias("lang"), F.min("a").alias("a"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
        found = found.unionByName(texts.select("lang", F.array_join("w.word", " ").alias("phrase"), "a"))
    return written(found), every.groupBy("lang").agg(F.sum("a").alias("n"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, lang, words, a, own) in order to (lang, words, a, parts, longer, own): one pass with a stack."""
    stack: list[list] = []
    place, out = None, []

    def flushed() -> pa.RecordBatch:
        schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("a", pa.int64()), ("parts", pa.list_(pa.int64())), ("longer", pa.int64()), ("own", pa.bool_())])
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    for b in batches:
        for part, lang, words, a, own in zip(*(c.to_pylist() for c in b.columns)):
            while stack and ((part, lang) != place or words[: len(stack[-1][1])] != stack[-1][1]):
                out.append(stack.pop())
            place = (part, lang)
            if stack:
                stack[-1][4] = max(stack[-1][4], a)
            stack.append([lang, words, a, [s[2] for s in stack], 0, own])
        if len(out) >= 10_000:
            yield flushed()
            out = []
    out += stack[::-1]
    yield flushed()


def part_counts(counts: DataFrame, suffixes: bool = False) -> DataFrame:
    """(lang, phrase, a, parts, longer): counts of the phrase's first 1, 2, ... words (suffixes: last), and the greatest count of a phrase one word longer at its end (front)."""
    words = F.split("phrase", " ")
    rows = counts.select("lang", (F.reverse(words) if suffixes else words).alias("words"), "a")
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = written(rows.repartitionByRange(n, "lang", "words").select(F.spark_partition_id().alias("part"), "lang", "words", "a"))
    firsts = laid.groupBy("part").agg(F.min(F.struct("lang", "words")).alias("x"))
    heads = firsts.select("part", "x.lang", F.explode(F.transform(F.sequence(F.lit(1), F.size("x.words")), lambda i: F.slice("x.words", F.lit(1), i))).alias("words"), F.size("x.words").alias("k")).filter(F.size("words") < F.col("k")).drop("k")
    borders = rows.join(F.broadcast(heads), ["lang", "words"]).select("part", "lang", "words", "a", F.lit(False).alias("own"))
    stream = laid.withColumn("own", F.lit(True)).unionByName(borders).repartition(n, "part").sortWithinPartitions("part", "lang", "words")
    found = map_arrow(stream, _scan, "lang string, words array<string>, a long, parts array<long>, longer long, own boolean")
    merged = found.groupBy("lang", "words").agg(F.max("a").alias("a"), F.max(F.when(F.col("own"), F.col("parts"))).alias("parts"), F.max("longer").alias("longer"))
    return merged.select("lang", F.array_join(F.reverse("words") if suffixes else F.col("words"), " ").alias("phrase"), "a", "parts", "longer")


def _score(l: Column, r: Column) -> Column:
    """floor(1000 a n / (l r)), in 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top, below = (F.lit(1000) * F.col("a")).cast("decimal(19,0)") * wide(F.col("n")), wide(l) * wide(r)
    return ((top - top % below) / below).cast("decimal(38,0)").cast("long")


def collocations(df: DataFrame, longest: int = LONGEST, least: int = MIN_COUNT, top: int = TOP, lang_col: str = "lang", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of 2 to `longest` words with the highest scores in each language.

    A phrase counts wherever its words follow each other within a piece, overlaps included. A null
    text is empty, a null language `und`; repeated rows count as often as they stand. Phrases whose
    words lie in a longer candidate of the same count are left out: an extension by one word decides,
    since those between have the same count. Ties go to the greater count, then to the lesser phrase in
    byte order. Without frequent phrases, and for an empty table, there are no rows.
    """
    docs = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts, totals = phrase_counts(docs, longest, least, max_bits)
    left = part_counts(counts).select("lang", "phrase", "a", F.col("parts").alias("ls"), F.col("longer").alias("right"))
    right = part_counts(counts, suffixes=True).select("lang", "phrase", F.col("parts").alias("rs"), F.col("longer").alias("left"))
    met = left.filter(F.size("ls") > 0).hint("merge").join(right, ["lang", "phrase"])
    met = met.filter((F.col("right") < F.col("a")) & (F.col("left") < F.col("a"))).join(totals, "lang")
    best = None
    for k in range(1, longest):
        l, r = F.get("ls", F.lit(k - 1)), F.get("rs", F.size("rs") - k)
        cut = F.when(F.size("ls") >= k, F.struct(_score(l, r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
        best = cut if best is None else F.least(best, cut)
    scored = met.withColumn("b", best).select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    # Ranks by ranges, so that no language meets in one task.
    ranked = dense_slots(scored.withColumns({"_score": -F.col("score"), "_a": -F.col("a")}), ["lang"], ["_score", "_a", "phrase"], "rank")
    return ranked.filter(F.col("rank") < top).select("lang", (F.col("rank") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS a FROM (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k))
  GROUP BY lang, phrase HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
longer AS (SELECT lang, part, max(a) AS b FROM (SELECT lang, array_to_string(ws[1:k - 1], ' ') AS part, a FROM c UNION ALL SELECT lang, array_to_string(ws[2:k], ' '), a FROM c) GROUP BY lang, part),
kept AS (SELECT c.* FROM c LEFT JOIN longer x ON x.lang = c.lang AND x.part = c.phrase WHERE coalesce(x.b, 0) < c.a),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS lp, array_to_string(ws[cut + 1:k], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, cut, l.a AS l, r.a AS r, t.n, CAST((CAST(1000 AS HUGEINT) * cuts.a * t.n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = cuts.lp JOIN f r ON r.lang = cuts.lang AND r.phrase = cuts.rp JOIN totals t ON t.lang = cuts.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM best QUALIFY rank <= 2000
"""
