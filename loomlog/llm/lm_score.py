"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counts of all unigrams and bigrams of the training texts are summed exactly, in segments of the
hash space. A count c has level 1 + floor(log_base c); an n-gram of level q is entered under
levels 1 to q, and a probe climbs levels until one is missing, so a count is recovered up to its
quantisation from repeated membership probes. Each level and segment has a bit array of its own,
sized to its entries. Filters of up to FILTER_BYTES and a table of exact unigram counts of up to
TABLE_BYTES are broadcast. Where one of them is larger, or the texts are so large that it will be,
nothing is: texts are put into batches, the distinct n-grams of each batch are dealt to segments,
each segment sums counts, makes its filter, probes it for what was asked and deals the levels back
to the batches. Scores are the same.

p(w | v) = (1 - a) min(c(v, w), c(v)) / c(v) + a p(w), with a, by level of c(v), the share of
bigram tokens after such histories that were seen once (Good and Turing); p(w)
is (c(w) + 0.1) / (N + 0.1 (V + 1)) of the recovered count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import id_and_text, map_arrow, texts_of, written

UNIGRAM_BASE, BIGRAM_BASE = 1.25, 2.0
BITS_PER_ENTRY, PROBES = 8, 5
#: Bounds of what is broadcast: each filter, and the exact unigram table.
FILTER_BYTES = {"unigram": 32 << 20, "bigram": 96 << 20}
TABLE_BYTES = 96 << 20
#: Texts of more bytes than this for each byte of the bigram filter's bound are not tried with a broadcast filter; the choice changes no score.
TEXT_BYTES_A_FILTER_BYTE = 12
#: A segment gets n-grams of about so many bytes of text, or fewer: what one task sums at a time.
SEGMENT_TEXT_BYTES = 16 << 20
#: Rows of batches hold megabytes: so many go to a row group, which writers buffer and readers load whole.
BATCH_ROWS = {"parquet.block.row.count.limit": "4", "parquet.page.size.row.check.min": "1"}
#: Tokens gathered in a task before they are counted and sent on.
BATCH_TOKENS = 1_000_000
SCORE_TOKENS = 200_000
END = xxhash.xxh64_intdigest(b"\x20end")
ALPHA = 0.1
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def token_hashes(text: str | None) -> list[int]:
    """XXH64 of the words, A-Z lower-cased, then of one end."""
    out = list(map(xxhash.xxh64_intdigest, (text or "").encode("utf-8", "replace").lower().split()))
    out.append(END)
    return out


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _M1) ^ (b + (a >> np.uint64(31)))
    x *= _M2
    return x ^ (x >> np.uint64(29))


def before(tokens: np.ndarray, lengths: list[int]) -> np.ndarray:
    """The token before each; the end of another text stands before the head of each."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[_heads(lengths)] = END
    return out


def levels_of(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(base) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray, base: float) -> np.ndarray:
    """The middle, in logarithms, of a level's counts; whole numbers recover themselves at low levels."""
    low = np.ceil(np.power(base, levels - 1) - 1e-9)
    high = np.maximum(np.ceil(np.power(base, levels) - 1e-9) - 1, low)
    return np.where(levels > 0, np.sqrt(low * high), 0.0)


def bit_places(hashes: np.ndarray, sizes, level: int) -> Iterator[np.ndarray]:
    """The places of each hash in an array of its size, one probe after another."""
    first, step = mix(hashes, np.full(1, level, np.uint64)), mix(hashes, np.full(1, level + 1000, np.uint64)) | np.uint64(1)
    for i in range(PROBES):
        yield (first + np.uint64(i) * step) % sizes


def level_bits(hashes: np.ndarray, level: int) -> np.ndarray:
    """Bit array of one level and segment holding the hashes, as bytes."""
    size = -(-len(hashes) * BITS_PER_ENTRY // 64) * 64
    bits = np.zeros(size, bool)
    for place in bit_places(hashes, np.uint64(size), level):
        bits[place.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


class LogFilter:
    """Bit arrays by (level, segment) in one buffer, from the lowest held level on."""

    def __init__(self, base: float, segments: int, floor: int, sizes: np.ndarray, bits: np.ndarray):
        """sizes[level - floor, segment] in bits, multiples of 64; bits: their bytes in that order."""
        self.base, self.floor, self.segments = base, floor, segments
        self.sizes, self.bits = sizes.astype(np.uint64), bits
        self.starts = np.concatenate(([0], np.cumsum(sizes.ravel())))[:-1].astype(np.uint64).reshape(sizes.shape)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Level of each hash by probing upwards, zero if it is absent or below the floor."""
        out, at = np.zeros(len(hashes), np.int64), np.arange(len(hashes))
        segment = segment_of(hashes, self.segments)
        for row in range(len(self.sizes)):
            at = at[self.sizes[row, segment[at]] > 0]
            for i in range(PROBES):
                if not len(at):
                    return out
                h, own = hashes[at], segment[at]
                level = self.floor + row
                step = mix(h, np.full(1, level + 1000, np.uint64)) | np.uint64(1)
                place = (mix(h, np.full(1, level, np.uint64)) + np.uint64(i) * step) % self.sizes[row, own] + self.starts[row, own]
                at = at[(self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0]
            out[at] = self.floor + row
        return out


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return (hashes >> np.uint64(65 - segments.bit_length())).astype(np.int64) if segments > 1 else np.zeros(len(hashes), np.int64)


@dataclass
class Model:
    """What workers score with; the filters only if they are broadcast."""

    unigrams: LogFilter | None
    bigrams: LogFilter | None
    backoff: np.ndarray
    tokens: int
    types: int

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ALPHA) / (self.tokens + ALPHA * (self.types + 1))

    def logs(self, words: np.ndarray, history: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """log10 of each token's probability, by the levels of the token, its history and the bigram of both."""
        every = np.arange(256)
        counts = count_of(every, UNIGRAM_BASE)
        past = counts[history]
        share = np.where(every > 0, self.backoff, 1.0)[history]
        return np.log10((1 - share) * np.minimum(count_of(every, BIGRAM_BASE)[pairs], past) / np.maximum(past, 1) + share * self.unigram(counts)[words])


def _gathered(batches: Iterator[pa.RecordBatch], limit: int, pick=None) -> Iterator[tuple[list, np.ndarray, list[int]]]:
    """(rows, tokens, lengths) of texts until their tokens reach the limit; pick says by row which texts count."""
    rows, tokens, lengths, size = [], [], [], 0
    for batch in (b.slice(low, 256) for b in batches for low in range(0, b.num_rows, 256)):
        others = [c.to_pylist() for i, c in enumerate(batch.columns) if i != 1]
        for i, text in enumerate(texts_of(batch.column(1))):
            row = tuple(c[i] for c in others)
            if pick and not pick(row):
                continue
            found = token_hashes(text)
            rows.append(row)
            tokens.append(np.array(found, np.uint64))
            lengths.append(len(found))
            size += len(found)
            if size >= limit:
                yield rows, np.concatenate(tokens), lengths
                rows, tokens, lengths, size = [], [], [], 0
    if rows:
        yield rows, np.concatenate(tokens), lengths


def _counted(docs: DataFrame, segments: int, filters=None) -> DataFrame:
    """(segment, hashes, counts, context) of unigrams, or of bigrams with the level of their history, summed within tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filters.value if filters is not None else None
        for _, tokens, lengths in _gathered(batches, BATCH_TOKENS, pick=lambda row: not row[1]):
            context = np.zeros(0, np.uint8)
            if known is None:
                hashes, counts = np.unique(tokens, return_counts=True)
            else:
                history = before(tokens, lengths)
                hashes, first, counts = np.unique(mix(history, tokens), return_index=True, return_counts=True)
                distinct, place = np.unique(history[first], return_inverse=True)
                context = known.levels(distinct).astype(np.uint8)[place]
            yield pa.RecordBatch.from_pydict(_by_segment(segments, hashes=hashes, counts=counts.astype("<u4"), context=context), _PARTS_ARROW)

    return map_arrow(docs, run, _PARTS)


_PARTS = "segment int, hashes binary, counts binary, context binary"
_PARTS_ARROW = pa.schema([("segment", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("context", pa.binary())])


def _by_segment(segments: int, hashes: np.ndarray, **others: np.ndarray) -> dict[str, list]:
    """Sorted hashes, and what goes with them, cut into the segments that have any."""
    ends = np.searchsorted(segment_of(hashes, segments), np.arange(segments + 1))
    own = [(s, a, b) for s, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
    return {"segment": [s for s, _, _ in own]} | {k: [x[a:b].tobytes() for _, a, b in own] for k, x in {"hashes": hashes, **others}.items()}


def _heads(lengths) -> np.ndarray:
    """The place of each text's first token."""
    return np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)


def _past(distinct: np.ndarray, place: np.ndarray, lengths) -> np.ndarray:
    """The place among the distinct tokens of the token before each."""
    past = np.empty_like(place)
    past[1:] = place[:-1]
    past[_heads(lengths)] = np.searchsorted(distinct, np.uint64(END))
    return past


def _packed(x: np.ndarray) -> bytes:
    """The length, then the array's bytes by place, compressed: of sorted hashes and small counts most places say little."""
    return len(x).to_bytes(8, "little") + pa.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    raw = pa.decompress(data[8:], n * size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(dtype)


def _joined(values, dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *(_unpacked(x, dtype) for x in values)])


#: counts: of the distinct tokens; rank: of each token among them by count, as small numbers take less room than places do.
_BATCH = {"ids": np.int64, "nulls": np.uint8, "held": np.uint8, "lengths": np.int64, "distinct": np.uint64, "counts": np.uint32, "rank": np.int32}
_WORDS = ("held", "lengths", "distinct", "counts", "rank")


def _batches(docs: DataFrame) -> DataFrame:
    """Texts in batches of bounded size, one row each: their distinct tokens and which of them each token is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, (rows, tokens, lengths) in enumerate(_gathered(batches, BATCH_TOKENS)):
            distinct, place, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            rank = np.empty_like(place, shape=len(distinct))
            rank[_by_count(counts)] = np.arange(len(distinct))
            ids, held = zip(*rows)
            values = ([i or 0 for i in ids], [i is None for i in ids], held, lengths, distinct, counts, rank[place])
            yield pa.record_batch([pa.array([task << 32 | k], pa.int64()), *(pa.array([_packed(np.asarray(v).astype(t))], pa.binary()) for v, t in zip(values, _BATCH.values()))], names=["batch", *_BATCH])

    return written(map_arrow(docs, run, "batch long, " + ", ".join(f"{c} binary" for c in _BATCH)), **BATCH_ROWS)


def _opened(value, names: dict) -> list[np.ndarray]:
    """Columns of one batch as arrays; value takes a column's name."""
    return [_unpacked(value(c), t) for c, t in names.items()]


def _by_count(counts: np.ndarray) -> np.ndarray:
    """Places of the distinct tokens, those of high count first."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def _pairs(distinct: np.ndarray, place: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct bigrams, and the place of each token's among them."""
    return np.unique(mix(distinct[past], distinct[place]), return_inverse=True)


def _parts(batches: DataFrame, segments: int) -> DataFrame:
    """(part, batch, hashes, counts): the distinct n-grams of each batch and their counts in its training texts, by segment.

    Unigrams of segment s are part 2 s, bigrams part 2 s + 1.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in found:
            for i in range(x.num_rows):
                held, lengths, distinct, counts, rank = _opened(lambda c: x.column(c)[i].as_py(), {c: _BATCH[c] for c in _WORDS})
                place = _by_count(counts)[rank]
                trains = np.repeat(held == 0, lengths)
                for pairs, (hashes, of) in enumerate(((distinct, place), _pairs(distinct, place, _past(distinct, place, lengths)))):
                    counts = np.bincount(of[trains], minlength=len(hashes)).astype("<u4")
                    ends = np.searchsorted(segment_of(hashes, segments), np.arange(segments + 1))
                    own = [(s, a, b) for s, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
                    columns = [pa.array([2 * s + pairs for s, _, _ in own], pa.int32()), pa.array([x.column("batch")[i].as_py()] * len(own), pa.int64())]
                    columns += [pa.array([_packed(v[a:b]) for _, a, b in own], pa.binary()) for v in (hashes, counts)]
                    yield pa.record_batch(columns, names=["part", "batch", "hashes", "counts"])

    return map_arrow(batches.select("batch", *_WORDS), run, "part int, batch long, hashes binary, counts binary")


_ONCE = np.uint8(128)
_ANSWERED = "batch long, part int, levels binary, counts binary, types long"


def _answered(parts: DataFrame) -> DataFrame:
    """For each part of each batch the levels its n-grams have in the filter of all training texts.

    Unigrams also get their exact counts, and the first row of a part has its number of trained
    unigrams as types; levels of bigrams that were counted once are marked with _ONCE.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        pairs, base = part % 2 == 1, BIGRAM_BASE if part % 2 else UNIGRAM_BASE
        asked = [_unpacked(x, np.uint64) for x in pdf["hashes"]]
        distinct, of = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(of, weights=_joined(pdf["counts"], "<u4")).astype(np.int64)
        trained = total > 0
        entered, levels = distinct[trained], levels_of(total[trained], base)
        bits = [level_bits(entered[levels >= q], q) for q in range(1, int(levels.max(initial=0)) + 1)]
        own = LogFilter(base, 1, 1, np.array([8 * len(b) for b in bits], np.int64).reshape(-1, 1), np.concatenate([np.zeros(0, np.uint8), *bits]))
        found = own.levels(distinct).astype(np.uint8)
        if pairs:
            found |= np.where(total == 1, _ONCE, np.uint8(0))
        cuts = np.cumsum([len(x) for x in asked])[:-1]
        counts = [b""] * len(asked) if pairs else [_packed(x) for x in np.split(total.astype("<u8")[of], cuts)]
        types = np.zeros(len(asked), np.int64)
        types[0] = 0 if pairs else len(entered)
        return pd.DataFrame({"batch": pdf["batch"], "part": part, "levels": [_packed(x) for x in np.split(found[of], cuts)], "counts": counts, "types": types})

    return parts.groupBy("part").applyInPandas(run, _ANSWERED)


#: words and pairs: levels of each token and of the bigram it ends; logs: sums of log10(count + ALPHA); full and once: training tokens by level of their history, all and those of bigrams counted once.
_LEVELLED = {"ids": np.int64, "nulls": np.uint8, "held": np.uint8, "lengths": np.int64, "known": np.int64, "logs": np.float64, "words": np.uint8, "pairs": np.uint8, "full": np.int64, "once": np.int64}


def _levelled(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """Batches with what scores are made of, once the sums over all batches are known: one row each, without n-grams."""

    def run(batch: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        ids, nulls, held, lengths, distinct, often, rank = _opened(lambda c: batch[c].iloc[0], _BATCH)
        place = _by_count(often)[rank]
        found = found.sort_values("part")
        single, pair = found[found["part"] % 2 == 0], found[found["part"] % 2 == 1]
        levels, counts = _joined(single["levels"], np.uint8), _joined(single["counts"], "<u8")
        past = _past(distinct, place, lengths)
        own = _joined(pair["levels"], np.uint8)[_pairs(distinct, place, past)[1]]
        heads, trains = _heads(lengths), np.repeat(held == 0, lengths)
        history = levels[past[trains]]
        logs, known = np.add.reduceat(np.log10(counts + ALPHA)[place], heads), np.add.reduceat((counts > 0)[place].astype(np.int64), heads)
        full, once = np.bincount(history, minlength=256), np.bincount(history[own[trains] >= _ONCE], minlength=256)
        values = (ids, nulls, held, lengths, known, logs, levels[place], own & ~_ONCE, full, once)
        packed = {c: [_packed(v.astype(t))] for (c, t), v in zip(_LEVELLED.items(), values)}
        return pd.DataFrame({"tokens": [int(trains.sum())], "types": [int(found["types"].sum())], **packed})

    schema = "tokens long, types long, " + ", ".join(f"{c} binary" for c in _LEVELLED)
    return written(batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(run, schema), **BATCH_ROWS)


_MERGED = "segment int, kind string, level int, n long, m long, a binary, b binary"


def _merged(parts: DataFrame, base: float, table: bool) -> DataFrame:
    """By segment: the exact table (kind "table"), bit arrays ("bits"), and token masses by history and count level ("mass")."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        segment = int(pdf["segment"].iloc[0])
        hashes = np.frombuffer(b"".join(pdf["hashes"]), np.uint64)
        counts = np.frombuffer(b"".join(pdf["counts"]), "<u4").astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[order], counts[order]
        heads = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        total, hashes = np.add.reduceat(counts, heads), hashes[heads]
        levels = levels_of(total, base)
        rows = [(segment, "table", 0, len(hashes), int(total.sum()), hashes.tobytes() if table else b"", total.astype("<u8").tobytes() if table else b"")]
        if not table:
            context = np.frombuffer(b"".join(pdf["context"]), np.uint8)[order][heads]
            mass = np.bincount(context.astype(np.int64) * 256 + levels, weights=total)
            rows += [(segment, "mass", int(x) >> 8, int(x) & 255, int(mass[x]), b"", b"") for x in np.flatnonzero(mass)]
        for level in range(1, int(levels.max()) + 1):
            held = hashes[levels >= level]
            bits = level_bits(held, level)
            rows.append((segment, "bits", level, 8 * len(bits), len(held), bits.tobytes(), b""))
        return pd.DataFrame(rows, columns=["segment", "kind", "level", "n", "m", "a", "b"])

    return parts.groupBy("segment").applyInPandas(run, _MERGED)


def _filter(merged: DataFrame, base: float, segments: int, limit: int) -> LogFilter | None:
    """All levels put together on the driver; None if they do not fit the limit."""
    sizes = {r["level"]: r["bits"] for r in merged.filter("kind = 'bits'").groupBy("level").agg(F.sum("n").alias("bits")).collect()}
    if sum(sizes.values()) // 8 > limit:
        return None
    shape = np.zeros((max(sizes, default=0), segments), np.int64)
    held = merged.filter("kind = 'bits'")
    for r in held.select("level", "segment", "n").collect():
        shape[r["level"] - 1, r["segment"]] = r["n"]
    starts = np.concatenate(([0], np.cumsum(shape.ravel() // 8)))
    bits = np.zeros(int(starts[-1]), np.uint8)
    for r in held.select("level", "segment", "a").toLocalIterator():
        at = starts[(r["level"] - 1) * segments + r["segment"]]
        bits[at : at + len(r["a"])] = np.frombuffer(r["a"], np.uint8)
    return LogFilter(base, segments, 1, shape, bits)


def _table(merged: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(((r["segment"], r["a"], r["b"]) for r in merged.filter("kind = 'table'").select("segment", "a", "b").toLocalIterator()), key=lambda r: r[0])
    hashes, counts = np.frombuffer(b"".join(r[1] for r in rows), np.uint64), np.frombuffer(b"".join(r[2] for r in rows), "<u8")
    return hashes, counts.astype(np.uint32) if len(counts) and counts.max() < 1 << 32 else counts


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, held_out); a null id counts as the empty text."""
    ids = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return id_and_text(df, id_col, text_col).select("doc_id", "text", (ids % 10 == 0).alias("held_out"))


def _segments(docs: DataFrame) -> tuple[int, int]:
    """Bytes of all texts, and the number of segments: a power of two that follows them, and that all tasks get some of."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return size, 1 << max(4, max(2 * tasks - 1, size // SEGMENT_TEXT_BYTES).bit_length())


def _backoff(once: np.ndarray, full: np.ndarray) -> np.ndarray:
    out = np.ones(256)
    out[full > 0] = np.clip(once[full > 0] / full[full > 0], 0.01, 1.0)
    return out


def train(docs: DataFrame, segments: int, table_bytes: int) -> tuple[Model, DataFrame] | None:
    """The model of the texts that are not held out, and the merged unigrams with their exact counts; None if they do not fit a broadcast."""
    spark = docs.sparkSession
    singles = written(_merged(_counted(docs, segments), UNIGRAM_BASE, table=True))
    types, tokens = (int(x or 0) for x in singles.filter("kind = 'table'").agg(F.sum("n"), F.sum("m")).first())
    unigrams = _filter(singles, UNIGRAM_BASE, segments, FILTER_BYTES["unigram"]) if 16 * types <= table_bytes else None
    if unigrams is None:
        return None
    pairs = written(_merged(_counted(docs, segments, spark.sparkContext.broadcast(unigrams)), BIGRAM_BASE, table=False))
    bigrams = _filter(pairs, BIGRAM_BASE, segments, FILTER_BYTES["bigram"])
    if bigrams is None:
        return None
    mass = np.zeros((256, 256))
    for r in pairs.filter("kind = 'mass'").groupBy("level", "n").agg(F.sum("m").alias("m")).collect():
        mass[r["level"], r["n"]] = r["m"]
    return Model(unigrams, bigrams, _backoff(mass[:, 1], mass.sum(axis=1)), tokens, types), singles


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(docs: DataFrame, model, table) -> DataFrame:
    """Rows with their scores, from broadcast filters and counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, exact = model.value, table.value
        for rows, tokens, lengths in _gathered(batches, SCORE_TOKENS):
            distinct, place = np.unique(tokens, return_inverse=True)
            past, heads, levels = _past(distinct, place, lengths), _heads(lengths), lm.unigrams.levels(distinct)
            score = np.add.reduceat(lm.logs(levels[place], levels[past], lm.bigrams.levels(mix(distinct[past], tokens))), heads)
            at = np.minimum(np.searchsorted(exact[0], distinct), max(len(exact[0]) - 1, 0))
            own = np.where(exact[0][at] == distinct, exact[1][at], 0).astype(np.int64) if len(exact[0]) else np.zeros(len(distinct), np.int64)
            base, known = np.add.reduceat(np.log10(lm.unigram(own))[place], heads), np.add.reduceat((own > 0)[place].astype(np.int64), heads)
            ids, held = zip(*rows)
            columns = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(lengths, pa.int64()), pa.array(known), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
            yield pa.record_batch(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return map_arrow(docs, run, _SCORED)


def _masses(levelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens by level of their history: those of bigrams counted once, and all."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, full = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for x in found:
            for a, b in zip(x.column("once").to_pylist(), x.column("full").to_pylist()):
                once, full = once + _unpacked(a, np.int64), full + _unpacked(b, np.int64)
        at = np.flatnonzero(full)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(once[at]), pa.array(full[at])], names=["level", "once", "full"])

    once, full = np.zeros(256), np.zeros(256)
    for r in map_arrow(levelled.select("once", "full"), run, "level int, once long, full long").groupBy("level").agg(F.sum("once").alias("once"), F.sum("full").alias("full")).collect():
        once[r["level"]], full[r["level"]] = r["once"], r["full"]
    return once, full


def _scored_batches(levelled: DataFrame, lm: Model) -> DataFrame:
    """What _scored gives, where filters are not broadcast."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in found:
            for i in range(x.num_rows):
                ids, nulls, held, lengths, known, logs, words, pairs = _opened(lambda c: x.column(c)[i].as_py(), _TO_SCORE)
                heads, history = _heads(lengths), np.roll(words, 1)
                history[heads] = words[-1]  # of the end, which is the last token of each text
                score = np.add.reduceat(lm.logs(words, history, pairs), heads)
                base = logs - lengths * np.log10(lm.tokens + ALPHA * (lm.types + 1))
                columns = [pa.array(ids, mask=nulls != 0), pa.array(held != 0), pa.array(lengths), pa.array(known), pa.array(base), pa.array(score)]
                yield pa.record_batch(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return map_arrow(levelled.select(*_TO_SCORE), run, _SCORED)


_TO_SCORE = {c: t for c, t in _LEVELLED.items() if c not in ("full", "once")}


def _dealt(docs: DataFrame, segments: int) -> tuple[DataFrame, int]:
    """Scored rows and the number of training tokens, with no filter or table of counts in one place."""
    batches = _batches(docs)
    levelled = _levelled(batches, _answered(_parts(batches, segments)))
    tokens, types = (int(x or 0) for x in levelled.agg(F.sum("tokens"), F.sum("types")).first())
    return _scored_batches(levelled, Model(None, None, _backoff(*_masses(levelled)), tokens, types)), tokens


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    The model learns from rows that are not held out. Null and empty texts are one end token;
    null ids are held out; repeated rows train and are scored each. An empty table gives no rows,
    and without a training text every probability is one.
    """
    spark, docs = df.sparkSession, _rows(df, id_col, text_col)
    size, segments = _segments(docs)
    small = size <= TEXT_BYTES_A_FILTER_BYTE * FILTER_BYTES["bigram"]
    trained = train(docs, segments, TABLE_BYTES if table_bytes is None else table_bytes) if small else None
    if trained is None:
        out, tokens = _dealt(docs, segments)
    else:
        model, singles = trained
        out, tokens = _scored(docs, spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(_table(singles))), model.tokens
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
