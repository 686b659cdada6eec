"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Windows as long as each item, at every start, slide over a document's five-word shingles. Their
64-bit fingerprints are split into four 16-bit blocks; two fingerprints within RADIUS = 19 bits
agree in some block up to four bits, so posting lists of items by block value, read at every value
within four bits, give every item within the radius. Candidates are verified by weighted Jaccard
similarity of shingle multisets, the best window first.

Two windows of n shingles with similarity t share at least 2 n t / (1 + t) of them, so windows
with fewer shingles of items of their length are passed over unhashed; that loses nothing, and
leaves hardly a window of a clean document.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from loomlog.llm.common import id_and_text, map_arrow, texts_of
from loomlog.llm.tokenfiles import once

SHINGLE, SIMILARITY, RADIUS, BLOCK_RADIUS = 5, 0.8, 19, 4
#: Benchmark texts broadcast at once; a larger benchmark is searched in several passes. Workers hold about five times as much.
PASS_BYTES = 8 << 20
#: Words of documents put together for one round of array operations, and windows hashed at once.
BATCH_WORDS, WINDOWS = 1 << 16, 1 << 12
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
#: All 16-bit values with up to BLOCK_RADIUS bits.
_FLIPS = np.array([sum(1 << i for i in c) for k in range(BLOCK_RADIUS + 1) for c in combinations(range(16), k)], np.uint16)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of five words."""
    n = len(hashes) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = (out ^ hashes[i : i + n]) * _MIX[i]
        out ^= out >> np.uint64(29)
    return out


def fingerprints(grams: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each window of `size` shingles."""
    bits = np.unpackbits(grams.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    running = np.zeros((len(grams) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=running[1:])
    ones = running[size:] - running[:-size]
    return np.packbits(2 * ones > size, axis=1, bitorder="little").view(np.uint64).ravel()


def least_shared(window: int, item: int) -> int:
    """Shingles that a window and an item must share for their similarity to reach SIMILARITY."""
    return int(np.ceil(SIMILARITY * (window + item) / (1 + SIMILARITY) - 1e-9))


class Blocks:
    """Items of one length, listed by the value of each 16-bit block of their fingerprints."""

    def __init__(self, members: np.ndarray, prints: np.ndarray):
        self.members, self.prints = members, prints
        self.lists = []
        for b in range(4):
            values = (prints >> np.uint64(16 * b)).astype(np.uint16)
            order = np.argsort(values, kind="stable")
            distinct, starts = np.unique(values[order], return_index=True)
            self.lists.append((distinct, np.append(starts, len(order)), order))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, member) pairs within the radius."""
        found = []
        for b, (distinct, starts, order) in enumerate(self.lists):
            values = (prints >> np.uint64(16 * b)).astype(np.uint16)
            step = max(1, (1 << 20) // min(len(distinct), len(_FLIPS)))
            for low in range(0, len(values), step):
                part = values[low : low + step]
                if len(distinct) <= len(_FLIPS):
                    window, place = np.nonzero(np.bitwise_count(part[:, None] ^ distinct) <= BLOCK_RADIUS)
                else:
                    wanted = part[:, None] ^ _FLIPS
                    at = np.minimum(np.searchsorted(distinct, wanted), len(distinct) - 1)
                    window, hit = np.nonzero(distinct[at] == wanted)
                    place = at[window, hit]
                counts = starts[place + 1] - starts[place]
                inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                found.append(np.repeat(window + low, counts).astype(np.int64) << 32 | order[np.repeat(starts[place], counts) + inside])
        pairs = np.unique(np.concatenate(found))
        window, member = pairs >> 32, pairs & 0xFFFFFFFF
        close = np.bitwise_count(prints[window] ^ self.prints[member]) <= RADIUS
        return window[close], self.members[member[close]]


class Items:
    """Benchmark items: their shingle multisets, block lists by length, and which lengths each shingle belongs to."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.sizes, self.weights, prints = [], [], [], []
        for item_id, text in items:
            grams = shingles(word_hashes(words_of(text)))
            if len(grams):
                self.ids.append(item_id)
                self.sizes.append(len(grams))
                self.weights.append(np.unique(grams, return_counts=True))
                prints.append(fingerprints(grams, len(grams))[0])
        sizes, own = np.unique(np.array(self.sizes, np.int64), return_inverse=True)
        self.lengths, prints = sizes.tolist(), np.array(prints, np.uint64)
        self.blocks = [Blocks(np.flatnonzero(own == g), prints[own == g]) for g in range(len(sizes))]
        pairs = sorted({(g, w) for g, (grams, _) in zip(own.tolist(), self.weights) for w in grams.tolist()}, key=lambda x: (x[1], x[0]))
        self.groups = np.array([g for g, _ in pairs], np.int32)
        self.keys, starts = np.unique(np.array([w for _, w in pairs], np.uint64), return_index=True)
        self.starts = np.append(starts, len(pairs))
        #: Whether any shingle has these leading bits.
        self.shift = np.uint64(64 - min(22, max(10, len(pairs).bit_length() + 4)))
        self.some = np.zeros(1 << 64 - int(self.shift), bool)
        self.some[(self.keys >> self.shift).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, group): shingles that items of a group have."""
        place = np.flatnonzero(self.some[(grams >> self.shift).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, grams[place]), max(len(self.keys) - 1, 0))
        known = self.keys[at] == grams[place]
        place, at = place[known], at[known]
        counts = self.starts[at + 1] - self.starts[at]
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(place, counts), self.groups[np.repeat(self.starts[at], counts) + inside]

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of two shingle multisets."""
        (own, n), (grams, counts) = self.weights[item], np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(own, grams), len(own) - 1)
        shared = int(np.minimum(n[at], counts)[own[at] == grams].sum())
        return shared / (len(window) + self.sizes[item] - shared)


def dense_starts(places: np.ndarray, size: int, need: int, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Runs [low, high] of starts between first and last whose window of `size` has `need` of the places, in pieces of up to WINDOWS."""
    tail = places[need - 1 :]
    head = places[: len(tail)]
    fits = tail - head < size
    lows, highs = np.maximum(tail[fits] - size + 1, first), np.minimum(head[fits], last)
    lows, highs = lows[lows <= highs], highs[lows <= highs]
    if len(lows):
        cut = np.flatnonzero(lows[1:] > np.maximum.accumulate(highs)[:-1] + 1) + 1
        for run_low, run_high in zip(lows[np.append(0, cut)].tolist(), np.maximum.reduceat(highs, np.append(0, cut)).tolist()):
            for low in range(run_low, run_high + 1, WINDOWS):
                yield low, min(low + WINDOWS - 1, run_high)


def search(texts: list[str], items: Items) -> Iterator[tuple[int, int, float, int, int]]:
    """(text index, item id, similarity, first word, words) of the best window of each contaminated (text, item); of equal ones the first."""
    split = [(i, w) for i, w in ((i, words_of(t)) for i, t in enumerate(texts)) if len(w) >= SHINGLE]
    if not split or not items.ids:
        return
    grams = shingles(word_hashes([x for _, w in split for x in w]))
    bounds = np.concatenate(([0], np.cumsum([len(w) for _, w in split])))
    place, group = items.hits(grams)
    doc = np.searchsorted(bounds, place, "right") - 1
    inside = place <= bounds[doc + 1] - SHINGLE  # runs of words over the end of a text are none of its shingles
    place, code = place[inside], group[inside].astype(np.int64) * len(split) + doc[inside]
    order = np.argsort(code, kind="stable")
    place, (codes, starts, counts) = place[order], np.unique(code[order], return_index=True, return_counts=True)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for c, start, count in zip(codes.tolist(), starts.tolist(), counts.tolist()):
        g, k = divmod(c, len(split))
        first, n = int(bounds[k]), len(split[k][1]) - SHINGLE + 1
        size = min(items.lengths[g], n)  # a text shorter than an item is one window
        need = least_shared(size, items.lengths[g])
        if count < need or need > size:
            continue
        tries = defaultdict(list)
        for low, high in dense_starts(place[start : start + count], size, need, first, first + n - size):
            windows, members = items.blocks[g].near(fingerprints(grams[low : high + size], size))
            for item in np.unique(members).tolist():
                known = np.isin(grams[low : high + size], items.weights[item][0])
                held = np.concatenate(([0], np.cumsum(known)))
                at = windows[members == item]
                tries[item] += zip((held[at + size] - held[at]).tolist(), (-low - at).tolist())
        for item, own in tries.items():
            key, top = (split[k][0], items.ids[item]), (0.0, 0, 0)
            for most, start_at in sorted(own, reverse=True):  # most shingles in common first
                if most < need or most / (size + items.lengths[g] - most) < top[0]:
                    break
                value = items.similarity(grams[-start_at : -start_at + size], item)
                if value >= SIMILARITY:
                    top = max(top, (value, start_at + first, size + SHINGLE - 1))
            if top[0]:
                best[key] = max(best.get(key, top), top)
    for (i, item_id), (value, start, n) in best.items():
        yield i, item_id, value, -start, n


def find_contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity double, start_word long, n_words long), a row for each input row and item found in it.

    A document no longer than an item is one window. Items and documents of fewer than five words,
    null and empty ones included, match nothing. Items with a null id are reported under null;
    repeated rows are reported each. Without an item, or without a document, the result is empty.
    """
    spark, out = df.sparkSession, None
    schema = "doc_id long, item_id long, similarity double, start_word long, n_words long"
    docs = id_and_text(df, id_col, text_col)
    for part in _passes(id_and_text(benchmark, item_col, item_text_col)):
        found = _search_pass(docs, spark.sparkContext.broadcast(part), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in groups of bounded size; only one group at a time is held by the driver."""
    held, size = [], 0
    for row in benchmark.filter("text is not null").toLocalIterator():
        held.append((row["doc_id"], row["text"]))
        size += len(row["text"])
        if size >= PASS_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _found(column: pa.Array, items: Items) -> Iterator[tuple]:
    """(row, *what search finds in it), in rounds of bounded size."""
    texts, low, size = texts_of(column), 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= 6 * BATCH_WORDS or i == len(texts) - 1:
            for k, *found in search(texts[low : i + 1], items):
                yield (low + k, *found)
            low, size = i + 1, 0


def _search_pass(docs: DataFrame, shared, schema: str) -> DataFrame:
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = once("items", key, lambda: Items(shared.value))
        for batch in batches:
            rows = [(batch.column(0)[k].as_py(), *found) for k, *found in _found(batch.column(1), items)]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

    return map_arrow(docs, run, schema, holds=True)


def _clean_pass(df: DataFrame, at: int, shared) -> DataFrame:
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = once("items", key, lambda: Items(shared.value))
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[k for k, *_ in _found(batch.column(at).cast(pa.string()), items)]] = False
            yield batch.filter(pa.array(clean))

    return map_arrow(df, run, df.schema, holds=True)


def clean_documents(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of df in whose text no item is found, all columns kept.

    Each row is judged by its own text, whatever its id.
    """
    out, at = df, df.columns.index(text_col)
    for part in _passes(id_and_text(benchmark, "item_id")):
        out = _clean_pass(out, at, df.sparkSession.sparkContext.broadcast(part))
    return out


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
