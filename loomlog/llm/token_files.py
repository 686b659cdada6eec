"""Token ids as Simple-8b blocks: 64-bit words whose top four bits select how many ids they pack.

A table of blocks, one row each, in Parquet: `part` and `block` give the order, `first` the ids
of the part before the block; `words` holds little-endian 64-bit words; `doc_ids` and `ends` the documents of the block and where their ids
end in it; `n_ids` cuts the last word's padding; `escapes` the places of raw words. Selectors,
counts and raw places give every id's place without reading words one after another, so
decoding is vectorised.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.llm.common import id_and_text, map_arrow, scratch_dir, texts_of
from loomlog.llm.tokenfiles import once, public_path, shared_file

#: Selector s > 0 packs COUNTS[s] ids of 60 // COUNTS[s] bits; selector 0: the next word is one raw id.
COUNTS = [0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
BLOCK_IDS = 1 << 16
MEMO_WORDS, MEMO_CHARS, GROUP_WORDS = 700_000, 48, 2000
#: Text bytes of documents that are encoded together.
GROUP_BYTES = 8 << 20
BLOCK_SCHEMA = "part int, block long, first long, doc_ids array<long>, ends array<long>, n_ids long, escapes array<int>, words binary"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and the places of raw ones. Each word takes as many ids as the widest of them allows."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    top, low = int(ids.max()), int(ids.min())
    limit = np.uint32 if not top >> 32 else np.uint64
    values = ids.astype(limit)
    take, select = np.zeros(n, np.int64), np.zeros(n, np.int8)
    open_ = np.ones(n, bool)
    for s in range(1, 15):
        bits = 60 // COUNTS[s]
        if low >> bits:
            continue
        if limit is np.uint32 and bits >= 32:
            take[open_], select[open_] = COUNTS[s], s
            open_[:] = False
            break
        narrow = values < limit(1 << bits)
        if int(np.count_nonzero(narrow)) < min(COUNTS[s], n):
            continue
        wide = np.zeros(n + COUNTS[s], np.int32)
        np.cumsum(~narrow, out=wide[1 : n + 1], dtype=np.int32)
        wide[n + 1 :] = wide[n]
        fits = open_ & (wide[COUNTS[s] :] == wide[:n])
        take[fits], select[fits] = COUNTS[s], s
        open_ &= ~fits
        if not top >> bits:
            break
    take[open_] = 1  # escapes
    jumps, starts, at = take.tolist(), [], 0
    while at < n:
        starts.append(at)
        at += jumps[at]
    starts = np.array(starts)
    chosen = select[starts]
    places = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(chosen == 0)[:-1]))
    words = np.zeros(len(starts) + int((chosen == 0).sum()), np.uint64)
    padded = np.concatenate((ids, np.zeros(60, np.uint64)))
    for s in np.unique(chosen).tolist():
        own = chosen == s
        if s == 0:
            words[places[own] + 1] = ids[starts[own]]
            continue
        count, bits = COUNTS[s], 60 // COUNTS[s]
        lanes = np.arange(count)
        words[places[own]] = np.bitwise_or.reduce(padded[starts[own][:, None] + lanes] << (lanes * bits).astype(np.uint64), axis=1) | np.uint64(s << 60)
    return words, (places[chosen == 0] + 1).astype(np.int32)


def unpack(words: np.ndarray, n_ids: int, escapes: np.ndarray) -> np.ndarray:
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS + [0], np.int64)[selectors]
    counts[escapes] = 1
    selectors[escapes] = -1
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(selectors).tolist():
        own = selectors == s
        starts = ends[own] - counts[own]
        if s == -1:
            out[starts] = words[own]
        elif s > 0:
            bits = 60 // COUNTS[s]
            lanes = np.arange(COUNTS[s])
            out[starts[:, None] + lanes] = (words[own][:, None] >> (lanes * bits).astype(np.uint64)) & np.uint64((1 << bits) - 1)
    return out[:n_ids]


class WordIds(dict):
    """Words, as UTF-8 bytes -> ids of a tokenizers file, as little-endian 32-bit bytes.

    If the file never joins text across ASCII white space, only new words are encoded, many at
    once, and kept in a bounded memo of two turns. If it also lower-cases, splits letters from
    stops and commas and marks word ends, a Latin word with a mark takes the ids of its letters
    and of the mark, and its letters skip the file's normaliser and splitter. Both are tried out
    on the file; any other file encodes whole texts.
    """

    def __init__(self, data: bytes):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.older = Tokenizer.from_str(data.decode()), {}
        self.letters = Tokenizer.from_str(data.decode())
        self.letters.normalizer, self.letters.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        whole, parts = self.plain([" ".join(_PROBES), " \t\n" + "\r ".join(_PROBES)]), self.plain(_PROBES)
        self.by_word = whole == [b"".join(parts)] * 2
        self.marks = pa.array([b"", *self.plain([".", ","])], pa.large_binary())
        self.by_stem = self.by_word and bool(suffix)
        self.by_stem = self.by_stem and self.of_distinct(pa.array(_PROBES, pa.large_string())).to_pylist() == parts
        self.clear()

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(found.ids, "<u4").tobytes() for found in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def of_letters(self, stems: list[bytes]) -> list[bytes]:
        """Ids of words of lower-case Latin letters; each ends with its only token that marks a word's end."""
        out: list[bytes] = []
        groups = [stems[i : i + GROUP_WORDS] for i in range(0, len(stems), GROUP_WORDS)]
        for group, found in zip(groups, self.letters.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = (4 * (1 + np.flatnonzero(self.ends[ids]))).tolist()
            if len(ends) != len(group):
                out.extend(self.plain([w.decode() for w in group]))
                continue
            data = ids.tobytes()
            out.extend(map(data.__getitem__, map(slice, [0, *ends], ends)))
        return out

    def of_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of any words, encoded together with spaces between."""
        out: list[bytes] = []
        texts = [w.decode("utf-8", "replace") for w in words]
        groups = [texts[i : i + GROUP_WORDS] for i in range(0, len(texts), GROUP_WORDS)]
        for group, found in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4").tobytes()
            starts = np.cumsum([0, *(len(w) + 1 for w in group)])
            ends = (4 * np.searchsorted(np.array([a for a, _ in found.offsets], np.int64), starts)).tolist()
            out.extend(map(ids.__getitem__, map(slice, ends, ends[1:])))
        return out

    def looked_up(self, distinct: pa.Array, encode: Callable[[list[bytes]], list[bytes]]) -> pa.Array:
        """Ids of distinct words or stems; what neither turn of the memo holds is encoded, all at once."""
        keys = distinct.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        if len(self) >= MEMO_WORDS:
            self.older = dict(self)
            self.clear()
        found = list(map(self.get, keys))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            held = list(map(self.older.get, [keys[i] for i in missing]))
            new = [i for i, ids in zip(missing, held) if ids is None]
            for i, ids in chain(zip(missing, held), zip(new, encode([keys[i] for i in new]))):
                found[i] = ids
            self.update([(keys[i], found[i]) for i in missing if len(keys[i]) <= MEMO_CHARS])
        return pa.array(found, pa.large_binary())

    def of_distinct(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words, which are not empty."""
        if not self.by_stem:
            return self.looked_up(words, self.of_words)
        plain = pc.match_substring_regex(words, _LATIN)
        others = self.looked_up(words.filter(pc.invert(plain)), self.of_words)
        low = pc.utf8_lower(words.filter(plain))
        mark = pc.add(pc.ends_with(low, ".").cast(pa.int8()), pc.multiply(pc.ends_with(low, ",").cast(pa.int8()), pa.scalar(2, pa.int8())))
        stems = pc.if_else(pc.equal(mark, 0), low, pc.utf8_slice_codeunits(low, 0, -1)).dictionary_encode()
        ids = pc.binary_join_element_wise(self.looked_up(stems.dictionary, self.of_letters).take(stems.indices), self.marks.take(mark), pa.scalar(b"", pa.large_binary()))
        place = np.where(plain_at := plain.to_numpy(zero_copy_only=False), np.cumsum(plain_at) - 1, len(ids) + np.cumsum(~plain_at) - 1)
        return pa.concat_arrays([ids, others]).take(pa.array(place))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each; null and empty texts have none."""
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            texts = pa.array(texts_of(texts), pa.large_string())
        if not self.by_word:
            parts = self.plain(texts_of(texts))
            return np.frombuffer(b"".join(parts), "<u4"), np.array([len(p) // 4 for p in parts], np.int64)
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        bounds = split.offsets.to_numpy()
        coded = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        words = coded.dictionary
        filled = pc.if_else(pc.equal(words, ""), "a", words)  # white space at an end of a text leaves an empty word
        parts = pc.if_else(pc.equal(words, ""), pa.scalar(b"", pa.large_binary()), self.of_distinct(filled))
        taken = parts.take(coded.indices)
        after = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) // 4
        ids = np.frombuffer(taken.buffers()[2] or b"", "<u4")[: after[-1]]
        return ids, np.diff(after[bounds - bounds[0]])


#: A word of letters below U+0100 with a stop, a comma or nothing behind it.
_LATIN = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,]?$"
#: Tried out on a file before words are taken one by one.
_PROBES = ["Word", "word", "word.", "Word,", "WORDS", "a", "b,", "it's", "(x)", "3rd", "é", "ÉA", "end."]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about GROUP_BYTES of text, or one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, GROUP_BYTES + (ends[low - 1] if low else 0), "right")))
            yield batch.slice(low, high - low)
            low = high


def write_token_files(df: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts (null: empty), append end_id to each, and write blocks in ascending id order.

    Null ids come first; rows with the same id follow each other by text. Documents are not split
    over blocks, so a block has about BLOCK_IDS ids or one longer document.
    """
    name = tokenizer_path or public_path("word_bpe_49k.json")
    shared = shared_file(df.sparkSession, name)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = id_and_text(df, id_col, text_col).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(200_000, 50, 100)  # tables of many small objects that live as long as the worker
        words = once("word_ids", name, lambda: WordIds(shared.value))
        ids, chunks, ends, size, block, part, first = [], [], [], 0, 0, 0, 0

        def block_rows() -> pa.RecordBatch:
            data = np.concatenate(chunks)
            packed, raw = pack(data)
            row = {"part": part, "block": block, "first": first, "doc_ids": ids, "ends": ends, "n_ids": len(data), "escapes": raw.tolist(), "words": packed.astype("<u8").tobytes()}
            fields = [("part", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("escapes", pa.list_(pa.int32())), ("words", pa.binary())]
            return pa.RecordBatch.from_pylist([row], schema=pa.schema(fields))

        for piece in _grouped(batches):
            part = piece.column(2)[0].as_py()
            found, sizes = words.encode(piece.column(1))
            found = np.insert(found, np.cumsum(sizes), np.uint32(end_id))
            at = taken = 0
            for doc, n in zip(piece.column(0).to_pylist(), (sizes + 1).tolist()):
                at += n
                size += n
                ids.append(doc)
                ends.append(size)
                if size >= BLOCK_IDS:
                    chunks.append(found[taken:at])
                    yield block_rows()
                    taken = at
                    ids, chunks, ends, size, block, first = [], [], [], 0, block + 1, first + size
            chunks.append(found[taken:])
        if ids:
            yield block_rows()

    map_arrow(laid, run, BLOCK_SCHEMA, holds=True).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start long, n_tokens long, ids binary: little-endian unsigned 32-bit) of each document written.

    start counts the ids of all documents before it: a block knows those of its part, and the
    totals of the parts (a row for each, broadcast) are summed up.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = blocks.join(F.broadcast(before), "part").withColumn("start", F.col("_before") + F.col("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(batch.num_rows):
                row = batch.slice(low, 1).to_pylist()[0]
                ids = unpack(np.frombuffer(row["words"], "<u8"), row["n_ids"], np.array(row["escapes"], np.int64)).astype("<u4")
                edges = [0, *row["ends"]]
                cut = [ids[a:b].tobytes() for a, b in zip(edges, edges[1:])]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["start"] + a for a in edges[:-1]], pa.int64()), pa.array([b - a for a, b in zip(edges, edges[1:])], pa.int64()), pa.array(cut, pa.binary())]
                yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids"])

    return map_arrow(placed.select("doc_ids", "ends", "n_ids", "escapes", "words", "start"), run, "doc_id long, start long, n_tokens long, ids binary")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
