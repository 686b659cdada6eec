"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

A token sequence is the BPE encoding of its bytes exactly if each neighbouring pair encodes to
itself, so a nondeterministic transducer whose states are (last token, place in the token trie)
accepts the right encoding alone. Its subset construction runs on demand: a state holds, for
each place where the current token may have begun, the last token, the trie node and the tokens
not yet emitted. What all of them agree on is emitted, so output lags by a bounded lookahead of
about the longest token, and time is linear in the text.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from loomlog.llm.common import id_and_text, map_arrow, texts_of
from loomlog.llm.tokenfiles import once, public_path, ranks_of, shared_file

MEMO_PIECES, MEMO_CHARS, MAX_STATES, MAX_PAIRS = 130_000, 48, 45_000, 250_000
DECODE_STEP = 4096
#: Unicode white space; \s of the regex library also takes the separators U+001C to U+001F.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with \\s as Unicode's White_Space property, inside and outside of classes."""
    out = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
    return regex.compile(out)


class Node:
    """A place in the token trie; token is the one that ends here."""

    __slots__ = ("kids", "token")

    def __init__(self):
        self.kids, self.token = {}, None


class State:
    """configs are (last token, trie node, tokens not yet emitted), in the order of where the current token began."""

    __slots__ = ("configs", "final", "next")

    def __init__(self, configs: tuple):
        self.configs, self.next = configs, {}
        self.final = configs[-1][2]


class Transducer:
    """Bytes of one piece in, token ids out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.root = Node()
        for token, rank in ranks.items():
            node = self.root
            for byte in token:
                node = node.kids.get(byte) or node.kids.setdefault(byte, Node())
            node.token = rank
        self.pairs: dict[int, bool] = {}
        self.made_of: dict[int, tuple[int, int] | None] = {}
        self.states: dict[tuple, State] = {}
        self.start = self.state(((None, self.root, ()),))

    def state(self, configs: tuple) -> State:
        found = self.states.get(configs)
        if found is None:
            found = self.states[configs] = State(configs)
        return found

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one, None for a single byte."""
        found = self.made_of.get(token, 0)
        if found == 0:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                _, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = self.made_of[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 and all(p in self.ranks for p in parts) else None
        return found

    def follows(self, last: int | None, token: int) -> bool:
        """Whether the token may stand after the last one (None: at the start).

        Merges of both are undone from the last made on. The pair is wrong if at some time the
        pieces on both sides of the border would have merged before the merge just undone; of
        equal ranks the one further left comes first.
        """
        if last is None:
            return True
        key = last << 32 | token
        ok = self.pairs.get(key)
        if ok is None:
            left, right, limit, get, text = last, token, 1 << 60, self.ranks.get, self.bytes_of
            ok = True
            while True:
                if get(text[left] + text[right], limit) < limit:
                    ok = False
                    break
                undo_left, undo_right = self.halves(left), self.halves(right)
                if undo_left and (left > right or not undo_right):
                    limit, left = left, undo_left[1]
                elif undo_right:
                    limit, right = right + 1, undo_right[0]
                else:
                    break
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            self.pairs[key] = ok
        return ok

    def advance(self, configs: tuple | list, byte: int) -> tuple[tuple, list]:
        """Tokens to emit and the next configurations. Exactly one token may end here, since encodings are unique."""
        live, pairs, border = [], self.pairs, None
        for last, node, pending in configs:
            node = node.kids.get(byte)
            if node is None:
                continue
            token = node.token
            if token is not None and border is None:
                ok = last is None or pairs.get(last << 32 | token)
                if ok is None:
                    ok = self.follows(last, token)
                if ok:
                    border = (token, self.root, pending + (token,))
            if node.kids:
                live.append((last, node, pending))
        live.append(border)
        shared = live[0][2]
        if not shared:
            return shared, live
        for _, _, pending in live:
            n = min(len(shared), len(pending))
            while shared[:n] != pending[:n]:
                n -= 1
            shared = shared[:n]
        cut = len(shared)
        return shared, [(last, node, pending[cut:]) for last, node, pending in live] if cut else live

    def encode(self, piece: bytes) -> list[int]:
        """Known states are followed; new ones are kept up to MAX_STATES, beyond that only passed through."""
        out: list[int] = []
        state = self.start
        for i, byte in enumerate(piece):
            move = state.next.get(byte)
            if move is None:
                if len(self.states) >= MAX_STATES:
                    configs: tuple | list = state.configs
                    for late in piece[i:]:
                        emitted, configs = self.advance(configs, late)
                        out.extend(emitted)
                    out.extend(configs[-1][2])
                    return out
                emitted, configs = self.advance(state.configs, byte)
                move = state.next[byte] = (emitted, self.state(tuple(configs)))
            emitted, state = move
            if emitted:
                out.extend(emitted)
        out.extend(state.final)
        return out


class Encoder(dict):
    """Pieces of the pattern -> their ids as little-endian 32-bit bytes; a bounded memo in front of the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.machine, self.split, self.older = ranks, Transducer(ranks), splitter(pattern), {}
        self.table = token_table(ranks)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_PIECES:  # what was used since the last turn stays within reach
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is not None:
            self[piece] = ids
            return ids
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        ids = np.array([whole] if whole is not None else self.machine.encode(data), "<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split.findall(text)))


def decode_stream(chunks: Iterable[bytes], token_bytes: list[bytes]) -> Iterator[str]:
    """Text of ids given in chunks, as soon as characters are complete.

    The incremental UTF-8 decoder keeps the bytes of an unfinished character between chunks;
    bytes that are no UTF-8, and ids outside the vocabulary, become U+FFFD.
    """
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for chunk in chunks:
        ids = np.frombuffer(chunk, "<u4").tolist()
        try:
            yield decoder.decode(b"".join(map(token_bytes.__getitem__, ids)))
        except IndexError:
            yield decoder.decode(b"".join(token_bytes[i] if i < len(token_bytes) else b"\xff" for i in ids))
    yield decoder.decode(b"", True)


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    table = [b"\xff"] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _encoder(path: str, pattern: str, shared) -> Encoder:
    gc.set_threshold(200_000, 50, 100)  # tables of many small objects that live as long as the stage
    return once("bpe", (path, pattern), lambda: Encoder(ranks_of(shared.value), pattern))


def _decoded(ids: bytes, table: list[bytes]) -> Iterator[str]:
    step = 4 * DECODE_STEP
    return decode_stream((ids[i : i + step] for i in range(0, len(ids), step)), table)


def _by_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that what is made of them needs bounded memory beside one long text."""
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            yield batch.slice(low, 256)


def encode_texts(df: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens long, ids binary: little-endian unsigned 32-bit), one row per input row; null encodes as empty.

    Bytes that are no UTF-8 count as U+FFFD.
    """
    path, pattern = ranks_path or public_path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    shared = shared_file(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern, shared)
        for part in _by_rows(batches):
            ids = [encoder.encode(x) for x in texts_of(part.column(1))]
            yield pa.record_batch([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return map_arrow(id_and_text(df, id_col, text_col), run, "doc_id long, n_tokens long, ids binary", holds=True)


def decode_ids(df: DataFrame, ranks_path: str | None = None, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """Add the text of a column of ids (little-endian unsigned 32-bit), decoded in steps; null ids give an empty text."""
    path = ranks_path or public_path("byte_bpe_50k.tiktoken")
    shared = shared_file(df.sparkSession, path)
    kept = df.drop(out)
    at = kept.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = once("bpe_table", path, lambda: token_table(ranks_of(shared.value)))
        for part in _by_rows(batches):
            texts = ["".join(_decoded(x.as_py() or b"", table)) for x in part.column(at)]
            yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return map_arrow(kept, run, f"{fields}, `{out}` string", holds=True)


def round_trip_digests(df: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoding each text and decoding its ids.

    Both directions run in one pass over the texts, in one worker per task; ids and decoded
    texts are digested where they are made and never travel.
    """
    path, pattern = ranks_path or public_path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    shared = shared_file(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern, shared)
        for part in _by_rows(batches):
            sizes, ids_digests, text_digests = [], [], []
            for text in texts_of(part.column(1)):
                ids, decoded = encoder.encode(text), hashlib.sha256()
                for piece in _decoded(ids, encoder.table):
                    decoded.update(piece.encode())
                sizes.append(len(ids) // 4)
                ids_digests.append(hashlib.sha256(ids).hexdigest())
                text_digests.append(decoded.hexdigest())
            yield pa.record_batch([part.column(0), pa.array(sizes, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(id_and_text(df, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", holds=True)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
