"""Token counts by count-only Viterbi search over a unigram piece vocabulary.

Aho-Corasick enumerates the vocabulary matches that end at each character; the dynamic program
carries only the best score and its piece count, no back pointers. Ties go to the match that
starts first, as in the tokenizers library's Unigram model, whose scores are doubles too.

The box holds no unigram model; the pieces and scores of piece_bpe_32k.model are read as one.
Its scores are whole numbers, so sums are exact in any order, and no piece has a word mark
after another character, so texts split at word marks without changing the best path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomlog.llm.common import id_and_text, map_arrow, texts_of
from loomlog.llm.tokenfiles import once, public_path

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MEMO_WORDS, MEMO_CHARS = 400_000, 48
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceCounter(dict):
    """Chunk -> (pieces, score); a bounded memo of chunks in front of the search."""

    def __init__(self, pieces: Sequence[tuple[str, float]]):
        super().__init__()
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", piece) for piece, _ in pieces)

    def search(self, chunk: str) -> tuple[int, float]:
        best, count, end, top, pieces, start, single = [0.0], [0], 0, None, 0, 0, False

        def close(at: int):
            nonlocal top, pieces, start, single
            if not single:  # a character that is no piece costs one byte piece for each UTF-8 byte
                score = best[at] + self.unknown
                if top is None or score > top:
                    top, pieces = score, count[at] + len(chunk[at].encode("utf-8", "surrogatepass"))
            best.append(top)
            count.append(pieces)
            top, single = None, False

        for last, (length, piece_score) in self.matches.iter(chunk):
            while end < last:
                close(end)
                end += 1
            begin = last + 1 - length
            score = best[begin] + piece_score
            if top is None or score > top or score == top and begin < start:
                top, pieces, start = score, count[begin] + 1, begin
            single |= length == 1
        while end < len(chunk):
            close(end)
            end += 1
        return count[-1], best[-1]

    def __missing__(self, chunk: str) -> tuple[int, float]:
        found = self.search(chunk)
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[chunk] = found
        return found

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = MARK + text.replace(" ", MARK)
        if not self.splits:
            return self.search(marked)
        pieces, score = zip(*map(self.__getitem__, CHUNK.findall(marked)))
        return sum(pieces), sum(score)


def pieces_of(path: str) -> list[tuple[str, float]]:
    """Text pieces of a sentencepiece model with their scores; its control, unknown and byte pieces match no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    if sum(map(model.is_byte, ids)) != 256:
        raise ValueError("byte fallback needs a piece for each byte")
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]


def count_tokens(df: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens long, score double), one row per input row; null and empty texts have no tokens.

    Texts of any length are counted whole in memory linear in their length; repeated rows are counted each.
    """
    path = model_path or public_path("piece_bpe_32k.model")
    pieces = df.sparkSession.sparkContext.broadcast(pieces_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once("pieces", path, lambda: PieceCounter(pieces.value))
        for batch in batches:
            found = [counter.count(x) for x in texts_of(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return map_arrow(id_and_text(df, id_col, text_col), run, "doc_id long, n_tokens long, score double", holds=True)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
