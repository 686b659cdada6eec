"""Spelling variants: words one edit apart, by composing acceptors of the vocabulary with a one-edit transducer.

The composition acceptor - one edit - acceptor accepts the pairs of near words. Its paths run through
equal letters up to the first place where the words differ, take the edit there, and then read equal
letters to both ends. So the composition is cut up at its initial states, the pairs (p, p) reached by a
common prefix without an edit:

- For prefixes of up to START letters, and for longer ones whose words are too many for a task, the
  edges that take the edit right at that state are followed for all states at once: after them both
  words have the same rest, so words meet by (prefix, rest) in groups of at most an alphabet.
- Below each remaining prefix, a task builds the minimal acceptor of its words and composes it.

A pair is found once, at the state where its words part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import id_and_text, map_arrow, texts_of, written

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_OCCURRENCES, TYPO_ONE_IN, RATIO = 7, 2, 31, 10
#: Letters of the prefixes below which tasks compose acceptors, and the most words below one of them.
START, MOST_WORDS = 3, 20_000
#: Words that a task counts before it hands them on.
HELD = 1 << 18


def word_counts(df: DataFrame, min_length: int = MIN_LENGTH, min_occurrences: int = MIN_OCCURRENCES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n long) of all words of `min_length` code points or more that occur `min_occurrences` times or more.

    Words are runs of Latin letters, A-Z in lower case; by the checksum of document and word some
    lose a letter, alike wherever they stand in that document. A null text has no words, a null id
    counts as an empty one, repeated rows count as often as they stand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[{LETTERS}]{{{min_length},}}")
        seen: Counter = Counter()

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for part in (b.slice(low, 256) for b in batches for low in range(0, b.num_rows, 256)):
            for doc_id, text in zip(part.column(0).to_pylist(), texts_of(part.column(1))):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                own = Counter(runs.findall(text.encode("utf-8", "replace").lower().decode()))
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % TYPO_ONE_IN == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < min_length:
                            continue
                    seen[word] += n
                if len(seen) >= HELD:
                    yield batch()
                    seen.clear()
        yield batch()

    counts = map_arrow(id_and_text(df, id_col, text_col), run, "word string, c long")
    return counts.groupBy("word").agg(F.sum("c").alias("n")).filter(F.col("n") >= min_occurrences)


class Acceptor:
    """Minimal acyclic acceptor of sorted distinct words; state 0 has no arcs, and every arc leads to a lesser state.

    arcs[s]: (letter, target, words before it) by letter; size[s]: words accepted from s. A word's number
    among those accepted from s is the sum of the third fields along its path.
    """

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.arcs: list[tuple] = []
        self.size: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        known: dict[tuple, int] = {}

        def state(final: bool, arcs: list) -> int:
            key = (final, *arcs)
            if key not in known:
                known[key] = len(self.final)
                before, placed = int(final), []
                for letter, to in arcs:
                    placed.append((letter, to, before))
                    before += self.size[to]
                self.final.append(final)
                self.arcs.append(tuple(placed))
                self.size.append(before)
                self.low.append(0 if final else 1 + min((self.low[t] for _, t in arcs), default=0))
                self.high.append(1 + max(self.high[t] for _, t in arcs) if arcs else 0)
            return known[key]

        # Open states along the present word: [final, finished arcs, letter of the open arc].
        path: list[list] = [[False, [], ""]]
        for before, word in pairwise(["", *words, None]):
            common = 0
            if word is not None:
                while common < min(len(before), len(word)) and before[common] == word[common]:
                    common += 1
            while len(path) > common + 1:
                final, arcs, _ = path.pop()
                path[-1][1].append((path[-1][2], state(final, arcs)))
            if word is not None:
                for letter in word[common:]:
                    path[-1][2] = letter
                    path.append([False, [], ""])
                path[-1][0] = True
        self.start = state(*path[0][:2])


NONE = np.zeros((0, 2), np.int64)


def _shared(a: Acceptor, s: int, t: int, memo: dict) -> np.ndarray:
    """Numbers, from s and from t, of the words that both accept."""
    if s == t:
        return np.repeat(np.arange(a.size[s]), 2).reshape(-1, 2)
    if (s, t) in memo:
        return memo[s, t]
    order, seen, stack = [], {(s, t)}, [(s, t)]
    while stack:
        s1, t1 = pair = stack.pop()
        order.append(pair)
        to = {letter: x for letter, x, _ in a.arcs[t1]}
        for letter, x, _ in a.arcs[s1]:
            y = to.get(letter)
            if y is not None and x != y and (x, y) not in seen and (x, y) not in memo and a.low[x] <= a.high[y] and a.low[y] <= a.high[x]:
                seen.add((x, y))
                stack.append((x, y))
    for s1, t1 in sorted(order):  # arcs lead to lesser states
        parts = [np.zeros((1, 2), np.int64)] if a.final[s1] and a.final[t1] else []
        to = {letter: (x, before) for letter, x, before in a.arcs[t1]}
        for letter, x, before in a.arcs[s1]:
            if letter in to:
                y, other = to[letter]
                met = _shared(a, x, y, memo) if x == y else memo.get((x, y), NONE)
                if len(met):
                    parts.append(met + (before, other) if before or other else met)
        memo[s1, t1] = NONE if not parts else parts[0] if len(parts) == 1 else np.concatenate(parts)
    return memo[s, t]


def composed(words: list[str]) -> np.ndarray:
    """Pairs (i, j) of sorted distinct words exactly one inserted, deleted or replaced letter apart, each once."""
    a, memo = Acceptor(words), {}
    near: list[np.ndarray] = []
    for s, arcs in enumerate(a.arcs):
        parts = [near[x] + before if before else near[x] for _, x, before in arcs if len(near[x])]
        for i, (_, x, before) in enumerate(arcs):
            for _, y, other in arcs[i + 1 :]:
                if a.low[x] <= a.high[y] and a.low[y] <= a.high[x]:
                    met = _shared(a, x, y, memo)
                    if len(met):
                        parts.append(met + (before, other))
        # One word reads `letter` where the other goes on; words that go on with the same letter part later.
        for letter, x, before in arcs:
            if a.final[x] and a.final[s]:
                parts.append(np.array([[before, 0]]))
            for beyond, y, other in arcs:
                if beyond != letter:
                    for next_letter, z, after in a.arcs[x]:
                        if next_letter == beyond and a.low[z] <= a.high[y] and a.low[y] <= a.high[z]:
                            met = _shared(a, z, y, memo)
                            if len(met):
                                parts.append(met + (before + after, other))
        near.append(NONE if not parts else parts[0] if len(parts) == 1 else np.concatenate(parts))
    return near[a.start]


def _compose_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pre, word, n) in order to (a, an, b, bn): pairs below each prefix."""
    names = ["a", "an", "b", "bn"]

    def pairs(words: list[str], n: list[int]) -> pa.RecordBatch:
        at = composed(words) if len(words) > 1 else NONE
        w, c = pa.array(words, pa.string()), pa.array(n, pa.int64())
        return pa.record_batch([w.take(at[:, 0]), c.take(at[:, 0]), w.take(at[:, 1]), c.take(at[:, 1])], names=names)

    pre, words, counts = None, [], []
    for b in batches:
        for p, word, n in zip(*(c.to_pylist() for c in b.columns)):
            if p != pre and words:
                yield pairs(words, counts)
                words, counts = [], []
            pre = p
            words.append(word)
            counts.append(n)
    if words:
        yield pairs(words, counts)


def _parted_at(words: DataFrame, k: int) -> DataFrame:
    """(a, an, b, bn): near words of the same k letters that differ at the next one."""
    own = F.struct("word", "n")
    sub = F.struct(F.concat(F.expr(f"left(word, {k})"), F.lit("|"), F.expr(f"substr(word, {k + 2})")).alias("key"), F.expr(f"substr(word, {k + 1}, 1)").alias("letter"), own.alias("w"))
    whole = F.struct(F.concat(F.expr(f"left(word, {k})"), F.lit("|"), F.expr(f"substr(word, {k + 1})")).alias("key"), F.lit("").alias("letter"), own.alias("w"))
    rows = words.select(F.inline(F.when(F.length("word") > k, F.array(sub, whole)).otherwise(F.array(whole))))
    # Of one key there is at most one word for each letter, and one whole: a group is as small as the alphabet.
    groups = rows.groupBy("key").agg(F.collect_list(F.struct("letter", "w")).alias("g")).filter(F.size("g") > 1)
    met = groups.select("key", F.explode("g").alias("x"), "g").select("key", "x", F.explode("g").alias("y")).filter("x.letter < y.letter")
    goes_on = F.expr(f"substr(x.w.word, {k + 1}, 1)")
    return met.filter((F.col("x.letter") != "") | (goes_on != F.col("y.letter"))).select(F.col("x.w.word").alias("a"), F.col("x.w.n").alias("an"), F.col("y.w.word").alias("b"), F.col("y.w.n").alias("bn"))


def near_words(vocabulary: DataFrame, start: int = START, most_words: int = MOST_WORDS) -> DataFrame:
    """(a, an, b, bn): all pairs of words of (word, n) that are one edit apart, each once."""
    n = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = [_parted_at(vocabulary, k) for k in range(start)]
    rest, below, k = vocabulary, [], start
    while True:
        rest = rest.withColumn("pre", F.expr(f"left(word, {k})"))
        hot = written(rest.groupBy("pre").count().filter(F.col("count") > most_words).select("pre"))
        if hot.isEmpty():
            below.append(rest)
            break
        below.append(rest.join(hot, "pre", "left_anti").select(*rest.columns))
        rest = written(rest.join(hot, "pre", "left_semi").select(*vocabulary.columns))
        found.append(_parted_at(rest, k))
        k += 1
    for part in below:
        rows = part.select("pre", "word", "n").repartition(n, "pre").sortWithinPartitions("pre", "word")
        found.append(map_arrow(rows, _compose_groups, "a string, an long, b string, bn long"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def spelling_groups(df: DataFrame, ratio: int = RATIO, id_col: str = "doc_id", text_col: str = "text", start: int = START, most_words: int = MOST_WORDS, **rules) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word.

    form is the near word of greatest count, if that is `ratio` times the word's own (ties: the
    least word); root follows forms to the last one. An empty table, and texts without words, give
    no rows.
    """
    vocabulary = written(word_counts(df, id_col=id_col, text_col=text_col, **rules))
    pairs = written(near_words(vocabulary, start, most_words))
    links = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("an").alias("n"), F.col("bn").alias("near_n"))
    links = links.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("bn").alias("n"), F.col("an").alias("near_n")))
    links = links.unionByName(vocabulary.select("word", F.lit(None).cast("string").alias("near"), "n", F.lit(None).cast("long").alias("near_n")))
    best = F.min(F.when(F.col("near_n") >= ratio * F.col("n"), F.struct((-F.col("near_n")).alias("least"), "near")))
    formed = links.groupBy("word", "n").agg(F.count("near").alias("n_near"), best.alias("b"))
    formed = written(formed.select("word", "n", "n_near", F.col("b.near").alias("form"), (-F.col("b.least")).alias("form_n")))
    # Counts grow by `ratio` with every step, so chains are short; each round doubles the steps taken.
    ends = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ends = written(ends)
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if ends.join(further, "root", "left_semi").isEmpty():
            break
        ends = ends.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
