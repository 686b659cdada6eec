"""Quality rules as a short-circuit cascade of column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import SPACE_CHARS, id_and_text

#: Rows that rule costs and selectivities are estimated on; they order the rules and change no verdict.
SAMPLE_ROWS = 1000
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A text for which `rejects` is true goes; `needs` are the measures that it reads."""

    name: str
    needs: tuple[str, ...]
    rejects: Column


def words_of(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _shift(values: Column, by: int) -> Column:
    return F.slice(values, F.lit(by + 1), F.greatest(F.size(values) - by, F.lit(0)))


def with_window_hashes(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add hashes, the XXH64 of each run of `window` words (a power of two), built by doubling; empty if there are too few words.

    Each doubling is a projection of its own: higher-order functions are evaluated for each
    mention, so one nested expression would hash every word 27 times.
    """
    df, width = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))), 1
    while width < window:
        df = df.withColumn("hashes", F.zip_with("hashes", _shift(F.col("hashes"), width), lambda a, b: F.xxhash64(a, b)))
        width *= 2
    whole = F.slice("hashes", F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(0)))
    return df.withColumn("hashes", F.when(F.size("words") >= window, whole).otherwise(F.array().cast("array<bigint>")))


def with_repeated_words(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add n_repeat_words, the words covered by windows whose hash occurs twice or more, the first occurrence included.

    Windows are sorted by hash, twins marked, and their starts put in order again; each covers
    up to the next start. Texts without twins, nearly all, skip the sorting.
    """
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    pairs = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_at", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), pairs).otherwise(none))
    df = df.withColumn("_h", F.transform("_at", lambda x: x["h"]))
    df = df.withColumn("_twin", F.zip_with("_h", _shift(F.col("_h"), 1), lambda a, b: a.eqNullSafe(b)))
    hit = F.zip_with(F.arrays_zip(F.transform("_at", lambda x: x["i"]).alias("i"), F.col("_twin").alias("n")), F.concat(F.array(F.lit(False)), "_twin"), lambda x, p: F.when(x["n"] | p, x["i"]))
    df = df.withColumn("_starts", F.array_sort(F.filter(hit, lambda x: x.isNotNull())))
    spans = F.zip_with("_starts", _shift(F.col("_starts"), 1), lambda a, b: F.when(a.isNull(), F.lit(0)).otherwise(F.least(F.lit(window), F.coalesce(b - a, F.lit(window)))))
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x)
    return df.withColumn("n_repeat_words", covered).drop("_at", "_h", "_twin", "_starts")


def _gone(chars: str) -> Column:
    return F.length(F.translate(F.col("text"), chars, ""))


def _numbers(name: str) -> Column:
    """A measure from the columns text, words and lines, except n_repeat_words, which takes projections of its own."""
    return {
        "n_words": F.size("words"),
        "word_chars": _gone(SPACE_CHARS),
        "n_symbols": F.length("text") - _gone("#*$%&|<>"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_lines": F.size("lines"),
        "n_repeat_words": F.col("n_repeat_words"),
    }[name].cast("long").alias(name)


#: What a measure costs, in passes over a character, given n_chars, n_words and n_lines of a text.
WORK = {"n_words": "n_chars", "word_chars": "n_chars", "n_symbols": "n_chars", "n_dup_lines": "n_chars + 10 * n_lines", "n_lines": "n_chars", "n_repeat_words": "60 * n_words"}
MEASURES = tuple(WORK)


def _with(df: DataFrame, keep: list[str], needs: Sequence[str]) -> DataFrame:
    """Add measures to df, whose columns `keep` and text stay, with words and lines once they are made."""
    if "words" not in df.columns and {"n_words", "n_repeat_words"} & set(needs):
        df = df.withColumn("words", words_of(F.col("text")))
    if "lines" not in df.columns and {"n_dup_lines", "n_lines"} & set(needs):
        df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x, F.lit(SPACE_CHARS))) > 0))
    if "n_repeat_words" in needs:
        df = with_repeated_words(with_window_hashes(df)).drop("hashes")
    held = [c for c in ("text", "words", "lines") if c in df.columns]
    return df.select(*keep, *held, *[_numbers(m) for m in needs])


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words), one row per input row; a null text has no words."""
    docs = id_and_text(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return _with(docs, ["doc_id"], MEASURES).select("doc_id", *MEASURES)


def default_rules() -> list[Rule]:
    """The base rules, and rules that only damaged texts fail."""
    n, c = F.col("n_words"), F.col("word_chars")
    return [
        Rule("few_words", ("n_words",), n < 20),
        Rule("repeated_words", ("n_words", "n_repeat_words"), 100 * F.col("n_repeat_words") > 30 * n),
        Rule("symbols", ("word_chars", "n_symbols"), 10 * F.col("n_symbols") > c),
        Rule("duplicate_lines", ("n_dup_lines", "n_lines"), 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        Rule("word_length", ("n_words", "word_chars"), (c < 2 * n) | (c > 20 * n)),
    ]


BASE_RULES = ("few_words", "repeated_words")


def rule_order(df: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> list[Rule]:
    """Rules by falling rejections per cost, both estimated in one job on the first `sample_rows` rows.

    Each next rule is the one that rejects most of the sampled rows still alive for the cost of the
    measures that it adds (a rule whose measures are all known costs a tenth of a pass). Costs are
    counted, not timed, so the order is the same on every run; ties keep the given order. Only
    numbers reach the driver, and no more partitions are read than hold the sample.
    """
    texts = df.select(F.lit(0).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    failed = F.lit(0)
    for i, rule in enumerate(rules):
        failed = failed + F.when(rule.rejects, F.lit(1 << i)).otherwise(0)
    sized = measured(texts).withColumn("n_chars", F.col("word_chars") + F.col("n_words"))
    rows = sized.select(failed.alias("failed"), *[F.expr(work).alias(m) for m, work in WORK.items()], F.col("n_chars").alias("chars")).limit(sample_rows).collect()
    cost = {m: sum(r[m] for r in rows) for m in MEASURES}
    least = 0.1 * sum(r["chars"] for r in rows) + 1
    left, out, known = list(enumerate(rules)), [], set()
    while left:

        def worth(x: tuple[int, Rule]) -> float:
            return sum(r["failed"] >> x[0] & 1 for r in rows) / (least + sum(cost[m] for m in set(x[1].needs) - known))

        best = max(left, key=lambda x: (worth(x), -x[0]))
        left.remove(best)
        out.append(best[1])
        known |= set(best[1].needs)
        rows = [r for r in rows if not r["failed"] >> best[0] & 1]
    return out


def cascade(rules: Sequence[Rule]) -> Column:
    """Name of the first failing rule in the given order, null if all pass."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects, F.lit(rule.name)).otherwise(out)
    return out


def quality_verdicts(df: DataFrame, rules: Sequence[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Measures, failed rule and verdict, one row per input row, in any multiplicity.

    A null or empty text has no words and is rejected as too short. An empty table gives no rows.
    """
    rules = list(rules or default_rules())
    ordered = rule_order(df, rules, sample_rows, text_col)
    failed = measured(df, id_col, text_col).withColumn("failed_rule", cascade(ordered))
    base = F.lit(False)
    for rule in rules:
        if rule.name in BASE_RULES:
            base = base | rule.rejects
    return failed.withColumn("base_failed", base).withColumn("kept", F.col("failed_rule").isNull() & ~F.col("base_failed"))


def passing(df: DataFrame, rules: Sequence[Rule] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, ordered: bool = False) -> DataFrame:
    """Rows of df that every rule accepts, all columns kept, without a shuffle; ordered: take the rules as they stand.

    A short-circuit cascade: each rule's measures are computed for the rows that all rules before
    it accepted, and rejected rows leave at once.
    """
    names, rules = df.columns, list(rules or default_rules())
    if not ordered:
        rules = rule_order(df, rules, sample_rows, text_col)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    known: list[str] = []
    for rule in rules:
        new = [m for m in rule.needs if m not in known]
        if new:
            rows = _with(rows, ["_row", *known], new)
            # A generator keeps the filter above the measures; pushed below, it would compute them for each mention.
            held = [c for c in rows.columns if c not in new]
            rows = rows.select(*held, F.explode(F.array(F.struct(*new))).alias("_m")).select(*held, "_m.*")
            known += new
        rows = rows.filter(~F.coalesce(rule.rejects, F.lit(False)))
    return rows.select("_row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
r AS (SELECT g.doc_id, g.i FROM g JOIN (SELECT doc_id, gram FROM g GROUP BY doc_id, gram HAVING count(*) > 1) x ON x.doc_id = g.doc_id AND x.gram = g.gram),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT 10 * n_symbols > word_chars AND NOT 10 * n_dup_lines > 3 * n_lines AND NOT (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept FROM b
"""
