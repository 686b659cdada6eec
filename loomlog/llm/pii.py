"""Personal data: base patterns, and contextual extraction bootstrapped from what they find.

Base entities are seeds of four kinds; strings as random as keys seed a fifth, secrets, which no
base pattern finds. The words and marks around seeds induce lexical patterns; the same patterns
around other identifier-like strings link those to the seeds. Spark scores this graph of patterns
and instances in rounds. A pattern's confidence in a kind is the score of its instances of that
kind over the same plus all that speak against it: instances of other kinds, strings whose shape
rules the kind out, and a tenth of each string not known yet. An instance's score is the best
confidence of its patterns. Patterns of high confidence and support then mark unseen identifiers,
and the secrets that seeded them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import map_arrow, texts_of, written

KINDS = ("email", "ip", "card", "phone", "secret")
SECRET, SECRET_SHAPE = 4, 16
ROUNDS, MIN_CONFIDENCE, MIN_SUPPORT, UNKNOWN_WEIGHT = 3, 0.8, 8, 0.1
LEFT_CHARS, RIGHT_CHARS = 64, 32

_ANY = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits unless the run's own start was tried and failed alike.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"(?<![\w@.+/=-])(?:[^\s@,;<>()\"']{1,64}@[^\s@,;<>()\"']{1,64}|[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,24}(?![\w@])|(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{8,256}={0,2})(?![\w@])")
_HEX = re.compile(r"(?=[0-9]*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})")
_CONTEXT = re.compile(r"[^\W\d_]+|[^\w\s]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ takes the run of local characters before it, which is what leftmost matching finds, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base entities in order, leftmost and non-overlapping within a kind; failing matches are dropped."""
    if not _ANY.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub(r"[ -]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def random_looking(token: str) -> bool:
    """Long hexadecimal strings, and ones of 20 or more characters that mix digits with letters of both cases throughout."""
    if _HEX.fullmatch(token):
        return True
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "" for c in token]
    return len(token) >= 20 and {"d", "u", "l"} <= set(kinds) and sum(a != b for a, b in zip(kinds, kinds[1:])) >= len(token) // 3


def shapes(token: str) -> int:
    """Bit k: the string could be of kind k."""
    digits = sum("0" <= c <= "9" for c in token)
    if "@" in token:
        return 1
    if any(c.isalpha() for c in token):
        return SECRET_SHAPE
    return (2 if token.count(".") == 3 and digits <= 12 else 0) | (4 if 12 <= digits <= 19 else 0) | (8 if 7 <= digits <= 15 else 0)


def mentions(text: str) -> list[dict]:
    """Base entities, random-looking strings and, where neither is, identifier-like strings (kind -1), with the words around them."""
    seeds = base_spans(text)
    found = [(a, b, k, 1 << k) for a, k, b in seeds]
    if found or _ANY.search(text):
        taken = sorted((a, b) for a, _, b in seeds)
        i = 0
        for m in _CANDIDATE.finditer(text):
            while i < len(taken) and taken[i][1] <= m.start():
                i += 1
            if (i == len(taken) or taken[i][0] >= m.end()) and (shape := shapes(m.group())):
                found.append((m.start(), m.end(), SECRET if shape == SECRET_SHAPE and random_looking(m.group()) else -1, shape))
    out = []
    for a, b, kind, shape in sorted(found):
        left = _CONTEXT.findall(text[max(0, a - LEFT_CHARS) : a].lower())[-3:]
        right = _CONTEXT.findall(text[b : b + RIGHT_CHARS].lower())[:1]
        key = xxhash.xxh64_intdigest(text[a:b].lower().encode("utf-8", "replace"))
        out.append({"kind": kind, "start": a, "end": b, "shape": shape, "key": key - (1 << 64) if key >> 63 else key, "left": " ".join(left), "near": " ".join(left[-2:]), "right": right[0] if right else ""})
    return out


_FIELDS = [("kind", "int", pa.int32()), ("start", "int", pa.int32()), ("end", "int", pa.int32()), ("shape", "int", pa.int32()), ("key", "bigint", pa.int64()), ("left", "string", pa.string()), ("near", "string", pa.string()), ("right", "string", pa.string())]


def find_mentions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, mentions), one row per input row; null texts are empty."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    arrow = pa.list_(pa.struct([(n, t) for n, _, t in _FIELDS]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([mentions(x) for x in texts_of(batch.column(2))], arrow)], names=["doc_id", "text_hash", "mentions"])

    return map_arrow(rows, run, f"doc_id long, text_hash long, mentions array<struct<{', '.join(f'`{n}`:{t}' for n, t, _ in _FIELDS)}>>")


def _patterns() -> Column:
    """Three tokens to the left, two to the left and one to the right, and two to the left."""
    m, full = F.col("m"), F.col("m.near") != ""
    return F.array_compact(F.array(F.when(F.col("m.left") != m["near"], F.concat(F.lit("l3 "), m["left"])), F.when(full & (m["right"] != ""), F.concat(F.lit("lr "), m["near"], F.lit(" _ "), m["right"])), F.when(full, F.concat(F.lit("l2 "), m["near"]))))


def _could_be(shape: str, kind: str) -> Column:
    return F.expr(f"(`{shape}` & shiftleft(1, `{kind}`)) <> 0")


def confident_patterns(found: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_support: float = MIN_SUPPORT) -> DataFrame:
    """(pattern, kind, confidence) after the last round.

    Copies of a text add nothing, as a pattern counts distinct instances. All steps are grouped
    sums and joins on hashed keys; no group is gathered.
    """
    edges = found.select(F.explode("mentions").alias("m")).select(F.col("m.key").alias("key"), F.col("m.kind").alias("kind"), F.col("m.shape").alias("shape"), F.explode(_patterns()).alias("pattern")).distinct()
    edges = written(edges)
    seeds, trusted = edges.filter("kind >= 0").select("key", F.col("kind").alias("k"), F.lit(1.0).alias("score")).distinct(), None
    scores = seeds
    for _ in range(rounds):
        rows = edges.join(scores, "key", "left")
        sums = []
        for k in range(len(KINDS)):
            against = F.when(F.col("k") != k, F.col("score")).when(F.col("k").isNull(), F.when(F.col("shape").bitwiseAND(F.lit(1 << k)) != 0, F.lit(UNKNOWN_WEIGHT)).otherwise(1.0))
            sums += [F.sum(F.when(F.col("k") == k, F.col("score")).otherwise(0.0)).alias(f"s{k}"), F.sum(F.coalesce(against, F.lit(0.0))).alias(f"a{k}")]
        by_kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"s{k}").alias("s"), F.col(f"a{k}").alias("a")) for k in range(len(KINDS))])).alias("x")
        weighed = rows.groupBy("pattern").agg(*sums).select("pattern", by_kind).select("pattern", F.col("x.kind").alias("kind"), F.col("x.s").alias("support"), (F.col("x.s") / (F.col("x.s") + F.col("x.a") + 1)).alias("confidence"))
        trusted = written(weighed.filter((F.col("confidence") >= min_confidence) & (F.col("support") >= min_support)).select("pattern", "kind", "confidence"))
        reached = edges.filter("kind < 0").join(trusted.withColumnRenamed("kind", "k"), "pattern").filter(_could_be("shape", "k"))
        gained = written(reached.groupBy("key", "k").agg(F.max("confidence").alias("score")))
        if gained.isEmpty():
            break
        scores = seeds.unionByName(gained)
    return trusted


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text_hash, base, spans), one row per input row.

    base and spans are arrays of (start, kind, end) structs, kind indexing KINDS, by start, then
    kind; spans holds base and what confident patterns add, which never overlaps base spans.
    Offsets are code points. Empty and null texts have none; repeated rows get the same spans.
    """
    found = written(find_mentions(df, id_col, text_col))
    trusted = confident_patterns(found, rounds)
    unseen = found.select("doc_id", "text_hash", F.explode(F.filter("mentions", lambda m: (m["kind"] < 0) | (m["kind"] == SECRET))).alias("m"))
    marked = unseen.select("doc_id", "text_hash", "m", F.col("m.shape").alias("shape"), F.explode(_patterns()).alias("pattern")).join(trusted, "pattern").filter(_could_be("shape", "kind"))
    best = marked.groupBy("doc_id", "text_hash", F.col("m.start").alias("start"), F.col("m.end").alias("end")).agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    extra = best.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "kind", "end")).alias("extra")).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "extra")
    base = F.array_sort(F.transform(F.filter("mentions", lambda m: (m["kind"] >= 0) & (m["kind"] < SECRET)), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"))))
    rows = found.select("doc_id", "text_hash", base.alias("base"))
    joined = rows.join(extra, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left")
    return joined.select("doc_id", "text_hash", "base", F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "extra"))).alias("spans"))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with each span of the text replaced by its kind in brackets; overlapping spans by the first one's.

    All columns and rows stay; null texts stay null.
    """
    names = df.columns
    spans = find_pii(df, id_col, text_col).filter(F.size("spans") > 0).groupBy("doc_id", "text_hash").agg(F.first("spans").alias("_spans"))
    # The caller's row is one column, so that no name of its can clash.
    text = F.col(f"`{text_col}`").cast("string")
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_hash"))
    hit = row.join(spans.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_text"}), F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_text")), "left")
    places = [f"c{i}" for i in range(len(names))]
    hit = hit.select(*[F.col("_row").getField(c).alias(p) for c, p in zip(names, places)], "_spans")
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = batch.column(len(names)), batch.column(at).cast(pa.string())
            if spans.null_count < batch.num_rows:
                rows = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
                new = [cut_out(text, own) for text, own in zip(texts_of(texts.take(pa.array(rows))), spans.take(pa.array(rows)).to_pylist())]
                texts = pc.replace_with_mask(texts, spans.is_valid(), pa.array(new, pa.string()))
            columns = [texts.cast(batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.record_batch(columns, names=names)

    return map_arrow(hit, run, df.schema)


def cut_out(text: str, spans: list[dict]) -> str:
    """The text with its kind in brackets for each span; overlapping spans are one of the first's kind."""
    out, at = [], 0
    for span in spans:
        if span["start"] >= at:
            out += [text[at : span["start"]], f"[{KINDS[span['kind']].upper()}]"]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # A second parameter of the function, even one with a default, would be given the place in the array.
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:SECRET])]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
