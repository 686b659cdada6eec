"""Text search over messages: corpus, inverted index, BM25 and plain term ranking."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.text import escape_like, snippet
from loomlog.operators.relations import _content, _json_text, blocks

K1, B = 1.2, 0.75


def _block_text(kind: Column, text: Column, name: Column, given: Column, result: Column) -> Column:
    """Searchable text of a block: assistant text, a call as "name: input", or a tool's result."""
    return (
        F.when((F.col("type") == "assistant") & (kind == "text"), text)
        .when((F.col("type") == "assistant") & (kind == "tool_use"), F.concat(name, F.lit(": "), F.coalesce(given, F.lit(""))))
        .when((F.col("type") == "user") & (kind == "tool_result"), F.coalesce(result, F.lit("")))
    )


def search_corpus(msgs: DataFrame, all_blocks: bool = False) -> DataFrame:
    """(doc, session_id, timestamp, role, content_text) of messages with text.

    Only the first block of a message is searched; all_blocks takes every block, and prompts
    given as blocks of text too.
    """
    head = ["session_id", "uuid", "timestamp", "type"]
    at = lambda f: _content(f"$[0].{f}")
    whole = F.when((F.col("type") == "user") & at("type").isNull(), _json_text(F.col("message.content")))
    first = _block_text(at("type"), at("text"), at("name"), _json_text(_content("$[0].input", "variant")), _json_text(_content("$[0].content", "variant")))
    if all_blocks:
        field = lambda f: F.try_variant_get("block", f"$.{f}", "string")
        each = _block_text(field("type"), field("text"), field("name"), _json_text(F.try_variant_get("block", "$.input", "variant")), _json_text(F.try_variant_get("block", "$.content", "variant")))
        rows = blocks(msgs).select(*head, "block_idx", F.coalesce(each, F.when(field("type") == "text", field("text"))).alias("content_text"))
        rows = rows.unionByName(msgs.select(*head, F.lit(0).alias("block_idx"), whole.alias("content_text")).filter(F.schema_of_variant("message.content") == "STRING"))
    else:
        rows = msgs.select(*head, F.lit(0).alias("block_idx"), F.coalesce(whole, first).alias("content_text"))
    found = rows.filter(F.coalesce("content_text", F.lit("")) != "")
    return found.select(F.xxhash64("session_id", "uuid", "block_idx").alias("doc"), "session_id", "timestamp", F.col("type").alias("role"), "content_text")


def terms_of(text: Column) -> Column:
    """Lower-case runs of ASCII letters."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)


#: Postings of a segmented index lie in as many folders, by a hash of their term.
TERM_BUCKETS = 64


def term_bucket(term: Column) -> Column:
    return F.pmod(F.hash(term), F.lit(TERM_BUCKETS))


@dataclass
class Index:
    """postings(term, doc, tf), doc_len(doc, len), term_df(term, df), totals(n_docs, avg_len).

    Postings may also hold `len` and `term_bucket`; term_df None: counted from the postings of a query's terms.
    """

    postings: DataFrame
    doc_len: DataFrame
    term_df: DataFrame | None
    totals: DataFrame


def build_index(corpus: DataFrame, doc: str = "doc", text: str = "content_text") -> Index:
    terms = corpus.select(F.col(doc).alias("doc"), F.explode(terms_of(F.col(text))).alias("term"))
    postings = terms.groupBy("term", "doc").agg(F.count("*").alias("tf"))
    lengths = corpus.select(F.col(doc).alias("doc"), F.size(terms_of(F.col(text))).cast("long").alias("len"))
    return Index(postings, lengths, postings.groupBy("term").agg(F.count("*").alias("df")), lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")))


def save_index(index: Index, path: str) -> None:
    """Postings in term order, so that a query's terms prune files and row groups."""
    index.postings.repartitionByRange("term").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{path}/postings")
    for name in ("doc_len", "term_df", "totals"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "doc_len", "term_df", "totals")))


def query_terms(query: str) -> list[str]:
    import re

    return sorted(set(re.findall("[a-z]+", query.lower())))


def bm25(index: Index, query: str, require_all: bool = False, limit: int | None = None) -> DataFrame:
    """(doc, score) of documents with any, or all, of the query's terms."""
    terms = query_terms(query)
    hits = index.postings.filter(F.col("term").isin(terms))
    if "term_bucket" in hits.columns:
        # Hashes of constants are folded, so that only the terms' folders are read.
        hits = hits.filter(functools.reduce(Column.__or__, [F.col("term_bucket") == term_bucket(F.lit(t)) for t in terms], F.lit(False)))
    if "len" not in hits.columns:
        hits = hits.join(index.doc_len, "doc")
    found = hits.groupBy("term").agg(F.count("*").alias("df")) if index.term_df is None else index.term_df.filter(F.col("term").isin(terms))
    stats = found.crossJoin(F.broadcast(index.totals))
    idf = stats.select("term", "avg_len", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = hits.join(F.broadcast(idf), "term").groupBy("doc").agg(F.sum(part).alias("score"), F.count("*").alias("_k"))
    if require_all:
        scored = scored.filter(F.col("_k") == len(terms))
    out = scored.drop("_k")
    return out if limit is None else out.orderBy(F.col("score").desc(), "doc").limit(limit)


def term_match(corpus: DataFrame, query: str, require_all: bool = False) -> DataFrame:
    """Corpus rows with any, or all, words of the query in their text, and how many as score."""
    words = [w for w in query.lower().split() if w]
    if not words:
        return corpus.withColumn("score", F.lit(0)).filter(F.lit(False))
    score = sum((F.col("content_text").ilike(f"%{escape_like(w)}%").cast("int") for w in words[1:]), F.col("content_text").ilike(f"%{escape_like(words[0])}%").cast("int"))
    return corpus.withColumn("score", score).filter(F.col("score") == len(words) if require_all else F.col("score") > 0)


def filter_hits(hits: DataFrame, sessions: DataFrame, cwd: str = "", role: str = "", since: str | None = None, session: str = "") -> DataFrame:
    """Hits with their session's directory and project, by directory prefix (LIKE), role, time and session."""
    if role and role not in ("user", "assistant"):
        raise ValueError("role is user or assistant")
    out = hits.join(sessions.select("session_id", "cwd", "project"), "session_id")
    if cwd:
        out = out.filter(F.col("cwd").like(cwd + "%"))
    if role:
        out = out.filter(F.col("role") == role)
    if since:
        out = out.filter(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    return out.filter(F.col("session_id") == session) if session else out


def search_sessions(corpus: DataFrame, index: Index | None, sessions: DataFrame, stats: DataFrame, query: str, limit: int = 20, require_all: bool = False, **filters) -> DataFrame:
    """The best hits with snippets and session figures: BM25 with an index, else term counts, newest first among equals."""
    found = term_match(corpus, query, require_all) if index is None else corpus.join(bm25(index, query, require_all), "doc")
    top = filter_hits(found, sessions, **filters).orderBy(F.col("score").desc(), F.col("timestamp").desc_nulls_last(), "doc").limit(limit)
    figures = stats.select("session_id", "first_prompt", "model", "tool_count", "cost_usd")
    return top.withColumn("snippet", snippet(F.col("content_text"), query.lower().split())).drop("content_text").join(figures, "session_id", "left")
