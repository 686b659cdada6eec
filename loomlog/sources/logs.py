"""Reading, checking and browsing session logs (newline-delimited JSON, one file per session)."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.sources.schemas import READ_SCHEMA

#: Name pattern of log files.
GLOB = "*.jsonl"


def read_log(spark: SparkSession, path: str | list[str], schema: str = READ_SCHEMA, glob: str = GLOB) -> DataFrame:
    """All records below path, with file_path; bad lines stay as rows whose _corrupt is set.

    Unreadable files are skipped. A folder without logs gives the same columns and no rows.
    """
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("columnNameOfCorruptRecord", "_corrupt").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    return reader.json(path).select("*", F.col("_metadata.file_path").alias("file_path"))


def raw_records(spark: SparkSession, path: str, glob: str = GLOB) -> DataFrame:
    """Every record with every field, as one VARIANT column `rec`, beside its file's path, size and time."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("singleVariantColumn", "rec")
    meta = F.col("_metadata")
    return reader.json(path).select("rec", meta["file_path"].alias("file_path"), meta["file_size"].alias("file_size"), meta["file_modification_time"].alias("file_modification_time"))


def raw_messages(log: DataFrame) -> DataFrame:
    """User and assistant records as typed columns; a time stamp that does not parse is null."""
    path = F.col("file_path") if "file_path" in log.columns else F.lit(None).cast("string")
    return log.filter(F.col("type").isin("user", "assistant")).select(
        path.alias("file_path"),
        "type",
        F.col("timestamp").try_cast("timestamp").alias("timestamp"),
        F.col("sessionId").alias("session_id"),
        "uuid",
        F.col("parentUuid").alias("parent_uuid"),
        F.col("isSidechain").alias("is_sidechain"),
        "cwd",
        "version",
        "entrypoint",
        F.col("gitBranch").alias("git_branch"),
        F.col("message.role").alias("role"),
        F.col("message.model").alias("model"),
        "message",
        F.col("toolUseResult").alias("tool_use_result"),
    )


def quarantine(log: DataFrame) -> DataFrame:
    """(file_path, bad_lines, sample) of files with lines that did not parse."""
    # Spark refuses a scan of the corrupt column alone; the second comparison, true for any type, keeps another field in it.
    other = F.coalesce("type", F.lit("")) != F.lit("\0")
    bad = log.filter(F.col("_corrupt").isNotNull() & other)
    return bad.groupBy("file_path").agg(F.count("*").alias("bad_lines"), F.min(F.substring("_corrupt", 1, 200)).alias("sample"))


def within_days(df: DataFrame, days: int | str, as_of: dt.datetime | str, column: str = "timestamp") -> DataFrame:
    """Rows of the last `days` days before as_of; 0 keeps all; "month" counts from the first of the month."""
    at = F.lit(as_of).cast("timestamp")
    if days == "month":
        span = F.dayofmonth(at)
    elif int(days) < 0:
        raise ValueError("days must not be negative")
    elif int(days) == 0:
        return df
    else:
        span = F.lit(int(days))
    return df.filter(F.col(column) >= at - F.make_dt_interval(days=span))


def month_days(as_of: dt.datetime) -> int:
    """Days of the month so far, the current one included."""
    return as_of.day


def changed_files(log_files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file_path, modified, change) of files that are new, changed or gone against a manifest of both columns."""
    now = log_files.select("file_path", F.col("modified").alias("_now")).dropDuplicates(["file_path"])
    was = manifest.select("file_path", F.col("modified").alias("_was")).dropDuplicates(["file_path"])
    change = F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), "gone").when(F.col("_now") != F.col("_was"), "changed")
    return now.join(was, "file_path", "full").select("file_path", F.coalesce("_now", "_was").alias("modified"), change.alias("change")).filter("change is not null")


def list_files(spark: SparkSession, path: str, glob: str = GLOB) -> DataFrame:
    """(file_path, modified, size) of the log files below path, without opening them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("file_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def listing(spark: SparkSession, path: str, glob: str = GLOB) -> DataFrame:
    """(file_path, path, modified, size) of the log files: file_path as scans name it, path to open it by."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.col("_metadata.file_path").alias("file_path"), "path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def _whole_gzip(batches):
    """(file_path, content) to (file_path, whole): whether each gzip file ends as it should."""
    import zlib

    import pyarrow as pa

    for batch in batches:
        whole = []
        for content in batch.column(1):
            view, done = memoryview(content.as_buffer()), True
            while len(view) and done:
                part, at = zlib.decompressobj(31), 0
                try:
                    while at < len(view) and not part.eof:
                        part.decompress(view[at : at + (1 << 20)])
                        at += 1 << 20
                except zlib.error:
                    done = False
                done = done and part.eof
                view = view[len(view) - len(part.unused_data) - max(0, len(view) - at) :] if done and (part.unused_data or at < len(view)) else view[:0]
            whole.append(done)
        yield pa.record_batch([batch.column(0), pa.array(whole, pa.bool_())], names=["file_path", "whole"])


def file_census(spark: SparkSession, path: str, glob: str = GLOB) -> DataFrame:
    """(file_path, size, lines, bad_lines, status) of every file below path, those included that give no row; files without a byte are not listed.

    The listing is held against what a scan reads. status: `unreadable` (no line of a file that
    isn't empty), `cut` (fewer bytes read than the file has, or a gzip file that breaks off), `bad
    lines` (lines that do not parse) or `read`. The lines of a file that breaks off may be
    lost to readers; here it is named.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    name = F.col("_metadata.file_path").alias("file_path")
    scanned = reader.text(path).select(name, F.octet_length("value").alias("n"), F.try_parse_json("value").isNull() & (F.trim("value") != "") & F.col("value").isNotNull()).toDF("file_path", "n", "bad")
    read = scanned.groupBy("file_path").agg(F.count("*").alias("lines"), F.sum("n").alias("bytes"), F.count_if("bad").alias("bad_lines"))
    listed = listing(spark, path, glob)
    # A filter on the path would come after the contents of all files are in memory, so gzip files are opened by name.
    packed = [re.sub(r"([][{}*?\\])", r"\\\1", r["path"]) for r in listed.filter(F.lower("path").endswith(".gz")).select("path").collect()]
    ends = spark.read.format("binaryFile").load(packed).select(name, "content").mapInArrow(_whole_gzip, "file_path string, whole boolean") if packed else spark.createDataFrame([], "file_path string, whole boolean")
    files = listed.select("file_path", "size").join(read, "file_path", "left").join(ends, "file_path", "left")
    lines, plain = F.coalesce("lines", F.lit(0)), ~F.col("file_path").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)$")
    # A line's end takes one byte or two.
    short = F.when(plain, F.col("size") > F.col("bytes") + 2 * F.col("lines")).otherwise(~F.coalesce("whole", F.lit(True)))
    status = F.when(short & (lines > 0), "cut").when((lines == 0) | short, "unreadable").when(F.col("bad_lines") > 0, "bad lines").otherwise("read")
    return files.select("file_path", "size", lines.cast("long").alias("lines"), F.coalesce("bad_lines", F.lit(0)).cast("long").alias("bad_lines"), status.alias("status"))


def browse_raw(raw: DataFrame, session_prefix: str = "", record_type: str = "", page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of raw records, newest first, by session prefix (LIKE wildcards apply) and type."""
    rows = raw.select(
        F.try_variant_get("rec", "$.type", "string").alias("type"),
        F.try_variant_get("rec", "$.timestamp", "string").alias("timestamp"),
        F.try_variant_get("rec", "$.sessionId", "string").alias("session_id"),
        F.try_variant_get("rec", "$.uuid", "string").alias("uuid"),
        "file_path",
        F.to_json("rec").alias("record"),
    )
    if session_prefix:
        rows = rows.filter(F.col("session_id").like(session_prefix + "%"))
    if record_type:
        rows = rows.filter(F.col("type") == record_type)
    return rows.orderBy(F.col("timestamp").desc_nulls_last(), "uuid").offset((page - 1) * page_size).limit(page_size)


def record_types(raw: DataFrame) -> DataFrame:
    return raw.select(F.try_variant_get("rec", "$.type", "string").alias("type")).distinct().orderBy("type")
