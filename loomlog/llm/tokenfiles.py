"""Vocabulary files of public tokenizers: read on the driver, broadcast (a few MB each), built once per worker."""

from __future__ import annotations

import base64
import gc
import os

import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Largest vocabulary file that is broadcast.
MAX_FILE_BYTES = 64 << 20

_built: dict = {}


def shared_file(spark: SparkSession, path: str) -> Broadcast:
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is too large for a vocabulary file")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def public_path(name: str) -> str:
    return public_tokenizers.path(name)


def once(kind: str, key, build):
    """build() once in this worker process, which holds one object at a time: another kind or key takes its place."""
    if (kind, key) not in _built:
        release()
        _built[kind, key] = build()
    return _built[kind, key]


def release() -> None:
    """Let go of what an earlier stage built; Spark uses its workers again for the next one."""
    if _built:
        _built.clear()
        gc.collect()


def ranks_of(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}
