"""Where intermediate tables go, and how many shards an exchange uses."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from ..storage import new_path, shared_dir, stored

__all__ = ["file_system", "free_name", "input_bytes", "new_path", "quoted", "shards_for", "shared_dir", "stored"]


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes that ``df`` holds."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Where an executor reads and writes files of the shared folder itself, and the path there."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def quoted(column: str) -> str:
    """A column's name for ``F.col``, whatever signs it has."""
    return "`" + column.replace("`", "``") + "`"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shards_for(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Shards for an exchange of fingerprints of ``df``: they follow the input, so a shard stays small."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * parts, min(-(-input_bytes(df) // bytes_each), 1 << 17))
