"""Rescans of what has changed: content hashes, cache hits and misses, changed-file sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(content: Column, *prefix: str | Column) -> Column:
    """SHA-256 of the prefixes (a language, or a provider and a model) and the content, joined by |."""
    parts = [F.lit(p) if isinstance(p, str) else p for p in prefix]
    return F.sha2(F.concat_ws("|", *parts, F.coalesce(content, F.lit(""))), 256)


def changed_file_set(changes: DataFrame) -> DataFrame:
    """Distinct (repo, file) of change lists (worktree, staged, base, untracked), trimmed, blanks dropped."""
    return changes.select("repo", F.trim("file").alias("file")).filter("file != ''").distinct()


def changed_files_semi(files: DataFrame, changed: DataFrame) -> DataFrame:
    return files.join(changed.select("repo", "file"), ["repo", "file"], "left_semi")


def cache_hits(hashed: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached rows of files whose hash is unchanged; hashed(repo, file, hash) carries no content through the join."""
    return hashed.select("repo", "file", "hash").join(cache, ["repo", "file", "hash"])


def cache_misses(hashed: DataFrame, cache: DataFrame) -> DataFrame:
    """Files to scan again: (repo, file, hash) that the cache does not have."""
    return hashed.select("repo", "file", "hash").join(cache.select("repo", "file", "hash"), ["repo", "file", "hash"], "left_anti")
