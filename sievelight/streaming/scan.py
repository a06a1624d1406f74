"""Files that arrive as a stream, each content scanned once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions.tables import written
from sievelight.operators.detect import line_patterns
from sievelight.operators.incremental import cache_misses, content_hash
from sievelight.sources.cache import ScanCache


def once(files: DataFrame, time_col: str = "ts", delay: str = "1 day") -> DataFrame:
    """files(repo, file, content, time) with a hash, each (repo, file, hash) once; state is dropped behind the watermark."""
    hashed = files.withColumn("hash", content_hash(F.col("content"), "text"))
    return hashed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["repo", "file", "hash"])


def stream_scan(files: DataFrame, sink: str, checkpoint: str, *, scan=line_patterns, time_col: str = "ts", delay: str = "1 day"):
    """Start a query that appends the findings of new content to Parquet in sink and ends when all input is read."""
    found = scan(once(files, time_col, delay))
    return found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_cache_upsert(files: DataFrame, cache: ScanCache, checkpoint: str, *, scan=line_patterns):
    """Start a query that scans what the cache's `hashes` do not have and replaces these files' rows in `hashes` and `findings`.

    The cache is the state: the stream keeps none. Of versions of a file in one micro-batch the latest counts. Both tables
    change by one rename, under the batch's id, so a batch that is played again changes nothing.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        latest = rows.groupBy("repo", "file").agg(F.max_by("content", F.struct("ts", "content")).alias("content"))
        hashed = latest.withColumn("hash", content_hash(F.col("content"), "text"))
        new = hashed.join(cache_misses(hashed, cache.read("hashes")), ["repo", "file", "hash"], "left_semi")
        new = written(new, "stream-new")
        cache.upsert({"findings": scan(new), "hashes": new.select("repo", "file", "hash")}, new, batch_id)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
