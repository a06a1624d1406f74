"""Sharding by a two-pass external shuffle: scatter into memory-sized buckets, then shuffle each bucket.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievelight.llm.common import bounded, materialize, small

#: Seeds of the hashes that choose a shard and a bucket.
SHARD_SEED, BUCKET_SEED = 11, 12


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shard_of(key: Column, shards: int) -> Column:
    """Rendezvous hashing: the shard whose hash with the key is largest. One more shard takes rows only into itself."""
    drawn = [F.struct(F.xxhash64(F.lit(SHARD_SEED), F.lit(i), key).alias("h"), F.lit(i).alias("i")) for i in range(shards)]
    return F.array_max(F.array(*drawn))["i"]


def _numbered(rows: DataFrame, cols: list[str]) -> DataFrame:
    """_r (the record), _h (its hash) and _copy, which numbers equal records from 0.

    Records whose hash is their own pass by; the others are counted, equal ones before they move, and dealt out again
    in blocks of copies, so that no task holds them all.
    """
    hashed = rows.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_r")).withColumn("_h", F.xxhash64("_r"))
    shared = small(materialize(hashed.groupBy("_h").count().filter("count > 1").select("_h"), "shard-repeats"))
    counted = hashed.join(shared, "_h", "left_semi").groupBy("_r", "_h").agg(F.count(F.lit(1)).alias("_n"))
    blocks = counted.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(4096)))).repartition("_h", "_from")
    copies = blocks.select("_r", "_h", F.explode(F.sequence("_from", F.least(F.col("_from") + 4095, F.col("_n") - 1))).alias("_copy"))
    return hashed.join(shared, "_h", "left_anti").select("_r", "_h", F.lit(0).cast("long").alias("_copy")).unionByName(copies)


def shuffle_shards(rows: DataFrame, shards: int = 24, *, key: str = "doc_id", text: str = "text", bucket_bytes: int = 4 << 20, seed: int = 7) -> DataFrame:
    """The rows with all their columns, plus shard (from 0) and slot (gapless from 0 in each shard, in shuffled order).

    Pass one scatters whole records by seeded hashes: a rendezvous hash of the key picks the shard, a hash of the
    whole record one of the shard's buckets, of which there are as many as make a bucket about bucket_bytes. Pass two sorts a
    bucket's records by key (so that reruns and recomputed tasks agree), shuffles them by Fisher-Yates with a
    seed, and numbers them from where the bucket before ends. Equal texts have different keys and scatter like
    any others, and so do records that share a key, which is null or repeated, within its shard, even if they are equal
    in all columns: their copies are numbered. The size of each bucket is bounded by design; one record is never split, however long its text.

    A null key hashes like a value of its own; null texts have no bytes; repeated rows get a slot each. Columns named like the ones used here inside are safe, as records travel in one struct. Columns
    of rows named shard or slot are replaced. An empty table gives no rows. Columns of map type cannot be compared and are an error.
    """
    cols = [c for c in rows.columns if c not in ("shard", "slot")]
    total = rows.agg(F.sum(record_size(F.col(f"`{text}`")))).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    # As many partitions as the session asks for, and more where a partition would hold over eight buckets.
    parts = max(1, min(shards * buckets, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), shards * buckets // 8)
    spread = _numbered(rows, cols).select(
        shard_of(F.col("_r").getField(key), shards).alias("_s"),
        F.pmod(F.xxhash64(F.lit(BUCKET_SEED), F.lit(seed), "_h", "_copy"), F.lit(buckets)).cast("int").alias("_b"),
        F.struct(F.col("_r").getField(key).alias("_k"), "_h", "_r").alias("_rec"),
    )
    # The number of partitions is explicit, and a partition's buckets are ordered: the permutation that
    # F.shuffle draws depends on the seed, the partition and the order of its rows alone.
    gathered = spread.repartition(parts, "_s", "_b").groupBy("_s", "_b").agg(F.collect_list("_rec").alias("_recs")).sortWithinPartitions("_s", "_b")
    dealt = gathered.select("_s", "_b", F.shuffle(F.array_sort("_recs"), seed).alias("_recs")).select("_s", "_b", F.posexplode("_recs").alias("_p", "_rec"))
    sizes = spread.groupBy("_s", "_b").count()
    starts = sizes.select("_s", "_b", (F.sum("count").over(Window.partitionBy("_s").orderBy("_b")) - F.col("count")).alias("_from"))
    placed = dealt.join(bounded(starts, shards * buckets, 24), ["_s", "_b"])
    return placed.select(*[F.col("_rec._r").getField(c).alias(c) for c in cols], F.col("_s").alias("shard"), (F.col("_from") + F.col("_p")).cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str, **options) -> None:
    """Write the shards of shuffle_shards as Parquet folders shard=N, each file in slot order."""
    out = shuffle_shards(rows, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
