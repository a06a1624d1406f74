"""Sharding: equal records spread over buckets, columns of any name, and the shards by rendezvous hashing done by hand."""

from collections import Counter

import xxhash
from pyspark.sql import functions as F

from sievelight.llm import sharding


def spark_xxhash(seed, shard, key):
    """Spark's xxhash64 of (seed, shard, key): an int is hashed by its four bytes, a long by eight, each seeded by the one before; null changes nothing."""
    h = 42
    for value, width in ((seed, 4), (shard, 4), (key, 8)):
        if value is not None:
            h = xxhash.xxh64_intdigest(value.to_bytes(width, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def shard_by_hand(key, shards):
    return max((spark_xxhash(sharding.SHARD_SEED, i, key), i) for i in range(shards))[1]


def test_shards_equal_those_by_hand(make_docs):
    docs = make_docs(*[f"text {i}" for i in range(300)], (None, "no id"), (7, "id again")).drop("shard")
    rows = sharding.shuffle_shards(docs, 24).collect()
    assert all(r["shard"] == shard_by_hand(r["doc_id"], 24) for r in rows) and len(rows) == 302
    grown = sharding.shuffle_shards(docs, 25).collect()
    moved = {r["doc_id"]: r["shard"] for r in grown}
    assert all(moved[r["doc_id"]] in (r["shard"], 24) for r in rows)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())


def test_equal_records_spread_over_buckets(spark, make_docs):
    docs = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text each time").alias("text"), F.lit(1).alias("a.b"))
    other = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit(2).alias("a.b"))
    docs = docs.unionByName(other).unionByName(other.limit(5))
    numbered = sharding._numbered(docs, docs.columns)
    assert numbered.count() == 9055
    copies = sorted(r["_copy"] for r in numbered.filter("_r.doc_id is null").collect())
    assert copies == list(range(9000))
    rows = sharding.shuffle_shards(docs, 3, bucket_bytes=4096).collect()
    assert Counter((r["doc_id"], r["text"], r["a.b"]) for r in rows) == Counter((r["doc_id"], r["text"], r["a.b"]) for r in docs.collect())
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shuffle_shards(docs.limit(0), 3).count() == 0
