"""What joins and rankings of any size need: measured broadcasts, places in order without one task a group."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

#: A side of a join is broadcast only if its rows and texts are counted to take less than this.
BROADCAST_BYTES = 32 << 20


def counted_bytes(df: DataFrame) -> int:
    """Bytes that df takes as the hash table of a broadcast: three times its rows with their fields, twice its texts."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    rows, more = df.agg(F.count(F.lit(1)), F.sum(sum(texts, F.lit(0)).cast("long"))).first()
    structs = sum(len(f.dataType.fields) if isinstance(f.dataType, T.StructType) else 1 for f in df.schema.fields)
    return 3 * rows * (16 + 16 * structs) + 2 * (more or 0)


def small(df: DataFrame) -> DataFrame:
    """df with a hint to broadcast it if its counted bytes are few; else Spark joins by shuffle."""
    return F.broadcast(df) if counted_bytes(df) <= BROADCAST_BYTES else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir); on one machine a local one where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return f"{(named or tempfile.gettempdir() + '/sievelight-shared').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder: whoever reads it gets the same rows, and no executor holds the only copy."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_distinct(df: DataFrame, keys: list[str], add: Callable[[DataFrame], DataFrame], most: int = 100_000) -> DataFrame:
    """add(df), where what add appends to df's columns (in any number of rows) comes from keys alone.

    Where keys have few distinct values, add runs once for each of them, and what it gives is broadcast; else it runs on every row.
    """
    if df.agg(F.approx_count_distinct(F.struct(*keys))).first()[0] > most:
        return add(df)
    made = written(add(df.select(*keys).distinct()), "distinct")
    if counted_bytes(made) > BROADCAST_BYTES:
        return add(df)
    new = [c for c in made.columns if c not in keys]
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return df.alias("a").join(F.broadcast(made).alias("b"), reduce(Column.__and__, same)).select("a.*", *[f"b.{c}" for c in new])


def placed(df: DataFrame, group: list[str], order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """df with `name`, the place (from 1) of each row in its group by order. order should leave no ties but equal rows.

    Rows are dealt by ranges of (group, order) and written, so a group of any size is spread over tasks: each numbers its own
    rows, and what the ranges before it hold of the group, one number for each range and group, is added.
    """
    keys = [F.col(f"`{g}`") for g in group]
    dealt = written(df.repartitionByRange(*([parts] if parts else []), *keys, *order).withColumn("_part", F.spark_partition_id()), "placed")
    own = Window.partitionBy("_part", *keys).orderBy(*order)
    numbered = dealt.withColumn("_own", F.row_number().over(own))
    held = dealt.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_held"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0)))
    same = F.col("a._part") == F.col("b._part")
    for g in group:
        same = same & F.col(f"a.`{g}`").eqNullSafe(F.col(f"b.`{g}`"))
    joined = numbered.alias("a").join(offsets.alias("b"), same)
    return joined.select(*[F.col(f"a.`{c}`") for c in df.columns], (F.col("a._own") + F.col("b._before")).cast("int").alias(name))
