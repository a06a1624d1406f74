"""What the operators share: intermediate tables in the cluster's shared folder, size checks for broadcasts, running sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

#: A side is broadcast only when its measured size in memory stays below this.
BROADCAST_BYTES = 32 << 20

#: Spark's setting that shuffle files go at the end of the write or query that made them.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: ASCII white space, as the contracts define it.
SPACE = r"[\x20\x09-\x0D]"
NON_SPACE = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one named in spark.checkpoint.dir; on one machine a local one where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return named or tempfile.gettempdir() + "/sievelight-shared"


def materialize(df: DataFrame, name: str, by: str | None = None, release: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder, in folders of the values of its last column if that is named, and read it back.

    The lineage is cut, no executor holds the only copy, and whoever reads it later gets the same rows. release: the shuffle files behind df,
    which nothing else should read, go once it is written; else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true" if release else before)
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def materialize_all(frames: Iterable[DataFrame], name: str) -> DataFrame:
    """materialize() for the rows of one or more frames, one after the other: the plan that reads them does not grow with their number."""
    path = None
    for df in frames:
        path = path or f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by materialize() that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def memory_bytes(df: DataFrame) -> int:
    """Measured bytes of df as the hash table of a broadcast join: rows with their fields, and the lengths of texts and arrays."""
    fields = 8 * len(df.columns)
    lengths = [F.lit(0)]
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            lengths.append(F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)))
        elif isinstance(f.dataType, T.ArrayType):
            inner = f.dataType.elementType
            lengths.append(F.greatest(F.size(F.col(f"`{f.name}`")), F.lit(0)) * (16 + 8 * len(inner.fields) if isinstance(inner, T.StructType) else 8))
    rows, more = df.agg(F.count(F.lit(1)), F.sum(sum(lengths[1:], lengths[0]).cast("long"))).first()
    return 3 * rows * (8 + fields) + 2 * (more or 0)  # keys, rows and pages of the table come to about thrice the rows


def small(df: DataFrame) -> DataFrame:
    """df, which should be a written table, with a broadcast hint if its measured size is under BROADCAST_BYTES; else it joins by shuffle."""
    return F.broadcast(df) if memory_bytes(df) <= BROADCAST_BYTES else df


def bounded(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df, of at most so many counted rows with fields and arrays of row_bytes, with a broadcast hint if it is small as in small()."""
    return F.broadcast(df) if 3 * rows * (8 + row_bytes) <= BROADCAST_BYTES else df


def running(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """df with _n, the place of each row (from 1) in its group by order, and _<name>, the running sum of each of sums.

    Rows are dealt by ranges of (group, order), so a group of any size is spread over tasks; a task numbers its
    own rows, and what the ranges before it hold of a group is added. The groups have no nulls; order should leave no ties.
    """
    placed = materialize(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "running")
    values = {"_n": F.lit(1), **{f"_{name}": value for name, value in (sums or {}).items()}}
    held = placed.groupBy("_part", *group).agg(*[F.sum(v).alias(k) for k, v in values.items()])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("_part", *group, *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in values])
    upto = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(v).over(upto).alias(k) for k, v in values.items()])
    joined = local.join(offsets, ["_part", *group])  # dealt as the window is: only the offsets move
    return joined.select(*df.columns, *[(F.col(k) + F.col(f"{k}_before")).alias(k) for k in values])


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
