import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of texts or (id, text) or (id, text, source), in three partitions, with a column that clashes with inner names."""
    from pyspark.sql import functions as F

    def make(*rows):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            full.append((r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")))
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        return df.withColumn("h", F.lit("clash")).withColumn("fp", F.lit(1)).withColumn("key", F.lit(2)).withColumn("count", F.lit(3)).withColumn("shard", F.lit(9)).withColumn("rules", F.lit("x"))

    return make


@pytest.fixture(scope="session")
def small_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
