"""The pipeline's stages over columns of any names, repeated ids and long texts."""

import corpus_pipeline
from pyspark.sql import functions as F


def named(make_docs, *rows):
    return make_docs(*rows).withColumn("a.b", F.lit("x")).withColumn("found", F.lit(1)).withColumn("row", F.lit(2)).withColumn("id", F.lit(3)).withColumn("own", F.lit(4))


def test_stages_keep_columns_of_any_name(spark, make_docs):
    long = "the cat sat on the mat and " * 30_000
    docs = named(make_docs, "the cat sat on the mat", "The cat sat on the mat", long, None, "", "the dog lay on the rug by a fire")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert out.count() > 0 and out.select("`a.b`").distinct().count() == 1, name
        assert stage(spark, docs.limit(0), "").count() == 0, name


def test_rows_that_repeat_an_id_leave_by_their_own_text(spark, make_docs):
    text = " ".join(f"w{i}" for i in range(60))
    docs = make_docs((1, text), (5, text + " end"), (5, "something else that has nothing to do with the other text"))
    left = sorted((r["doc_id"], r["text"][:9]) for r in dict(corpus_pipeline.STAGES)["simhash"](spark, docs, "").collect())
    assert left == [(1, "w0 w1 w2 "), (5, "something")]
