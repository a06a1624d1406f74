import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sievelight.llm import ann, exact_dedup, mixing, simhash


def brute(rows, k=5):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for i, q in rows:
        if i % 50 == 0:
            scored = sorted((-(q * v).sum() / (np.linalg.norm(q) * np.linalg.norm(v)), j) for j, v in rows if j != i)[:k]
            out[i] = [(j, -s) for s, j in scored]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_on_the_given_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = found(ann.nearest(table, lambda i: i % 50 == 0))
    want = brute([(r["vec_id"], r["embedding"]) for r in table.collect()])
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {q: dict(brute_all) for q, brute_all in ((q, [(j, s) for j, s in want[q]]) for q in want)}
    assert all(abs(s - exact[q].get(j, s)) < 1e-12 for q in got for j, s in got[q])


def test_vector_edges(spark):
    rng = np.random.default_rng(0)
    same = [0.5, -1.0, 2.0]
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(0, 120)] + [(i, same) for i in range(200, 260)]
    odd = [(300, None), (350, [0.0, 0.0, 0.0]), (400, [1.0, None, 2.0]), (450, [float("nan"), 1.0, 1.0]), (500, [float("inf"), 1.0, 1.0]), (None, same), (600, [1.0, 2.0]), (50, rows[50][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = found(ann.nearest(df, lambda i: i % 50 == 0, block_rows=16))
    want = brute([(i, np.float32(v)) for i, v in rows])
    assert set(got) == set(want)
    assert [j for j, _ in got[200]] == [201, 202, 203, 204, 205]
    two = spark.createDataFrame(rows[49:52], "vec_id long, embedding array<float>")
    assert {q: sorted(j for j, _ in v) for q, v in found(ann.nearest(two, lambda i: i % 50 == 0)).items()} == {50: [49, 51]}
    assert ann.nearest(two.limit(0), lambda i: i % 50 == 0).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "simhash", "mixing", "bpe"]
    kept = corpus_pipeline.language(spark, docs, sf_dir)
    assert kept.columns == columns
    by_id = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = set(by_id) - {r["doc_id"] for r in kept.collect()}
    assert all(not re.search(r"[^\W\d_]", by_id[i] or "") for i in left)
    foreign = docs.limit(5).withColumn("doc_id", docs["doc_id"] + 10**6).withColumn("text", F.lit("Привет, мир")).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, docs.unionByName(foreign), sf_dir).filter("doc_id >= 1000000").count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, unlabelled, sf_dir).count() == docs.count()
    exact = corpus_pipeline.exact(spark, docs, sf_dir)
    want = {r["doc_id"] for r in exact_dedup.assign_groups(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in exact.collect()} == want and exact.count() == len(want)
    near = corpus_pipeline.near(spark, docs, sf_dir)
    want = {r["component_id"] for r in simhash.near_groups(docs).collect()}
    assert {r["doc_id"] for r in near.collect()} == want
    mixture = corpus_pipeline.mixture(spark, docs, sf_dir)
    assert mixture.columns == columns and mixture.count() == mixing.mix(docs).count()
    last = corpus_pipeline.tokens(spark, docs, sf_dir)
    assert last.count() == docs.count() and {"doc_id", "ids", "n_tokens"} <= set(last.columns)


def test_pipeline_runs_and_takes_nulls(spark, make_docs, tmp_path):
    docs = make_docs("The first text of all.", "The first text of all.", None, "", "Another text here.", (4, "Another text here."), (None, "No id at all."), "123").drop("h", "fp", "key", "count", "shard", "rules")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert 1 not in ids and 2 not in ids and 3 not in ids and 7 not in ids
