import numpy as np
from pyspark.sql import functions as F

from sievelight.llm import ann
from sievelight.llm.common import materialize


def clustered(n, seed=0):
    """A third of all vectors lies close around one point, a fifth around another, the rest anywhere; none are equal."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 48))
    a, b = (8 * np.sqrt(48) * v / np.linalg.norm(v) for v in rng.normal(size=(2, 48)))
    kind = rng.random(n)
    x[kind < 1 / 3] += a
    x[(kind >= 1 / 3) & (kind < 8 / 15)] += b
    return x.astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def recall(x, got, every=20):
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits, asked = 0, range(0, len(x), every)
    for q in asked:
        score = unit @ unit[q]
        score[q] = -2
        hits += len(set(np.argsort(-score)[:5].tolist()) & got.get(q, set()))
    return hits / (5 * len(asked))


def test_near_equal_vectors_are_found_among_their_like(spark):
    x = clustered(6000)
    got = {}
    for r in ann.nearest(frame(spark, x), lambda i: i % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == set(range(0, 6000, 20)) and all(len(v) == 5 for v in got.values())
    assert recall(x, got) >= 0.9


def test_a_cluster_does_not_meet_itself_whole(spark):
    x = clustered(6000)
    centres = ann.middles(x)
    assert len(centres) == 2
    rows = materialize(ann._clustered(frame(spark, x).toDF("id", "v"), centres, 48), "t", by="cluster")
    sizes = {r["cluster"]: r["count"] for r in rows.groupBy("cluster").count().collect()}
    assert set(sizes) == {-1, 0, 1} and sizes[0] > 1800 and sizes[1] > 1000
    part = rows.filter("cluster = 0").select("id", "v")
    queries = part.filter("id % 20 = 0")
    codec = ann.learn(part, 5, 48, queries.count(), middle=centres[0])
    plain = ann.learn(rows.select("id", "v"), 5, 48, 300)
    pairs = queries.count() * sizes[0]
    assert ann.candidates(queries, part, plain, 48).count() > 0.9 * pairs  # what signs of the vectors themselves come to
    assert ann.candidates(queries, part, codec, 48).count() < 0.25 * pairs


def test_bounds_leave_out_no_cluster_with_a_nearer_row(spark):
    x = clustered(1500, seed=3)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    centres = ann.middles(x)
    rows = materialize(ann._clustered(frame(spark, x).toDF("id", "v"), centres, 48), "t", by="cluster")
    of = {r["id"]: r["cluster"] for r in rows.select("id", "cluster").collect()}
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -2)
    members = {c: np.array([i for i in of if of[i] == c]) for c in set(of.values())}
    least = {i: float(np.sort(cosine[i, members[of[i]]])[-5]) for i in of}
    widths = {r["cluster"]: float(np.arccos(r["m"])) for r in rows.groupBy("cluster").agg(F.min("to_middle").alias("m")).collect()}
    kth = spark.createDataFrame(list(least.items()), "id long, least double")
    more = {(r["id"], r["other"]) for r in ann._elsewhere(rows.join(kth, "id"), centres, widths, 48).collect()}
    for i in of:
        for c, own in members.items():
            if c != of[i] and cosine[i, own].max() > least[i]:
                assert (i, c) in more
    assert len(more) < len(of) * len(members)


def test_equal_hashes_are_compared(spark, monkeypatch):
    x = clustered(120, seed=5)
    x[60:] = x[:60]
    monkeypatch.setattr(ann.F, "xxhash64", lambda *cols: F.lit(7).cast("long"))
    got = {}
    for r in ann.nearest(frame(spark, x), lambda i: i % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert set(got) == {0, 20, 40, 60, 80, 100}
    assert all(v[1] == (q + 60) % 120 for q, v in got.items())
