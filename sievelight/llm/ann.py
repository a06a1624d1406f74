"""Nearest neighbours by multi-index hashing: learned rotated binary codes, substring indexes, pigeonhole probing, reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievelight.llm.common import materialize, materialize_all, small

#: Rows that the rotations are learned from, and queries among them whose true neighbours the search is fitted to;
#: the index holds every row.
SAMPLE_ROWS, SAMPLE_QUERIES = 4000, 200
#: Bits of a substring, substrings of a code at most, bits of a substring that probing may flip at most, and the bits
#: (whole substrings) that are compared in full.
SUBSTRING, TABLES, MOST_FLIPS, COMPARED = 16, 96, 4, 512
#: Shares of the sample's true neighbours that probing must meet and that the radius over the compared bits must take in.
MEET, TAKE_IN = 0.97, 0.98
#: Queries that scan the table side by side.
BLOCK = 1024
#: Rows are of a cluster if their cosine with its middle is this or more; a cluster has this share of the sample, and rows in it, or more.
NEAR, CLUSTER_SHARE, CLUSTER_ROWS = 0.95, 0.01, 40

_COMPARED = [f"c{i}" for i in range(COMPARED // 64)]
_ONES = np.array([bin(i).count("1") for i in range(1 << SUBSTRING)], np.uint8)


def _ball(flips: int) -> np.ndarray:
    """All values of a substring with up to so many bits."""
    return np.array([sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(SUBSTRING), n)], np.int64)


class Codec:
    """Rotations that turn a vector into signs, the substrings that are indexed, flips probed in each, and the radius.

    By the pigeonhole principle, probing all values within `flips` bits of each of the substrings meets every code
    within (flips + 1) * tables - 1 bits of the indexed ones, and others beyond. The signs are those of the vectors
    themselves or, in a cluster, of what sets them apart from its middle.
    """

    def __init__(self, rotations: np.ndarray, tables: int, flips: int, radius: int, middle: np.ndarray | None = None):
        self.rotations, self.tables, self.flips, self.radius, self.middle = rotations, tables, flips, radius, middle

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        if self.middle is not None:
            x = _unit(x) - self.middle
        return np.packbits(x @ self.rotations > 0, axis=1).view(np.uint16)


def _rotation(unit: np.ndarray, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Iterative quantisation: turn the axes until the vectors lie close to their signs."""
    turn, _ = np.linalg.qr(rng.normal(size=(unit.shape[1],) * 2))
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(unit.T @ np.sign(unit @ turn))
        turn = u @ vt
    return turn


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def scan(vectors: DataFrame, asked: list[tuple[int, list[float]]], k: int, dim: int) -> DataFrame:
    """(query_id, vec_id, score): the k rows of vectors(id, v) nearest to each asked (id, v), itself included.

    Every row is compared in the task that reads it; each batch hands on k rows a query.
    """
    ids = np.array([i for i, _ in asked], np.int64)
    held = vectors.sparkSession.sparkContext.broadcast(np.array([v for _, v in asked], np.float64).reshape(-1, dim))

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        norms = np.linalg.norm(q, axis=1)
        for batch in frames:
            x, own = _rows(batch.column(1), dim), batch.column(0).to_numpy(zero_copy_only=False)
            if not len(x):
                continue
            score = (q @ x.T) / (norms[:, None] * np.linalg.norm(x, axis=1))
            n = min(k, len(x))
            # Of rows that tie at the end of the list all go on, so that the smaller ids can be told later.
            least = -np.partition(-score, n - 1, axis=1)[:, n - 1]
            at, near = np.nonzero(score >= least[:, None] - 1e-12)
            exact = (q[at] * x[near]).sum(axis=1) / (norms[at] * np.linalg.norm(x[near], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(own[near].astype(np.int64)), pa.array(exact)], ["query_id", "vec_id", "score"])

    return best(vectors.select("id", "v").mapInArrow(batches, "query_id long, vec_id long, score double"), k)


def best(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each query by score and then by id, with their rank from 1; tasks drop the rest before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def drawn(vectors: DataFrame, n: int, seed: int = 1) -> list[tuple[int, list[float]]]:
    """About SAMPLE_ROWS of the n rows of vectors(id, v), by a hash of the id; at least one."""
    part = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) <= min(1.0, SAMPLE_ROWS / max(1, n)) * (1 << 20)
    return sorted((r["id"], r["v"]) for r in vectors.filter(part).limit(2 * SAMPLE_ROWS).collect()) or [(r["id"], r["v"]) for r in vectors.limit(1).collect()]


def learn(vectors: DataFrame, k: int, dim: int, queries: int, *, middle: np.ndarray | None = None, seed: int = 1) -> Codec:
    """Codec fitted to the true neighbours, among all rows of vectors(id, v), of queries drawn by a hash of the id.

    Of all numbers of substrings and flips that meet the share MEET of those neighbours, the ones that make the search
    cheapest are taken, by what probes, postings and meetings they come to. What reaches the driver is bounded.
    """
    n = vectors.count()
    rows = drawn(vectors, n, seed)
    rng = np.random.default_rng(seed)
    sample = np.array([v for _, v in rows], np.float64)
    aside = _unit(sample) - (0 if middle is None else middle)
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    aside = np.divide(aside, length, out=np.zeros_like(aside), where=length > 0)
    rotations = np.hstack([_rotation(aside, rng) for _ in range(-(-TABLES * SUBSTRING // dim))])[:, : TABLES * SUBSTRING]
    codec = Codec(rotations, TABLES, MOST_FLIPS, COMPARED, middle)
    asked = [rows[i] for i in rng.permutation(len(rows))[:SAMPLE_QUERIES]]
    near = materialize(scan(vectors, asked, k + 1, dim).filter("query_id != vec_id").select("query_id", F.col("vec_id").alias("id")), "ann-sample")
    pairs = near.join(vectors, "id").select("query_id", "v").collect()
    if not pairs:
        return codec
    by_id = dict(asked)
    a = codec.encode(np.array([by_id[r["query_id"]] for r in pairs], np.float64))
    b = codec.encode(np.array([r["v"] for r in pairs], np.float64))
    apart = _ONES[a ^ b]
    codec.radius = int(np.quantile(apart[:, : COMPARED // SUBSTRING].sum(axis=1, dtype=np.int64), TAKE_IN, method="higher"))
    q, x = codec.encode(np.array([v for _, v in asked], np.float64)), codec.encode(sample)
    costs = []
    for flips in range(MOST_FLIPS + 1):
        met = np.logical_or.accumulate(apart <= flips, axis=1).mean(axis=0)
        chance = np.array([(_ONES[q[:, j, None] ^ x[None, :, j]] <= flips).mean() for j in range(TABLES)])
        for tables in np.flatnonzero(met >= MEET)[:1] + 1:
            costs.append((queries * tables * len(_ball(flips)) * 10 + n * tables * 30 + n * queries * chance[:tables].sum() * 4, int(tables), flips))
    if costs:
        _, codec.tables, codec.flips = min(costs)
    return codec


def _postings(vectors: DataFrame, codec: Codec, dim: int, probe: bool) -> DataFrame:
    """(key, id, c0, c1, ...) of vectors(id, v): a row for each substring's value, or for each value within the flips of it.

    key is the substring's number and value; the others are the bits that are compared in full.
    """
    held = vectors.sparkSession.sparkContext.broadcast(codec)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held.value
        ball = _ball(codec.flips if probe else 0)
        tables = np.arange(codec.tables, dtype=np.int64)[None, :, None] << SUBSTRING
        step = max(1, 500_000 // (codec.tables * len(ball)))
        for batch in frames:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                codes = codec.encode(_rows(part.column(1), dim))
                keys = tables | (codes[:, : codec.tables, None].astype(np.int64) ^ ball)
                n = keys.shape[1] * keys.shape[2]
                full = np.ascontiguousarray(codes[:, : COMPARED // SUBSTRING]).view(np.int64)
                columns = [keys.reshape(-1), *(np.repeat(c, n) for c in (part.column(0).to_numpy(zero_copy_only=False), *full.T))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", *_COMPARED])

    return vectors.select("id", "v").mapInArrow(batches, ", ".join(f"{c} long" for c in ("key", "id", *_COMPARED)))


def _rerank(pairs: DataFrame, dim: int) -> DataFrame:
    """(query_id, vec_id, score) of pairs(query_id, vec_id, q, x): the cosine in double precision."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            q, x = _rows(batch.column(2), dim), _rows(batch.column(3), dim)
            score = (q * x).sum(axis=1) / (np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query_id", "vec_id", "score"])

    return pairs.select("query_id", "vec_id", "q", "x").mapInArrow(batches, "query_id long, vec_id long, score double")


def _is_first(codec: Codec) -> Column:
    """Whether a pair that met in one substring meets in none before it, as far as the compared bits tell."""
    first = F
    for j in range(min(codec.tables, COMPARED // SUBSTRING)):
        word = F.col(_COMPARED[j // 4]).bitwiseXOR(F.col(f"q{_COMPARED[j // 4]}"))
        meets = F.bit_count(F.shiftrightunsigned(word, SUBSTRING * (j % 4)).bitwiseAND(F.lit((1 << SUBSTRING) - 1))) <= codec.flips
        first = first.when(meets, j)
    own = F.shiftright("key", SUBSTRING)
    return first.otherwise(own) == own


def candidates(queries: DataFrame, vectors: DataFrame, codec: Codec, dim: int) -> DataFrame:
    """(query_id, vec_id): rows that probing meets and whose compared bits lie within the radius, each pair once.

    Postings and probes are shuffled on the substring's value, so a task sees the rows of its values alone.
    """
    index = _postings(vectors, codec, dim, False)
    probes = _postings(queries, codec, dim, True).toDF("key", "query_id", *[f"q{c}" for c in _COMPARED])
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"q{c}"))) for c in _COMPARED), F.lit(0))
    # Spark takes both sides for as small as the vectors that they are made of, and would broadcast one of them.
    met = probes.join(index.hint("merge"), "key").filter(apart <= codec.radius).filter(_is_first(codec))
    return met.select("query_id", F.col("id").alias("vec_id")).distinct()


def _within(queries: DataFrame, rows: DataFrame, codec: Codec, k: int, dim: int) -> DataFrame:
    """(query_id, vec_id, score): the k + 1 nearest of rows(id, v) found for each of queries(id, v), itself included."""
    met = materialize(candidates(queries, rows, codec, dim), "ann-met")
    pairs = met.join(rows.select(F.col("id").alias("vec_id"), F.col("v").alias("x")), "vec_id").join(small(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q"))), "query_id")
    return materialize(best(_rerank(pairs, dim), k + 1).drop("rank"), "ann-found")


def middles(sample: np.ndarray) -> np.ndarray:
    """Unit middles of the dense clusters of a sample: the largest first, until too few rows are left around any."""
    unit = _unit(sample)
    near = np.vstack([unit[at : at + 500] @ unit.T >= NEAR for at in range(0, len(unit), 500)])
    left, found = np.ones(len(unit), bool), []
    while True:
        sizes = np.count_nonzero(near & left, axis=1)
        at = int(sizes.argmax())
        if sizes[at] < max(CLUSTER_ROWS, CLUSTER_SHARE * len(unit)):
            return np.array(found).reshape(-1, unit.shape[1])
        mean = unit[near[at] & left].mean(axis=0)
        found.append(mean / np.linalg.norm(mean))
        left &= ~near[at]


def _clustered(vectors: DataFrame, centres: np.ndarray, dim: int) -> DataFrame:
    """vectors(id, v) with to_middle, the cosine with the nearest middle, and cluster, its number or -1 where that is under NEAR."""
    held = vectors.sparkSession.sparkContext.broadcast(centres)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            cosine = _unit(_rows(batch.column(1), dim)) @ held.value.T
            nearest = cosine.argmax(axis=1)
            top = np.take_along_axis(cosine, nearest[:, None], 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(top), pa.array(np.where(top >= NEAR, nearest, -1).astype(np.int32))], schema.names)

    schema = vectors.select("id", "v").withColumn("to_middle", F.lit(0.0)).withColumn("cluster", F.lit(0)).schema
    return vectors.select("id", "v").mapInArrow(batches, schema)


def _elsewhere(queries: DataFrame, centres: np.ndarray, widths: dict[int, float], dim: int) -> DataFrame:
    """(id, v, other) of queries(id, v, cluster, least): other clusters that may hold a row nearer than the cosine least.

    By the triangle inequality of angles no row of a cluster is nearer to a query than the middle is, less the
    cluster's width; rows of no cluster (-1) lie outside the width of NEAR around the query's own middle.
    """
    held = queries.sparkSession.sparkContext.broadcast((centres, widths))
    schema = queries.select("id", "v").withColumn("other", F.lit(0)).schema

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, widths = held.value
        for batch in frames:
            angle = np.arccos(np.clip(_unit(_rows(batch.column(1), dim)) @ centres.T, -1, 1))
            own, least = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            for other, width in widths.items():
                bound = angle[:, other] - width if other >= 0 else np.arccos(NEAR) - np.take_along_axis(angle, np.maximum(own, 0)[:, None], 1)[:, 0]
                may = (own != other) & (np.cos(np.maximum(bound, 0)) >= least - 1e-9)
                part = batch.select([0, 1]).filter(pa.array(may))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(part), other, np.int32))], schema.names)

    return queries.select("id", "v", "cluster", "least").mapInArrow(batches, schema)


def _by_clusters(queries: DataFrame, rows: DataFrame, centres: np.ndarray, k: int, dim: int) -> DataFrame:
    """_within() where rows lie in dense clusters: each has an index of its own, of what sets its rows apart from its middle.

    Otherwise all rows of a cluster would share most of their bits, and meet each of its queries. A query looks into
    its own cluster first and then into those that its bound does not rule out.
    """
    rows = materialize(_clustered(rows, centres, dim), "ann-clusters", by="cluster")
    widths = {r["cluster"]: float(np.arccos(min(1.0, r["least"]))) for r in rows.groupBy("cluster").agg(F.min("to_middle").alias("least")).collect()}
    queries = materialize(rows.join(small(queries.select("id")), "id", "left_semi").select("id", "v", "cluster"), "ann-cluster-queries")
    asked = {r["cluster"]: r["count"] for r in queries.groupBy("cluster").count().collect()}
    parts = {c: rows.filter(F.col("cluster") == c).select("id", "v") for c in widths}
    codecs = {c: learn(part, k, dim, asked.get(c, 1), middle=centres[c] if c >= 0 else None) for c, part in parts.items()}
    found = materialize_all((_within(queries.filter(F.col("cluster") == c).select("id", "v"), parts[c], codecs[c], k, dim) for c in sorted(asked)), "ann-own")
    full = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    bounds = queries.join(full, "id", "left").withColumn("least", F.when(F.col("n") > k, F.col("kth")).otherwise(-1.0))
    more = materialize(_elsewhere(bounds, centres, widths, dim), "ann-elsewhere")
    others = sorted(r["other"] for r in more.select("other").distinct().collect())
    if not others:
        return found
    beyond = materialize_all((_within(more.filter(F.col("other") == c).select("id", "v"), parts[c], codecs[c], k, dim) for c in others), "ann-beyond")
    return materialize(best(found.unionByName(beyond), k + 1).drop("rank"), "ann-found")


def _search(rows: DataFrame, is_query: Callable[[Column], Column], k: int, dim: int, block: int) -> DataFrame:
    """nearest() for rows (id, v) of one length."""
    repeated = rows.groupBy("id").count().filter("count > 1").select("id")
    if not repeated.isEmpty():  # of rows with one id the least vector counts, whichever comes first
        repeated = materialize(repeated, "ann-repeated")
        one = rows.join(small(repeated), "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
        rows = materialize(rows.join(small(repeated), "id", "left_anti").unionByName(one), "ann-rows")
    # Equal vectors are searched as one: the first k + 1 ids of each are all that an answer can hold. Hashes name those that may be equal.
    hashed = rows.withColumn("h", F.xxhash64("v"))
    shared = materialize(hashed.groupBy("h").count().filter("count > 1").select("h"), "ann-hashes")
    alike = materialize(hashed.join(small(shared), "h", "left_semi"), "ann-alike")
    groups = materialize(alike.groupBy("h", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "ann-groups")
    asked = materialize(rows.filter(is_query(F.col("id"))).select("id"), "ann-asked")
    copies = None
    if groups.isEmpty():
        ours = asked.select("id", F.col("id").alias("rep"))
    else:
        member = materialize(alike.join(small(groups), ["h", "v"]).select("id", "rep"), "ann-members")
        gone = materialize(member.filter("id != rep").select("id"), "ann-gone")
        rows = materialize(rows.join(small(gone), "id", "left_anti"), "ann-distinct")
        first = Window.partitionBy("rep").orderBy("id")
        copies = materialize(member.withColumn("no", F.row_number().over(first)).filter(F.col("no") <= k + 1).select("rep", F.col("id").alias("copy")), "ann-copies")
        ours = asked.join(member, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    ours = materialize(ours, "ann-queries")
    wanted = materialize(ours.select(F.col("rep").alias("id")).distinct(), "ann-wanted")
    queries = materialize(rows.join(small(wanted), "id"), "ann-query-vectors")
    centres = middles(np.array([v for _, v in drawn(rows, rows.count())], np.float64))
    if len(centres):
        found = _by_clusters(queries, rows, centres, k, dim)
    else:
        found = _within(queries, rows, learn(rows, k, dim, queries.count()), k, dim)

    def expanded(found: DataFrame) -> DataFrame:
        """Each distinct vector as the ids that have it."""
        if copies is None:
            return found
        every = found.join(small(copies), F.col("vec_id") == F.col("rep"), "left")
        return best(every.select("query_id", F.coalesce("copy", "vec_id").alias("vec_id"), "score"), k + 1).drop("rank")

    found = expanded(found)
    # A query that met too few rows widens its radius to all bits, where probing comes to a scan; in blocks of queries.
    full = found.groupBy("query_id").count().filter(F.col("count") > k).select(F.col("query_id").alias("id"))
    short = materialize(queries.join(full, "id", "left_anti"), "ann-short")
    n_short = short.count()
    if n_short:
        blocks = -(-n_short // block)
        parts = (short.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) for b in range(blocks))
        scans = materialize_all((scan(rows, [(r["id"], r["v"]) for r in part.collect()], k + 1, dim).drop("rank") for part in parts), "ann-widened")
        found = found.join(small(short.select(F.col("id").alias("query_id"))), "query_id", "left_anti").unionByName(expanded(scans))
    answers = ours.join(found, F.col("rep") == F.col("query_id")).filter("id != vec_id").select(F.col("id").alias("query_id"), "vec_id", "score")
    return best(answers, k)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (id, v) that can take part: with an id, and a vector of finite numbers that are not all zero."""
    fit = F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.filter(fit)


def nearest(vectors: DataFrame, is_query: Callable[[Column], Column], *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found by cosine for each row that is_query(id) names.

    Signs of learned rotations make a code of each vector, which is split into substrings. Postings (substring,
    value) of all rows and probes of the queries, which flip few bits of each substring, are shuffled on the value
    and meet there; by the pigeonhole principle all codes within a radius are met. Of those met, the ones whose
    compared bits lie within the learned radius are ranked by their original vectors in double precision. How many
    substrings and flips that takes is learned. That radius may be wider than the guaranteed one: codes between them
    are met with the learned chance (MEET of the sample's true neighbours). Dense clusters of near-equal vectors have
    indexes of their own, over what sets their rows apart. A query that finds fewer than k rows is widened to all
    bits, block_rows of them at a time.

    Vectors are compared with those of their own length, as the cosine has no meaning between others. Equal
    vectors are searched once, however many rows have them. A query's own id is never a candidate; of rows that
    repeat an id the one with the least vector counts. Rows that usable() turns away take no part. Ties go to the
    smaller id. Without candidates there are no rows. Other columns are ignored.
    """
    given = usable(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")))
    rows = materialize(given.withColumn("dim", F.size("v")), "ann-given")
    dims = sorted(r["dim"] for r in rows.select("dim").distinct().collect())
    if not dims:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_search(rows.filter(F.col("dim") == dim).select("id", "v"), is_query, k, dim, block_rows) for dim in dims]
    return reduce(DataFrame.unionByName, found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
