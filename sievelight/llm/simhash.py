"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievelight.llm.common import NON_SPACE, materialize, small
from sievelight.llm.components import connected_components

SEED = 42
#: The wide search: 32-bit SimHashes of a text, and bits of each that are flipped in turn, the least certain ones.
TABLES, FLIPS = 16, 8
#: Bits of all tables in which candidates of the balls may differ; what this leaves out, the index of rare shingles finds.
FAR_BITS = TABLES * 32 * 3 // 10
#: Counters of how many texts hold a shingle: a table of fixed size, 4 MiB, that every task gets.
COUNTERS = 1 << 20


def _fingerprint(text: bytes | None, width: int) -> int:
    """Bits set in over half of the shingles' hashes. bytes.lower and bytes.split know ASCII alone, as wanted."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # blocks: a very long text needs no more memory than these
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) for every row and whole text; null and blank texts have fp 0."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            fps = pa.array((_fingerprint(t.as_py(), shingle_words) for t in batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(batches, f"doc_id {kind}, fp long")


def ball_links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) that join all fingerprints at max_bits or fewer differing bits; fps(fp) must be distinct.

    Every fingerprint emits all variants within max_bits / 2 flips. Two fingerprints are within max_bits if and
    only if they share a variant, so a shuffle on the variant brings each such pair together. Fingerprints
    that share a variant are all within max_bits of each other, so a chain through them in order links what
    all their pairs would, without emitting the pairs. A variant is shared by at most as many fingerprints as a
    ball holds (65 for 2 bits), whatever the data: no key is hot.
    """
    if max_bits % 2 or not 0 <= max_bits <= 4:
        raise ValueError("max_bits must be 0, 2 or 4")
    masks = sorted({sum(1 << i for i in bits) for n in range(max_bits // 2 + 1) for bits in combinations(range(64), n)})
    flips = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
    balls = fps.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "fp")
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = balls.withColumn("a", before).filter("a is not null").select("a", F.col("fp").alias("b")).distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def _grouped(fps: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of fps(doc_id, fp, ...) with component_id, joined by links(a, b) between fingerprints."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = materialize(connected_components(links), "simhash-roots")
    linked = nodes.join(small(roots), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = materialize(linked, "simhash-linked")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    # Written out, so that the last join reads plain exchanges and Spark can split a hot fingerprint.
    named = materialize(linked.join(materialize(names, "simhash-names"), "root").select("fp", "component_id"), "simhash-named")
    return fps.join(named, "fp").select(*fps.columns, "component_id")


def near_groups(docs: DataFrame, *, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links, itself included).

    Texts are read once and never shuffled; copies collapse to one fingerprint before candidates are formed.
    Null, blank and empty texts have fingerprint zero and link like any other. Repeated rows are returned each.
    Rows without a doc_id are returned and link, but never name a component unless it has no other id. An
    empty table gives no rows; other columns are ignored.
    """
    fps = materialize(fingerprints(docs, shingle_words), "simhash-fps")
    links = ball_links(fps.select("fp").distinct(), max_bits)
    return _grouped(fps, links).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Hashes of the different shingles, ascending; a text of fewer words is one shingle."""
    words = text.split()
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8"))


def _sketch(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """Bits of all tables by majority over the shingles, and the FLIPS bits of each table with the closest votes."""
    words = np.arange(1, TABLES // 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(TABLES * 32, dtype=np.int64)
    for at in range(0, len(hashes), 4080):  # blocks: a very long text needs no more memory than these
        z = hashes[at : at + 4080, None] + words
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        bits = np.unpackbits(z.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        for part in range(0, len(bits), 255):  # as many rows as a byte can count
            ones += bits[part : part + 255].sum(axis=0, dtype=np.uint8)
    votes = 2 * ones - len(hashes)
    low = np.argsort(np.abs(votes).reshape(TABLES, 32), axis=1, kind="stable")[:, :FLIPS]
    return np.packbits(votes > 0, bitorder="little").tobytes(), low.astype(np.uint8).tobytes()


def _rarest(hashes: np.ndarray, counters: np.ndarray, share: float) -> np.ndarray:
    """The rarest shingles, of which two sets that have this share of the larger one in common have one in common."""
    p = len(hashes) - math.ceil(share * len(hashes) - 1e-6) + 1
    return hashes[np.lexsort((hashes, counters[hashes & np.uint64(COUNTERS - 1)]))[:p]]


def _words(text: Column) -> Column:
    """The words in lower case (ASCII alone) with one space between them; null is the empty text."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat_ws(" ", F.regexp_extract_all(lower, F.lit(f"({NON_SPACE}+)")))


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def shingle_counters(texts: DataFrame, shingle_words: int) -> np.ndarray:
    """For each value of a shingle hash's last bits the number of texts(words) that hold such a shingle, one table of COUNTERS numbers.

    A task adds up its own texts and hands on the counters it touched. Any counts give a right order of shingles
    below; the better they tell frequent shingles from rare ones, the fewer candidates there are.
    """

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, dtype=np.int64)
        for batch in frames:
            for t in batch.column(0):
                slots, n = np.unique(_shingle_hashes(t.as_py(), shingle_words) & np.uint64(COUNTERS - 1), return_counts=True)
                held[slots.astype(np.int64)] += n
        used = np.flatnonzero(held)
        for at in range(0, len(used), 65536):
            part = used[at : at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(held[part])], ["slot", "n"])

    sums = texts.select("words").mapInArrow(batches, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counters = np.zeros(COUNTERS, dtype=np.uint32)
    counters[sums["slot"].to_numpy()] = np.minimum(sums["n"].to_numpy(), 0xFFFFFFFF)
    return counters


def rare_pairs(made: DataFrame, resemblance: float) -> DataFrame:
    """Candidate pairs (a, b) of made(fp, root, n, rare) with different roots: none of this resemblance is left out.

    n is the size of a set of shingles, rare its rarest ones in one order for all. Of two sets that resemble each other, the
    larger has at least t = resemblance of its size in common with the smaller, so a shingle that both hold is among the
    1 - t rarest of the larger; for the smaller, the first 1 - 2t / (1 + t) do. At the first one that they share, what is left of both
    must be enough (prefix and positional filters: Chaudhuri et al., 2006; Xiao et al., 2008). Joined by equal shingles,
    so that Spark can split a frequent one.
    """
    t = resemblance
    places = made.select("fp", "root", "n", F.posexplode("rare").alias("i", "h"))
    first = F.col("n") - F.ceil(F.col("n") * (2 * t / (1 + t)) - 1e-6) + 1
    x, y = (side.select("h", *[F.col(c).alias(f"{c}_{name}") for c in ("fp", "root", "n", "i")]) for side, name in ((places, "x"), (places.filter(F.col("i") < first), "y")))
    smaller = (F.col("n_y") < F.col("n_x")) | ((F.col("n_y") == F.col("n_x")) & (F.col("fp_y") < F.col("fp_x")))
    left = F.least(F.col("n_x") - F.col("i_x"), F.col("n_y") - F.col("i_y"))
    enough = left * (1 + t) >= (F.col("n_x") + F.col("n_y")) * t - 1e-3
    met = x.join(y, (x["h"] == y["h"]) & smaller & (F.col("n_y") >= F.col("n_x") * t - 1e-3) & enough & (F.col("root_x") != F.col("root_y")))
    return met.select(F.least("fp_x", "fp_y").alias("a"), F.greatest("fp_x", "fp_y").alias("b")).distinct()


def resemblance_links(docs: DataFrame, *, shingle_words: int = 5, resemblance: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, fp) of every row, key being a hash of its text and fp one of its words, and links (a, b) of fps whose shingles resemble each other.

    The links join all texts that a chain of resemblances joins; the Jaccard resemblance of the sets of shingles decides. Only
    shingles of candidates are shuffled. Candidates are found in three steps, each of which leaves out pairs that
    the steps before put into one group, as these could join nothing:

    1. Each text has TABLES independent 32-bit SimHashes; texts with an equal one are tried against the first of its bucket.
    2. Balls of radius one around each SimHash, over the bits whose votes were closest and that a change flips first, meet on
       shared variants. A text is tried against the first of its bucket and the five before it, if they differ in at most FAR_BITS.
    3. What chance and these bounds leave is found by an index of the texts' rarest shingles, which misses nothing (rare_pairs).

    The first two make groups of copies, however large, without their pairs; the third makes the result exact.
    """

    def variants(frames: Iterator[pa.RecordBatch], flips: int) -> Iterator[pa.RecordBatch]:
        tables = np.arange(TABLES, dtype=np.int64)[None, :, None] << 32
        for batch in frames:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                base = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u4").reshape(-1, TABLES, 1).astype(np.int64)
                low = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(-1, TABLES, FLIPS)[:, :, :flips].astype(np.int64)
                ball = np.concatenate([base, base ^ (np.int64(1) << low)], axis=2) | tables
                fp, root = (np.repeat(part.column(i).to_numpy(zero_copy_only=False), TABLES * (flips + 1)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(ball.reshape(-1)), pa.array(fp), pa.array(root)], ["variant", "fp", "root"])

    def close(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, TABLES * 4) for i in (2, 3))
            near = np.unpackbits(a ^ b, axis=1).sum(axis=1) <= FAR_BITS
            yield batch.select([0, 1]).filter(pa.array(near))

    def shingles(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            sets = pa.array((_shingle_hashes(t.as_py(), shingle_words).view("<i8") for t in batch.column(1)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["fp", "shingles"])

    texts = docs.select("doc_id", _text_key().alias("key"), _words(F.col("text")).alias("words")).select("doc_id", "key", F.xxhash64("words").alias("fp"), F.col("words").cast("binary").alias("words"))
    fps = materialize(texts.select("doc_id", "key", "fp"), "simhash-fps")
    counters = docs.sparkSession.sparkContext.broadcast(shingle_counters(texts, shingle_words))

    def sketches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            hashes = [_shingle_hashes(t.as_py(), shingle_words) for t in batch.column(1)]
            made = [_sketch(h) for h in hashes]
            rare = pa.array((_rarest(h, counters.value, resemblance).view("<i8") for h in hashes), pa.list_(pa.int64()))
            columns = [pa.array([len(h) for h in hashes], pa.int64()), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary()), rare]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["fp", "n", "sketch", "low", "rare"])

    described = texts.select("fp", "words").mapInArrow(sketches, "fp long, n long, sketch binary, low binary, rare array<long>")
    made = materialize(described.dropDuplicates(["fp"]), "simhash-sketches")
    ball = "variant long, fp long, root long"

    def candidates(rooted: DataFrame, flips: int, before: int) -> DataFrame:
        """Pairs (a, b) of different groups: in each bucket the first and those up to `before` places ahead of b."""
        balls = rooted.select("fp", "root", "sketch", "low").mapInArrow(lambda frames: variants(frames, flips), ball)
        bucket = Window.partitionBy("variant").orderBy("root", "fp")
        own = F.struct("fp", "root")
        others = F.array(F.first(own).over(bucket), *[F.lag(own, n).over(bucket) for n in range(1, before + 1)])
        met = balls.select("fp", F.array_distinct(F.transform(F.filter(others, lambda x: x["root"] != F.col("root")), lambda x: x["fp"])).alias("others"))
        pairs = materialize(met.select(F.explode("others").alias("a"), F.col("fp").alias("b")).distinct(), "simhash-pairs")
        for side in "ab":
            pairs = pairs.join(made.select(F.col("fp").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)
        alike = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * resemblance
        return pairs.filter(alike).select("a", "b", "s_a", "s_b").mapInArrow(close, "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs whose sets of shingles resemble each other."""
        pairs = materialize(pairs, "simhash-close")
        ask = materialize(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "simhash-ask")
        asked = texts.join(small(ask), "fp", "left_semi").select("fp", "words").mapInArrow(shingles, "fp long, shingles array<long>")
        sets = materialize(asked.groupBy("fp").agg(F.first("shingles").alias("shingles")), "simhash-shingles")
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("fp").alias(side), F.col("shingles").alias(f"s_{side}")), side)
        common = F.size(F.array_intersect("s_a", "s_b"))
        return materialize(pairs.filter(common >= (F.size("s_a") + F.size("s_b") - common) * resemblance).select("a", "b"), "simhash-links")

    def rooted(links: DataFrame) -> DataFrame:
        roots = materialize(connected_components(links), "simhash-groups").select(F.col("node").alias("fp"), "root")
        return made.join(small(roots), "fp", "left").withColumn("root", F.coalesce("root", "fp"))

    links = verified(candidates(made.withColumn("root", F.col("fp")), 0, 0))
    links = links.unionByName(verified(candidates(rooted(links), FLIPS, 5)))
    return fps, links.unionByName(verified(rare_pairs(rooted(links), resemblance)))


def resembling_groups(docs: DataFrame, *, shingle_words: int = 5, resemblance: float = 0.8) -> DataFrame:
    """doc_id, component_id by the links of resemblance_links; rows, ids and nulls are treated as in near_groups."""
    fps, links = resemblance_links(docs, shingle_words=shingle_words, resemblance=resemblance)
    return _grouped(fps, links).select("doc_id", "component_id")


def keep_one(docs: DataFrame, *, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """docs without near copies: of each group of near_groups the smallest id stays, with all columns, whatever their names.

    The ids that leave are broadcast if their measured number is small, and joined by shuffle otherwise. Rows
    without an id stay. Where an id is repeated, its rows leave together if one of them does.
    """
    groups = near_groups(docs, shingle_words=shingle_words, max_bits=max_bits)
    return _without(docs, groups.filter("doc_id != component_id").select("doc_id"))


def keep_one_resembling(docs: DataFrame, *, shingle_words: int = 5, resemblance: float = 0.8) -> DataFrame:
    """docs without near copies, as keep_one leaves them, by the groups of resembling_groups.

    Rows that repeat an id with different texts leave or stay each by its own text.
    """
    fps, links = resemblance_links(docs, shingle_words=shingle_words, resemblance=resemblance)
    return _without(docs, _grouped(fps, links).filter("doc_id != component_id").select("doc_id", "key"))


def _without(docs: DataFrame, leave: DataFrame) -> DataFrame:
    """docs without the rows whose id (and key of the text, if given) is listed. Rows travel in one struct, so that columns of any name are safe."""
    leave = small(materialize(leave.distinct(), "simhash-leave"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), _text_key().alias("own"))
    same = rows["id"] == leave["doc_id"]
    if "key" in leave.columns:
        same = same & (rows["own"] == leave["key"])
    return rows.join(leave, same, "left_anti").select("row.*")
