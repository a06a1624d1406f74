"""Quality classifier: zstandard dictionaries from good and bad text; the compressed-size difference becomes a score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from sievelight.llm.common import materialize, small

#: The sample that is learned from: labelled rows of each class, whatever the length of their texts, and pieces of CHUNK
#: bytes that train a dictionary. These bound what reaches the driver; scoring reads every row and whole text.
MAX_TRAIN, MAX_PIECES = 1500, 8000
DICT_BYTES, CHUNK, LEVEL = 64 << 10, 2048, 3
#: Bytes added to a text's length before the difference is divided by it, so that very short texts stay near zero.
LEAST = 64


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null where the id is null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


class Model:
    """Two dictionaries and the curve that makes the normalised difference of compressed sizes a chance."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = good, bad
        self.at, self.slope = 0.0, 0.0

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        plain = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) if d else zstandard.ZstdCompressor(**plain) for d in (self.good, self.bad)]

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic calibration by Newton steps; weight restores the classes' shares."""
        mean, scale = x.mean(), x.std() + 1e-9
        basis = np.column_stack([np.ones(len(x)), (x - mean) / scale])
        w = np.zeros(2)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(basis @ w, -30, 30)))
            curve = basis.T @ (basis * (weight * p * (1 - p) + 1e-9)[:, None]) + 0.1 * np.eye(2)
            w = w + np.linalg.solve(curve, basis.T @ (weight * (y - p)) - 0.1 * w)
        self.at, self.slope = float(w[0] - w[1] * mean / scale), float(w[1] / scale)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.at + self.slope * x, -30, 30)))


def difference(text: bytes, tools: list[zstandard.ZstdCompressor]) -> float:
    """What the good dictionary saves over the bad one, in bytes for each byte of the whole text, which is compressed in chunks."""
    good, bad = tools
    saved = 0
    for at in range(0, len(text), CHUNK):
        piece = text[at : at + CHUNK]
        saved += len(bad.compress(piece)) - len(good.compress(piece))
    return saved / (len(text) + LEAST)


def differences(texts: DataFrame, model: Model) -> DataFrame:
    """texts with the column text replaced by x, its difference. Nothing is shuffled."""
    at = texts.columns.index("text")
    schema = T.StructType([f for f in texts.schema.fields if f.name != "text"] + [T.StructField("x", T.DoubleType())])
    held = texts.sparkSession.sparkContext.broadcast(model)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = held.value.compressors()
        for batch in frames:
            x = pa.array([difference(t.as_py() or b"", tools) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at] + [x], schema.names)

    return texts.withColumn("text", F.col("text").cast("binary")).mapInArrow(batches, schema)


def learn(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, max_pieces: int = MAX_PIECES) -> Model | None:
    """Model from labels(doc_id, quality) and docs(doc_id, text); None without both classes.

    Of each class about max_train labelled ids are drawn by a hash of the id; only they are joined to the
    documents. Pieces of four fifths of the texts, at most max_pieces of a class, train the dictionaries. The last fifth
    calibrates the score, so that the curve is fitted on texts that the dictionaries have not seen; their
    differences are computed in tasks, and of more than max_train of a class the first by a hash are taken.
    Labels other than 0 and 1 are ignored.
    """
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null")
    counts = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("quality") == 1, min(1.0, max_train / counts[1])).otherwise(min(1.0, max_train / counts[0]))
    drawn = marked.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) < share * (1 << 20)).distinct()
    drawn = materialize(drawn.withColumn("fifth", F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(5))), "quality-drawn")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(small(drawn), "doc_id").drop("doc_id")

    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(CHUNK))
    pieces = texts.filter("fifth > 0").select("quality", F.explode(F.transform(starts, lambda i: F.substr("text", i + 1, F.lit(CHUNK)))).alias("piece"))
    first = Window.partitionBy("quality").orderBy(F.xxhash64("piece"), "piece")
    pieces = pieces.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= max_pieces).collect()
    if len({r["quality"] for r in pieces}) < 2:
        return None

    def dictionary(quality: int) -> bytes:
        own = [bytes(r["piece"]) for r in sorted((r for r in pieces if r["quality"] == quality), key=lambda r: r["n"])]
        try:
            return zstandard.train_dictionary(DICT_BYTES, own).as_bytes()
        except zstandard.ZstdError:  # too little text to train on
            return b"".join(own)[-DICT_BYTES:]

    model = Model(dictionary(1), dictionary(0))
    seen = differences(texts.filter("fifth = 0").select("quality", F.xxhash64("text").alias("turn"), "text"), model)
    turn = Window.partitionBy("quality").orderBy("turn", "x")
    rows = seen.withColumn("n", F.row_number().over(turn)).filter(F.col("n") <= max_train).collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["quality"] for r in rows])
    if len(set(y)) < 2:
        return None
    total = sum(counts.values())
    model.fit(x, y, np.array([counts[q] / total / (y == q).sum() * len(y) for q in y]))
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1, higher is better) for every row and whole text; without a model every score is 0.5.

    Null text is scored as the empty one, whose difference is 0. Repeated rows are scored each; other columns are
    ignored; an empty table gives no rows. Nothing is shuffled.
    """
    if model is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))
    chance = 1 / (1 + F.exp(-F.least(F.greatest(model.at + model.slope * F.col("x"), F.lit(-30.0)), F.lit(30.0))))
    return differences(docs.select("doc_id", "text"), model).select("doc_id", chance.alias("score"))
