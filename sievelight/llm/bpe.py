"""Byte-level BPE: ranked merges folded over the bytes of distinct words by a rank map; decoding concatenates pieces."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import let

#: Distinct words whose ids a worker keeps, and text (characters) after which a batch of results goes out.
MAX_WORDS, BATCH_CHARS = 300_000, 2 << 20
#: Texts of more characters are encoded by blocks of words, so that their words are never held together.
LONG_TEXT, BLOCK_WORDS = 4 << 20, 100_000
#: Rows whose words, and of those the most frequent words, Spark folds before the texts are read; longer words are left out.
WARM_ROWS, WARM_WORDS, WARM_BYTES = 2_000, 10_000, 32
#: Maps that the literal rank map is split into, as a lookup in one of Spark's maps goes through its entries.
BUCKETS = 8192
#: Pieces longer than this are folded with a heap.
SHORT = 40


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank map of a vocabulary file: lines of base64 bytes and a rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def fold_merges(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces of a word: the adjacent pair of lowest rank (the leftmost of equals) merges until none has a rank."""
    if word in ranks:
        return [word]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > SHORT:
        return _fold_long(parts, ranks)
    none = len(ranks)
    costs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while costs:
        low = min(costs)
        if low == none:
            break
        at = costs.index(low)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del costs[at]
        if at:
            costs[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
        if at < len(costs):
            costs[at] = ranks.get(parts[at] + parts[at + 1], none)
    return parts


def _fold_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """fold_merges for long words: a heap of ranked pairs over a linked list, stale entries skipped."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapify(heap)

    def offer(i: int) -> None:
        j = after[i]
        if i >= 0 and j < n and (r := ranks.get(parts[i] + parts[j])) is not None:
            heappush(heap, (r, i, len(parts[i]) + len(parts[j])))

    while heap:
        _, i, size = heappop(heap)
        j = after[i]
        if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i], parts[j] = parts[i] + parts[j], b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p in parts if p]


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The rank map as a literal: an array of maps from hex digits to ranks, by crc32 of the digits."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        digits = piece.hex().upper()
        buckets[zlib.crc32(digits.encode()) % BUCKETS][digits] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def fold_distinct(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(word, ids) of distinct words, by Spark's higher-order functions alone.

    A word is an array of byte pieces (hex digits). As many times as it can have merges, the ranks of its adjacent
    pairs are looked up in the literal rank map, and the leftmost pair of the least rank becomes one piece.
    """
    table = rank_map(ranks)

    def rank(piece: Column) -> Column:
        return F.element_at(table, (F.crc32(piece.cast("binary")) % BUCKETS).cast("int") + 1)[piece]

    def merge(parts: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))))

        def joined(costs: Column) -> Column:
            at = F.array_position(costs, F.array_min(costs)).cast("int")
            pair = F.concat(F.element_at(parts, at), F.element_at(parts, at + 1))
            after = F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 1, F.lit(0)))
            return F.when(F.array_min(costs).isNull(), parts).otherwise(F.concat(F.slice(parts, 1, at - 1), F.array(pair), after))

        return F.when(F.size(parts) < 2, parts).otherwise(let(pairs, joined))

    whole = F.hex(F.col("word").cast("binary"))
    parts = F.regexp_extract_all(whole, F.lit(".."), F.lit(0))
    folded = F.when(F.size(parts) < 2, parts).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(parts) - 1), parts, lambda acc, _: merge(acc)))
    ids = F.when(rank(whole).isNotNull(), F.array(rank(whole))).otherwise(F.transform(folded, rank))
    return words.select("word", ids.alias("ids"))


def java_pattern(pattern: str) -> str:
    r"""The pattern for Java, whose \s knows ASCII alone."""
    space = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
    return pattern.replace(r"[^\s", f"[^{space}").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")


def frequent_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> dict[str, tuple[int, ...]]:
    """Ids of the most frequent words of some rows: at most WARM_WORDS of at most about WARM_ROWS rows.

    They only save work: whatever they lack or hold, ids are the same. Other words are folded where they come up.
    """
    total = docs.count()
    if not total:
        return {}
    some = docs.filter(F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1 << 20)) < min(1.0, WARM_ROWS / total) * (1 << 20))
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit(java_pattern(pattern)), F.lit(0))).alias("word")).groupBy("word").count()
    top = words.filter(F.octet_length("word").between(1, WARM_BYTES)).orderBy(F.desc("count"), "word").limit(WARM_WORDS)
    return {r["word"]: tuple(r["ids"]) for r in fold_distinct(top.repartition(16), ranks).collect()}


class _Words(dict):
    """Word -> ids as bytes of little-endian 32-bit numbers, folded when a word comes for the first time."""

    def __init__(self, ranks: dict[bytes, int], known: dict[str, tuple[int, ...]]):
        super().__init__((word, np.array(ids, "<i4").tobytes()) for word, ids in known.items())
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        found = self[word] = b"".join(self.ranks[p].to_bytes(4, "little") for p in fold_merges(word.encode(), self.ranks))
        return found


class _Vocabulary:
    """The rank map and frequent words, as broadcast, and the words and pieces that a worker makes of them.

    A worker keeps them from task to task with the broadcast value, and lets go of both when it turns to a task
    that does not use it; other stages then have the memory.
    """

    def __init__(self, ranks: dict[bytes, int], known: dict[str, tuple[int, ...]]):
        self.ranks, self.known = ranks, known
        self.words, self.pieces = None, None

    def __reduce__(self):
        return _Vocabulary, (self.ranks, self.known)

    def opened(self) -> tuple[_Words, list[bytes]]:
        if self.pieces is None:
            self.pieces = [b""] * (max(self.ranks.values()) + 1)
            for piece, rank in self.ranks.items():
                self.pieces[rank] = piece
        if self.words is None or len(self.words) > MAX_WORDS:
            self.words = None  # the old ones go before new ones come
            self.words = _Words(self.ranks, self.known)
        return self.words, self.pieces


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, warm: bool = False) -> DataFrame:
    """doc_id, ids (array of int) and decoded (binary: the pieces of those ids, concatenated) for every row and whole text.

    Each match of pattern is encoded by itself, without special tokens. A distinct word is folded once in the
    worker that meets it, and kept, up to MAX_WORDS of them at a time. The rank map is read on the driver and
    broadcast; its size is that of the vocabulary. With warm, the most frequent words are folded by Spark's
    higher-order functions beforehand (frequent_words) and broadcast too. Joining all occurrences of words to a
    table of all distinct words would shuffle each text several times over. Decoding knows only the ids.

    Null text encodes like the empty one: no ids, no bytes. Very long texts are encoded whole, by blocks of words. Repeated rows are encoded each; other columns are
    ignored; an empty table gives no rows. Nothing is shuffled.
    """
    ranks = read_ranks(ranks_path)
    known = frequent_words(docs, ranks, pattern) if warm else {}
    held = docs.sparkSession.sparkContext.broadcast(_Vocabulary(ranks, known))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(compiled: regex.Pattern, text: str, words: _Words) -> np.ndarray:
        if len(text) <= LONG_TEXT:
            return np.frombuffer(b"".join(map(words.__getitem__, compiled.findall(text))), "<i4")
        found, parts = (m[0] for m in compiled.finditer(text)), []
        while block := list(islice(found, BLOCK_WORDS)):
            if len(words) > MAX_WORDS:
                words.clear()
            parts.append(np.frombuffer(b"".join(map(words.__getitem__, block)), "<i4"))
        return np.concatenate(parts)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in frames:
            names, ids, decoded, size = [], [], [], 0
            for name, text in zip(batch.column(0), batch.column(1)):
                words, pieces = held.value.opened()
                text = text.as_py() or ""
                own = encode(compiled, text, words)
                names.append(name.as_py())
                ids.append(own)
                decoded.append(b"".join(map(pieces.__getitem__, own.tolist())))
                size += len(text)
                if size > BATCH_CHARS:
                    yield _batch(batch, names, ids, decoded)
                    names, ids, decoded, size = [], [], [], 0
            if names:
                yield _batch(batch, names, ids, decoded)

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, ids array<int>, decoded binary")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the decimal ids joined by a space and of the decoded bytes, from round_trip's rows."""
    return encoded.select(
        "doc_id",
        *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _batch(source: pa.RecordBatch, names: list, ids: list, decoded: list) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
    return pa.RecordBatch.from_arrays([pa.array(names, source.schema.field(0).type), lists, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])
