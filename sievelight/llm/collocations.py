"""Phrases whose words stand together more often than apart, counted in suffix subtrees that are dealt out by prefix. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievelight.llm.common import bounded, materialize

#: Words of a phrase at most: the depth at which suffixes are cut.
DEPTH = 4
#: Memory that the suffixes of a group of prefixes may take, and what one of them is reckoned to take.
GROUP_BYTES, SUFFIX_BYTES = 16 << 20, 64
#: Cells that prefixes fall into, at most; numbers of 64 bits in which each marks its prefixes (16 MiB in all); bits for a prefix, while cells are fewer.
MOST_CELLS, CELL_WORDS, PREFIX_BITS = 1 << 16, 32, 16
#: Occurrences of a phrase at least, and the share of them, in hundredths, that a longer phrase must have to stand for it.
LEAST, COVERED = 30, 80
#: Parts that a suffix of a prefix without a group is dealt into, by the task that read it.
SOURCES = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = [f"w{i}" for i in range(1, DEPTH + 1)]


def suffixes(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """lang, w1 to w4 (or fewer, by depth): for each word of a text, it and up to three that follow in its piece; those that are missing are null.

    Texts are split at `.,;:!?` and line ends; A to Z are lower-cased; words are what spaces and tabs leave. Null text is
    empty, null lang is `und`.
    """
    pieces = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(F.coalesce("text", F.lit("")), r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    # In ASCII lower() does the same as translate(), and takes less time.
    plain = F.when(F.octet_length("piece") == F.length("piece"), F.lower("piece")).otherwise(F.translate("piece", UPPER, LOWER))
    pieces = pieces.select("lang", F.trim(plain).alias("piece"))
    # Splitting at one space takes no pattern; what it leaves of an empty piece goes as a row, as a filter of pieces would make each of them twice.
    runs = F.col("piece").contains("\t") | F.col("piece").contains("  ")
    words = F.when(runs, F.array_remove(F.split("piece", r"[ \t]+"), "")).otherwise(F.split("piece", " "))
    placed = pieces.select("lang", words.alias("w")).select("lang", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i"))
    return placed.select("lang", *[F.get("w", F.col("i") + k).alias(name) for k, name in enumerate(WORDS[:depth])]).filter("w1 != ''")


def _key(first: str = "w1", second: str = "w2") -> Column:
    """A prefix of two words as a number. Prefixes that share one only share a group."""
    return F.xxhash64("lang", first, second)


def _cell(cells: int, key: str = "key") -> Column:
    return F.col(key).bitwiseAND(F.lit(cells - 1))


def _mark(key: str = "key") -> tuple[Column, Column]:
    """Where a prefix has its bits in its cell: in which number, and which two bits of it."""
    two = f"shiftleft(1L, cast(shiftrightunsigned({key}, 21) & 63 as int)) | shiftleft(1L, cast(shiftrightunsigned({key}, 27) & 63 as int))"
    return F.shiftrightunsigned(key, 16).bitwiseAND(F.lit(CELL_WORDS - 1)).cast("int"), F.expr(two)


def _met(key: str, bits: str) -> Column:
    """Whether a prefix has its bits in its cell."""
    word, two = _mark(key)
    return F.get(bits, word).bitwiseAND(two) == two


def _frequent(pairs: DataFrame, least: int) -> DataFrame:
    return pairs.filter(F.col("w2").isNotNull() & (F.col("f") >= least)).select(_key().alias("key"), "f")


def cell_count(pairs: DataFrame, least: int, group_rows: int) -> int:
    """Cells, a power of two, with which prefixes have PREFIX_BITS bits each and cells an eighth of group_rows suffixes on average; MOST_CELLS at most."""
    n, rows = _frequent(pairs, least).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("f") <= group_rows, F.col("f"))), F.lit(0))).first()
    return min(MOST_CELLS, 1 << max(n * PREFIX_BITS // (64 * CELL_WORDS), 8 * rows // group_rows).bit_length())


def vertical_partition(pairs: DataFrame, least: int, group_rows: int, cells: int = MOST_CELLS) -> DataFrame:
    """(key, part) of the prefixes of two words that a phrase can begin with: those with `least` occurrences.

    A prefix's group is the cell that its number falls into; no group has more suffixes than group_rows. A prefix that alone has more,
    and those of a cell that has more, get no group (part is null): their suffixes are prefixes of full depth, and are summed as such.
    """
    f = F.col("f")
    # Prefixes that share a number are one here, so all of them go without a group if one does.
    seen = _frequent(pairs, least).groupBy("key").agg(F.sum("f").alias("f")).withColumn("cell", _cell(cells))
    held = seen.withColumn("held", F.sum(F.when(f <= group_rows, f)).over(Window.partitionBy("cell")))
    return held.select("key", F.when((f <= group_rows) & (F.col("held") <= group_rows), F.col("cell")).alias("part"))


def prefix_cells(plan: DataFrame, cells: int) -> DataFrame:
    """cell, part, heavy, bits: for each cell its group (null: none), the prefixes in it that have none though it is one, and bits that all its prefixes set.

    However many prefixes there are, this table has at most MOST_CELLS rows of a fixed size (prefixes without a group in a cell that is one have
    more than group_rows suffixes each, so they are few) and can be broadcast. A rare prefix whose bits others set passes
    too: its suffixes move in vain and are left out as rare when they are counted.
    """
    alone = F.collect_list(F.when(F.col("part").isNull(), F.col("key")))
    word, two = _mark()
    words = plan.groupBy(_cell(cells).alias("cell"), word.alias("word")).agg(F.bit_or(two).alias("bits"), F.max("part").alias("part"), alone.alias("heavy"))
    found = words.groupBy("cell").agg(F.max("part").alias("part"), F.flatten(F.collect_list("heavy")).alias("heavy"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))
    heavy = F.when(F.col("part").isNull(), F.array().cast("array<bigint>")).otherwise(F.col("heavy"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(CELL_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("bits", i), F.lit(0).cast("bigint")))
    return found.select("cell", "part", heavy.alias("heavy"), bits.alias("bits"))


def _nodes(leaves: DataFrame, least: int, group: list[str]) -> DataFrame:
    """alone, lang, head (three words), w4, f of phrases of three and four words, from leaf totals: those of a node are its leaves' sum.

    Leaves that stand alone, as other groups hold more of their node, are handed on as they are.
    """
    third = leaves.groupBy(*group, "lang", "head")
    alone = F.col("alone")
    kept = F.collect_list(F.when(alone | (F.col("w4").isNotNull() & (F.col("f") >= least)), F.struct("w4", "f")))
    nodes = third.agg(F.sum("f").alias("f"), kept.alias("below")).filter(alone | (F.col("f") >= least))
    own = F.array(F.struct(F.lit(None).cast("string").alias("w4"), F.col("f").alias("f")))
    return nodes.select("alone", "lang", "head", F.inline(F.when(alone, F.col("below")).otherwise(F.concat(own, F.col("below")))).alias("w4", "f"))


def moving(docs: DataFrame, plan: DataFrame, cells: int) -> DataFrame:
    """place, alone, lang, head (three words), w4 of the suffixes that can be part of a frequent phrase, from prefix_cells().

    No phrase is more frequent than any two words in it, so suffixes whose first or second pair is rare are left out where they are read, however many pairs
    are frequent (a join by shuffle would move them all), and so is the last word where the third pair is.
    """
    def meet(rows: DataFrame, k: int, first: str, second: str, how: str) -> DataFrame:
        bits = plan.select(F.col("cell").alias(f"cell{k}"), F.col("bits").alias(f"bits{k}"))
        rows = rows.withColumn(f"key{k}", _key(first, second)).withColumn(f"cell{k}", _cell(cells, f"key{k}"))
        return rows.join(F.broadcast(bits), f"cell{k}", how)

    source = F.pmod(F.spark_partition_id(), F.lit(SOURCES))
    rows = suffixes(docs).filter("w3 is not null").select("lang", *WORDS, _key().alias("key"), source.alias("source")).withColumn("cell", _cell(cells))
    rows = rows.join(F.broadcast(plan), "cell").filter(_met("key", "bits")).drop("cell", "bits")
    rows = meet(rows, 2, "w2", "w3", "inner").filter(_met("key2", "bits2"))
    rows = meet(rows, 3, "w3", "w4", "left").withColumn("w4", F.when(_met("key3", "bits3"), F.col("w4")))
    rows = rows.withColumn("alone", F.col("part").isNull() | F.array_contains("heavy", F.col("key")))
    place = F.when(F.col("alone"), F.xxhash64("lang", *WORDS, "source")).otherwise(F.col("part"))
    # Three words in one column take less of a row than in three; no word has a space.
    return rows.select(place.alias("place"), "alone", "lang", F.concat_ws(" ", *WORDS[:3]).alias("head"), "w4")


def subtrees(docs: DataFrame, pairs: DataFrame, least: int = LEAST, group_rows: int = GROUP_BYTES // SUFFIX_BYTES) -> DataFrame:
    """lang, w1 to w4, f of all phrases of three and four words with `least` occurrences, from suffix subtrees.

    Suffixes are dealt out by their prefix's group, so that a task builds the subtrees of its groups alone: it sorts out equal
    suffixes, whose numbers are the leaf totals, and sums them upwards without another shuffle. Suffixes of a prefix too
    frequent for a group are dealt out by all their words and the task they come from; what is combined of them is summed then.
    """
    cells = cell_count(pairs, least, group_rows)
    plan = materialize(vertical_partition(pairs, least, group_rows, cells), "colloc-plan", release=True)
    plan = materialize(prefix_cells(plan, cells), "colloc-cells", release=True)
    dealt = moving(docs, plan, cells).repartition("place")
    leaves = dealt.groupBy("place", "alone", "lang", "head", "w4").agg(F.count(F.lit(1)).alias("f"))
    built = materialize(_nodes(leaves, least, ["place", "alone"]), "colloc-subtrees", release=True)
    deep = built.filter("alone").groupBy("lang", "head", "w4").agg(F.sum("f").alias("f"))
    nodes = built.filter("not alone").unionByName(_nodes(deep.withColumn("alone", F.lit(False)), least, ["alone"]))
    return nodes.withColumn("h", F.split("head", " ")).select("lang", *[F.col("h")[i].alias(name) for i, name in enumerate(WORDS[:3])], "w4", "f")


def phrase_counts(docs: DataFrame, least: int = LEAST, group_rows: int = GROUP_BYTES // SUFFIX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, words, f) of all phrases of one to four words with `least` occurrences, and (lang, n): how many words there are."""
    # Two words in one column take less of a row than in two; no word has a space, and the last of a piece stands alone.
    pairs = suffixes(docs, 2).select("lang", F.concat_ws(" ", "w1", "w2").alias("pair")).groupBy("lang", "pair").agg(F.count(F.lit(1)).alias("f"))
    # Of rare pairs only the first word's number is needed: their second word goes before the table is written.
    second = F.when((F.col("f") >= least) & F.col("pair").contains(" "), F.substring_index("pair", " ", -1))
    pairs = pairs.select("lang", F.substring_index("pair", " ", 1).alias("w1"), second.alias("w2"), "f")
    # All pairs move here, more than at any later step: their shuffle files go before the suffixes move.
    pairs = materialize(pairs.groupBy("lang", "w1", "w2").agg(F.sum("f").alias("f")), "colloc-pairs", release=True)
    single = pairs.groupBy("lang", "w1").agg(F.sum("f").alias("f")).filter(F.col("f") >= least).select("lang", F.array("w1").alias("words"), "f")
    double = pairs.filter(F.col("w2").isNotNull() & (F.col("f") >= least)).select("lang", F.array("w1", "w2").alias("words"), "f")
    deeper = subtrees(docs, pairs, least, group_rows)
    longer = deeper.select("lang", F.filter(F.array(*WORDS), lambda w: w.isNotNull()).alias("words"), "f")
    counts = materialize(single.unionByName(double).unionByName(longer), "colloc-counts", release=True)
    return counts, pairs.groupBy("lang").agg(F.sum("f").alias("n"))


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, *, least: int = LEAST, covered: int = COVERED, top: int = 2000, group_rows: int = GROUP_BYTES // SUFFIX_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of two to four words of each language.

    a is how often the phrase occurs; of all cuts in two the one with the lowest floor(2000000 a / (l + r)) counts (of
    equal ones the first), l and r being the numbers of its parts. A phrase goes if a longer one that holds it has
    `covered` hundredths of its occurrences. Phrases of a language are ordered by score, a, and the bytes of their words.

    Only sums that Spark combines before a shuffle and suffixes of prefixes with `least` occurrences move, with some that share their bits; groups of
    prefixes hold at most group_rows suffixes of frequent prefixes, and those of a prefix above that are dealt out by all their words and
    the task that read them, so no text, however often it is repeated, meets in one task. Parts of a phrase are at least as frequent as it, so all their
    numbers are there. Products are decimals. Null and empty texts have no words, very long texts and repeated rows count
    whole, other columns are ignored, and an empty table gives no rows.
    """
    counts, totals = phrase_counts(docs, least, group_rows)
    phrases = counts.filter(F.size("words") > 1).select("lang", _joined(F.col("words")).alias("phrase"), "words", F.col("f").alias("a"))
    parts = counts.filter(F.size("words") < DEPTH).select("lang", _joined(F.col("words")).alias("part"), "f")
    # Longer phrases say of each phrase inside them how often they occur; the most frequent one decides.
    size = F.size("words")
    inside = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda d: F.transform(F.sequence(F.lit(1), size - d + 1), lambda i: _joined(F.slice("words", i, d)))))
    holders = phrases.filter(size > 2).select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    kept = phrases.join(holders, ["lang", "phrase"], "left").filter(F.coalesce(F.col("held").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered, F.lit(True)))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(k.alias("k"), _joined(F.slice("words", F.lit(1), k)).alias("first"), _joined(F.slice("words", k + 1, size - k)).alias("rest")))).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", "c.*")
    cuts = cuts.join(parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(8,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    best = best.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = materialize(totals, "colloc-totals", release=True)
    return ranked.join(bounded(totals, totals.count(), 64), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
