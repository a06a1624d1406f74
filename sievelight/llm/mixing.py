"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievelight.llm.common import NON_SPACE, bounded, let, materialize, running, small

#: Parts that a range of sources splits into.
FAN = 64
#: Weights of the sources in order of code point, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Number of words of the text; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"{NON_SPACE}+"), F.lit(0))), F.lit(0)).cast("long")


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / float(1 << 53)


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, ...) -> the same with source_no (from 1, in code-point order, null last) and target, written out.

    Targets share `share` of all sizes by weight, and none is above cap times its size. Water-filling: sources that
    the common level per weight lifts to their cap are full, which raises the level for the rest, until no other one
    is. Each turn is one aggregate over the sources, of which there may be as many as rows. Weights repeat by source_no.
    """
    ordered = running(sizes, [], [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = materialize(ordered.select(*sizes.columns, F.col("_n").cast("long").alias("source_no"), weight.alias("w")), "mix-weights")
    limit = F.col("source_size") * cap
    level, n_full = 0.0, -1
    while True:
        full = limit <= F.col("w") * level
        held = rows.agg(F.sum("source_size").alias("all"), F.sum(full.cast("long")).alias("n"), F.sum(F.when(full, limit)).alias("sum"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        rest, open_weight = (held["all"] or 0) * share - (held["sum"] or 0.0), held["w"] or 0.0
        if not open_weight or held["n"] == n_full:
            break
        level, n_full = rest / open_weight, held["n"]
    target = F.when(full, limit).otherwise(F.lit(rest) * F.col("w") / F.lit(open_weight or 1.0))
    return materialize(rows.select(*sizes.columns, "source_no", target.alias("target")), "mix-sources")


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked items among drawn ones, without replacement, by inversion of u.

    The weights of the support come from the ratio of neighbouring probabilities, outwards from the mode, so
    nothing overflows; the support is cut where it is over 12 standard deviations (and 30) from the mode.
    """
    low, high = F.greatest(F.lit(0), drawn - (total - marked)), F.least(marked, drawn)
    mode = F.least(high, F.greatest(low, F.floor((drawn + 1.0) * (marked + 1.0) / (total + 2.0)).cast("long")))
    reach = (F.sqrt(drawn * (marked / F.greatest(total, F.lit(1))) + 1) * 12 + 30).cast("long")
    first, last = F.greatest(low, mode - reach), F.least(high, mode + reach)

    def chain(steps: Column, ratio) -> Column:
        """Values [1, r(s1), r(s1)r(s2), ...] as an array."""
        return F.aggregate(steps, F.array(F.lit(1.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) * ratio(x))))

    up = F.when(last > mode, chain(F.sequence(mode, last - 1), lambda x: (marked - x) * (drawn - x) / ((x + 1.0) * (total - marked - drawn + x + 1)))).otherwise(F.array(F.lit(1.0)))
    down = F.when(first < mode, chain(F.sequence(mode, first + 1, F.lit(-1).cast("long")), lambda x: x * (total - marked - drawn + x) / ((marked - x + 1.0) * (drawn - x + 1)))).otherwise(F.array(F.lit(1.0)))
    weights = F.concat(F.reverse(F.slice(down, 2, F.greatest(F.size(down) - 1, F.lit(0)))), up)

    def pick(w: Column) -> Column:
        goal = u * F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n"))
        step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["n"] + F.when(a["sum"] + x <= goal, 1).otherwise(0)).alias("n"))
        return F.least(last, first + F.aggregate(w, start, step)["n"])

    return F.when(high <= low, low).otherwise(let(weights, pick)).cast("long")


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, quota) -> (source_no, shard, n): exact block quotas dealt to equal shards; source_no counts from 1.

    A binary tree over ranges of shards: each node gives the left half of its shards the matching half of its
    blocks. What goes left is dealt to the sources down a second tree, over ranges of sources, FAN parts to a range: for
    one part after the other the number that goes left is hypergeometric in what remains, which makes the vector
    multivariate hypergeometric. All nodes and ranges of a level are rows and split side by side; no row or task holds
    all sources. Depth is the logarithm of the shards times that of the sources to the base FAN.
    """
    node = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.col("source_no").cast("long").alias("source_no"), F.col("quota").cast("long").alias("n"))
    node = materialize(node, "mix-node")
    last, levels = int(node.agg(F.max("source_no")).first()[0] or 0), 1
    while FAN**levels <= last:
        levels += 1
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")

    def step(acc: Column, part: Column) -> Column:
        u = uniform(F.lit(seed), F.col("lo"), F.col("hi"), part["range"])
        draw = hypergeometric(acc["rest"], part["n"], acc["room"], u)
        return let(draw, lambda k: F.struct(F.array_append(acc["got"], F.struct(part["range"].alias("range"), k.alias("k"))).alias("got"), (acc["rest"] - part["n"]).alias("rest"), (acc["room"] - k).alias("room")))

    width = shards
    while width > 1:
        split = node.filter(F.col("hi") - F.col("lo") > 1)
        # Slots are gapless over all shards: a half of the shards takes its part of the blocks, rounded down on the left.
        left_size = F.floor(F.sum("n") * (mid - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
        down = split.groupBy("lo", "hi").agg(left_size.alias("k")).withColumn("range", F.lit(0).cast("long"))
        for level in range(levels - 1, -1, -1):
            part = F.floor(F.col("source_no") / FAN**level).cast("long")
            parts = split.groupBy("lo", "hi", part.alias("part")).agg(F.sum("n").alias("n"))
            cells = F.array_sort(F.collect_list(F.struct(F.col("part").alias("range"), "n")))
            parts = parts.groupBy("lo", "hi", F.floor(F.col("part") / FAN).cast("long").alias("range")).agg(cells.alias("parts"), F.sum("n").alias("total"))
            start = F.struct(F.array().cast("array<struct<range:bigint,k:bigint>>").alias("got"), F.col("total").alias("rest"), F.col("k").alias("room"))
            dealt = down.join(parts, ["lo", "hi", "range"]).select("lo", "hi", F.aggregate("parts", start, step)["got"].alias("got"))
            down = dealt.select("lo", "hi", F.explode("got").alias("x")).select("lo", "hi", "x.range", "x.k")
        got = split.join(down.select("lo", "hi", F.col("range").alias("source_no"), "k"), ["lo", "hi", "source_no"], "left").withColumn("k", F.coalesce("k", F.lit(0).cast("long")))
        halves = F.array(F.struct("lo", mid.alias("hi"), "source_no", F.col("k").alias("n")), F.struct(mid.alias("lo"), "hi", "source_no", (F.col("n") - F.col("k")).alias("n")))
        after = got.select(F.explode(halves).alias("x")).select("x.*")
        node = materialize(after.unionByName(node.filter(F.col("hi") - F.col("lo") <= 1)), "mix-node")
        width = -(-width // 2)
    return node.select("source_no", F.col("lo").alias("shard"), "n")


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, digest, copy), written to the shared folder: one scan of the texts, none shuffled.

    copy numbers rows that repeat doc_id and text, so that (doc_id, digest, copy) names one row.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("digest"))
    return materialize(rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("source"))), "mix-sizes")


def sources_of(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, n_docs, source_no, target), written to the shared folder."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    return source_targets(per_source, share, cap, weights)


def draw(sized: DataFrame, sources: DataFrame, *, shards: int = 16, block_rows: int = 256, seed: int = 5) -> DataFrame:
    """The mix over the tables of sized_documents and sources_of; see mix."""
    # Whole passes over a source, and the words that a part of one more pass has to give.
    named = sources.withColumn("n_blocks", F.ceil(F.col("n_docs") / block_rows))
    named = named.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    named = named.withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    n_sources = sources.count()

    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "digest", "copy"), F.col("n_blocks"))
    dealt = sized.alias("d").join((F.broadcast(named) if small(sources) is not sources else named).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    dealt = dealt.select("d.doc_id", "d.digest", "d.copy", "d.size", "s.source_no", "s.passes", "s.rest", block.alias("block"))

    # Permuted blocks with running sums; those that end within the rest are whole, the next one is cut.
    blocks = dealt.groupBy("source_no", "block", "passes", "rest").agg(F.sum("size").alias("words"))
    blocks = running(blocks, ["source_no"], [F.xxhash64(F.lit(seed + 1), "source_no", "block"), F.col("block")], {"words": F.col("words")})
    blocks = blocks.withColumn("whole", F.col("_words") <= F.col("rest")).withColumn("lacks", F.col("rest") - (F.col("_words") - F.col("words")))
    blocks = blocks.withColumn("cut", ~F.col("whole") & (F.col("lacks") > 0))

    # A drawn block is one unit of its source's quota for each time it is taken.
    units = blocks.withColumn("copies", F.col("passes") + F.when(F.col("whole") | F.col("cut"), 1).otherwise(0)).filter("copies > 0")
    units = units.select("source_no", "block", "cut", "lacks", "passes", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch"))
    units = units.withColumn("cut", F.col("cut") & (F.col("epoch") > F.col("passes"))).drop("passes")
    drawn = running(units, ["source_no"], [F.col("epoch"), F.xxhash64(F.lit(seed + 2), "source_no", "epoch", "block"), F.col("block")])
    units = materialize(drawn.withColumnRenamed("_n", "draw"), "mix-units")
    n_units = units.count()
    shares = split_quotas(units.groupBy("source_no").agg(F.count(F.lit(1)).alias("quota")), shards, seed + 3)
    runs = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranges = shares.withColumn("upto", F.sum("n").over(runs)).groupBy("source_no").agg(F.array_sort(F.collect_list(F.struct("upto", "shard", "n"))).alias("ranges"))
    shard = F.filter("ranges", lambda r: (r["upto"] >= F.col("draw")) & (r["n"] > 0))[0]["shard"]
    placed = units.join(bounded(ranges, n_sources, 24 + 32 * shards), "source_no").select("source_no", "block", "epoch", "cut", "lacks", shard.alias("shard"))

    rows = dealt.drop("passes", "rest").join(bounded(placed, n_units, 48), ["source_no", "block"])
    # Of the cut block, documents are taken in permuted order up to the first that does not fit into what the
    # source still lacks; the gap is filled by those that fit, larger ones first, and by the least one of the rest
    # if that brings the sum nearer.
    cell = F.struct(F.xxhash64(F.lit(seed + 4), "doc_id", "digest", "copy").alias("turn"), "doc_id", "digest", "copy", "size")
    cells = rows.filter("cut").groupBy("source_no", "block", "epoch", "shard", "lacks").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    none = F.filter("cells", lambda c: F.lit(False))

    def fit(acc, c, until_full: bool):
        fits = (c["size"] <= acc["left"]) & (acc["open"] if until_full else F.lit(True))
        taken = F.struct((acc["left"] - c["size"]).alias("left"), acc["open"].alias("open"), F.array_append(acc["got"], c).alias("got"), acc["rest"].alias("rest"))
        passed = F.struct(acc["left"].alias("left"), F.lit(False).alias("open"), acc["got"].alias("got"), F.array_append(acc["rest"], c).alias("rest"))
        return F.when(fits, taken).otherwise(passed)

    begin = lambda left, got: F.struct(left.alias("left"), F.lit(True).alias("open"), got.alias("got"), none.alias("rest"))
    cells = cells.withColumn("a", F.aggregate("cells", begin(F.col("lacks"), none), lambda acc, c: fit(acc, c, True)))
    larger = F.array_sort("a.rest", lambda x, y: F.when(x["size"] > y["size"], -1).when(x["size"] < y["size"], 1).when(x["turn"] < y["turn"], -1).when(x["turn"] > y["turn"], 1).otherwise(0))
    cells = cells.withColumn("a", F.aggregate(larger, begin(F.col("a.left"), F.col("a.got")), lambda acc, c: fit(acc, c, False)))
    least = F.element_at(F.filter("a.rest", lambda c: c["size"] > 0), -1)
    more = F.when(F.exists("a.rest", lambda c: c["size"] > 0), F.when(least["size"] < 2 * F.col("a.left"), F.array(least))).otherwise(none)
    part = cells.select("source_no", "epoch", "shard", F.explode(F.concat("a.got", F.coalesce(more, none))).alias("c"))
    columns = ["doc_id", "digest", "copy", "source_no", "size", "epoch", "shard"]
    taken = rows.filter("not cut").select(*columns).unionByName(part.select("c.doc_id", "c.digest", "c.copy", "source_no", "c.size", "epoch", "shard"))
    # A shard is shuffled in parts of bounded size; the slots of a part follow those of the part before.
    n_parts = max(1, -(-n_units * block_rows // (shards * 50_000)))
    taken = taken.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 6), "doc_id", "digest", "copy", "epoch"), F.lit(n_parts)))
    local = Window.partitionBy("shard", "part").orderBy(F.xxhash64(F.lit(seed + 5), "doc_id", "digest", "copy", "epoch"), "doc_id", "digest", "copy", "epoch")
    counts = taken.groupBy("shard", "part").count()
    starts = counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("start"))
    out = taken.withColumn("slot", F.row_number().over(local) - 1).join(bounded(starts, shards * n_parts, 24), ["shard", "part"])
    return out.select("doc_id", "digest", "copy", "source_no", "size", F.col("epoch").cast("int").alias("epoch"), "shard", (F.col("slot") + F.col("start")).cast("long").alias("slot"))


def mix(docs: DataFrame, *, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, shards: int = 16, block_rows: int = 256, seed: int = 5) -> DataFrame:
    """The mix: one row (doc_id, digest, copy, source_no, size, epoch, shard, slot) for each time a document is taken.

    Sizes are words. Each source is dealt by a seeded hash of the document into blocks of about block_rows
    rows, and its blocks are permuted. Its quota is counted in blocks: whole passes over all its blocks, then as
    many permuted blocks as fit into what remains of the target, then documents of one more block that bring the
    sum near the target. The block quotas are split among the output shards by
    split_quotas, shards draw disjoint runs of the permuted blocks, and rows are shuffled inside a shard by a
    seeded hash; slots are gapless in each shard. Only ids and sizes are shuffled. Running
    sums over a source's blocks are dealt by ranges, so a source of any size is spread over tasks, and there may be
    any number of sources.

    Null text has size 0; a null source is a source of its own and comes last. Repeated rows are dealt each. A
    source without words has target 0 and gives no rows. Very long texts are documents like any other and never
    split. An empty table gives no rows. Other columns are ignored.
    """
    sized = sized_documents(docs)
    return draw(sized, sources_of(sized, share, cap, weights), shards=shards, block_rows=block_rows, seed=seed)


def taken_words(docs: DataFrame, *, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken (words the mix takes of it)."""
    sized = sized_documents(docs)
    sources = sources_of(sized, share, cap, weights)
    got = draw(sized, sources, **options).groupBy("doc_id", "digest", "copy").agg(F.sum("size").alias("taken"))
    side = small(sources.select("source", "source_size", "target"))
    rows = sized.alias("d").join(side.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & F.col("d.digest").eqNullSafe(F.col("g.digest")) & (F.col("d.copy") == F.col("g.copy"))
    out = rows.join(got.alias("g"), same, "left")
    return out.select("d.doc_id", "d.size", "t.source_size", "t.target", F.coalesce("g.taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: all columns, whatever their names, and a row for each time a document is taken.

    Nulls, empty and very long texts, repeated rows and empty tables are treated as in mix.
    """
    cols = docs.columns
    taken = materialize(mix(docs, **options).groupBy("doc_id", "digest", "copy").agg(F.count(F.lit(1)).cast("int").alias("times")), "mix-taken")
    times = materialize(taken.groupBy("doc_id", "digest").agg(F.max("copy").alias("copies"), F.sum("times").cast("int").alias("times")), "mix-times")
    row = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row")
    rows = docs.select(row, F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col("source").alias("from"))
    found = rows.join(small(times), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("digest")))
    repeat = F.explode(F.sequence(F.lit(1), F.col("times"))).alias("n")
    once = found.filter("copies = 1").select("row", repeat).select("row.*")
    if taken.filter("copy > 1").isEmpty():
        return once
    # Rows that repeat doc_id and text are told apart by their copy number.
    again = found.filter("copies > 1").select("row", "id", "hash", "from")
    again = again.withColumn("no", F.row_number().over(Window.partitionBy("id", "hash").orderBy("from")))
    more = again.join(taken, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("digest")) & (F.col("no") == F.col("copy")))
    return once.unionByName(more.select("row", repeat).select("row.*"))
