"""Personal data: base patterns, then identifiers that bootstrapped contexts discover. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm import spans
from sievelight.llm.common import let, materialize, small

#: Runs are entered at their start or where the match before ended; entering them elsewhere finds no other match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
#: A run of digits and single separators that holds 12 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What may be an identifier: six or more of these characters, a digit among them.
TOKEN = r"(?<![A-Za-z0-9@._/-])(?=[A-Za-z@._/-]*+[0-9])[A-Za-z0-9][A-Za-z0-9@._/-]{4,}[A-Za-z0-9]"

BASE_KINDS = ("email", "ip", "card", "phone")

#: Rounds of scoring, least score of a pattern, and known entities that it must have met.
ROUNDS, MIN_SCORE, MIN_SEEDS = 3, 0.8, 3
#: A word of a context: a run of letters and digits of any script.
WORD = r"[\p{L}\p{N}]+"
#: Characters before an entity in which its context is looked for at first, then, and at last in all that stands before it.
REACHES = (48, 1024)


def _octets(ip: Column) -> Column:
    part = lambda p: F.regexp_replace(p, r"^0+(?=[0-9])", "")
    return F.forall(F.split(ip, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))


def _luhn(card: Column) -> Column:
    """Whether the digits, every second from the right doubled, add up to a multiple of ten."""
    digits = F.split(F.reverse(F.regexp_replace(card, r"[^0-9]", "")), "")
    value = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(phone: Column) -> Column:
    return F.length(F.regexp_replace(phone, r"[^0-9]", "")).between(9, 15)


def base_spans(text: Column) -> list[tuple[str, Column]]:
    """The base kinds with their spans; matches that fail their test are dropped."""
    keep = lambda found, test: F.filter(found, lambda s: test(s["value"]))
    return [
        ("email", spans.matches(text, EMAIL, F.contains(text, F.lit("@")))),
        ("ip", keep(spans.matches(text, IP), _octets)),
        ("card", keep(spans.matches(text, CARD), _luhn)),
        ("phone", keep(spans.matches(text, PHONE, F.contains(text, F.lit("+"))), _digits)),
    ]


def _words_before(text: Column, start: Column) -> Column:
    """Words before a place, of which the last two are whole: those of a window that holds three or begins with the text."""

    def window(reach: Column) -> Column:
        before = F.substr(text, F.greatest(F.lit(1), start + 1 - reach), F.least(start, reach))
        return F.regexp_extract_all(F.lower(before), F.lit(WORD), F.lit(0))

    def within(reaches: tuple[int, ...]) -> Column:
        if not reaches:
            return window(start)
        return let(window(F.lit(reaches[0])), lambda w: F.when((F.size(w) >= 3) | (start <= reaches[0]), w).otherwise(within(reaches[1:])))

    return within(REACHES)


def _occurrence(text: Column, s: Column, kind: Column) -> Column:
    """Place, value and lexical patterns of a span: the words before it, one and two, whatever its shape and their length."""

    def patterns(words: Column) -> Column:
        one, other = F.get(words, F.size(words) - 1), F.get(words, F.size(words) - 2)
        named = F.filter(F.array(one, F.concat(other, F.lit(" "), one)), lambda p: p.isNotNull())
        return F.array_distinct(F.transform(named, lambda p: F.regexp_replace(p, r"[0-9]+", "0")))

    return F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"), F.xxhash64(s["value"]).alias("instance"), let(_words_before(text, s["start"]), patterns).alias("patterns"))


def extract(docs: DataFrame) -> DataFrame:
    """One pass over the texts: doc_id, key, base (start, no, end, kind) and seen: known and possible identifiers with their patterns."""
    named = [(kind, F.col(kind)) for kind in BASE_KINDS]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *[c.alias(kind) for kind, c in base_spans(F.col("text"))], spans.matches(F.col("text"), TOKEN).alias("token"))
    known = F.concat(*[c for _, c in named])
    free = F.filter("token", lambda t: ~F.exists(known, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))

    def occurrences(found: Column, kind: Column) -> Column:
        return F.transform(found, lambda s: _occurrence(F.col("text"), s, kind))

    seen = F.concat(*[occurrences(c, F.lit(kind)) for kind, c in named], occurrences(free, F.lit(None).cast("string")))
    return rows.select("doc_id", F.xxhash64("text").alias("key"), spans.kinds(named).alias("base"), seen.alias("seen"))


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """edges(pattern, instance, seed) -> (pattern, score, seeds), by turns over the pattern-instance graph.

    A pattern scores the share of seeds among its instances, of which an unknown one is not asked about itself.
    Patterns of min_score or more with min_seeds seeds promote their unknown instances to seeds of the next round, so
    that these teach other patterns; a promoted instance votes for a pattern only if another one promotes it too.
    Sums are combined before each shuffle, and each round is written to the shared folder. A pattern or instance
    that most rows share is one row on one side of a join.
    """
    votes, patterns = edges.withColumn("vote", F.col("seed")), None
    for turn in range(rounds):
        counted = votes.groupBy("pattern").agg(F.sum("vote").alias("seeds"), F.count(F.lit(1)).alias("n")).filter("seeds > 0")
        score = F.col("seeds") / F.when(F.col("n") > F.col("seeds"), F.col("n") - 1).otherwise(F.col("n"))
        patterns = materialize(counted.select("pattern", score.alias("score"), "seeds"), "pii-patterns")
        if turn + 1 < rounds:
            trusted = patterns.filter((F.col("score") >= min_score) & (F.col("seeds") >= min_seeds)).select("pattern", F.lit(1).alias("own"))
            trusted = small(materialize(trusted, "pii-trusted"))
            promoted = edges.filter("seed = 0").join(trusted, "pattern").groupBy("instance").agg(F.count(F.lit(1)).alias("by"))
            promoted = materialize(promoted, "pii-instances")
            others = F.coalesce("by", F.lit(0)) - F.coalesce("own", F.lit(0))
            votes = edges.join(promoted, "instance", "left").join(trusted, "pattern", "left").select("pattern", F.when(F.col("seed") == 1, 1).otherwise((others > 0).cast("int")).alias("vote"))
    return patterns


def find(docs: DataFrame, *, rounds: int = ROUNDS, min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """doc_id, base and spans: arrays of (start, no, end, kind) by start and then by kind.

    Base spans are the first seeds. The words before an entity, one and two of them however long, make lexical patterns; other
    tokens that look like identifiers, of any shape, are instances of theirs. Spark scores the graph of patterns
    and instances in rounds, each of which promotes what its patterns discover to seeds. Patterns of min_score or more
    that met min_seeds different seeds add the unknown tokens they stand before, as spans of kind `context`.

    Null text is the empty one. Each row gives one row, repeated ids and rows too; spans found by context are
    joined back by id and text. Texts, long ones too, are read once and never shuffled. Other columns are ignored; an empty
    table gives no rows.
    """
    read = materialize(extract(docs), "pii-read")
    seen = read.select("doc_id", "key", F.explode("seen").alias("s"))
    pairs = seen.select(F.explode("s.patterns").alias("pattern"), F.col("s.instance").alias("instance"), F.col("s.kind").isNotNull().cast("int").alias("seed"))
    edges = materialize(pairs.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    trusted = score_patterns(edges, rounds, min_score, min_seeds).filter((F.col("score") >= min_score) & (F.col("seeds") >= min_seeds)).select("pattern")
    unknown = seen.filter("s.kind is null").select("doc_id", "key", "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
    added = unknown.join(small(materialize(trusted, "pii-trusted")), "pattern", "left_semi").select("doc_id", "key", "start", "end").distinct()
    span = F.struct("start", F.lit(len(BASE_KINDS)).alias("no"), "end", F.lit("context").alias("kind"))
    added = added.groupBy("doc_id", "key").agg(F.collect_list(span).alias("added"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key"))
    both = read.select("doc_id", "key", "base").alias("a").join(added.alias("b"), same, "left")
    every = F.when(F.col("b.added").isNull(), F.col("a.base")).otherwise(F.array_sort(F.concat("a.base", "b.added")))
    return both.select("a.doc_id", "a.base", every.alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans' text, and the text of all spans."""
    return found.select(
        "doc_id",
        *[spans.count(F.col("base"), kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(spans.text_of(F.col("base")), 256).alias("base_sha256"),
        spans.text_of(F.col("spans")).alias("spans"),
    )
