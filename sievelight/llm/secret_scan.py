"""Secret scans over a trigram inverted index. DataFrame functions only."""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm import spans
from sievelight.llm.common import materialize, small


@dataclass(frozen=True)
class Rule:
    """kind and pattern (read alike by Java and Python); keep tells which matches stay; base rules come first."""

    kind: str
    pattern: str
    keep: object = None
    base: bool = field(default=False)


def _long_value(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: The three base kinds of the contract, then well-known public formats of credentials.
RULES = (
    Rule("assign", ASSIGN, _long_value, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", None, True),
    Rule("hex", r"[0-9a-f]{24,}", None, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

#: Exact strings followed through a pattern at most, and trigrams of a branch that the index is asked for.
MAX_STRINGS, PER_BRANCH = 16, 3


def _strings(node) -> set[str] | None:
    """All strings that a part of a pattern matches, lower-cased, if they are few; else None."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= MAX_STRINGS:
        return {chr(a).lower() for _, a in arg}
    if op is sre.SUBPATTERN:
        return _joined(arg[3])
    if op is sre.BRANCH:
        parts = [_joined(x) for x in arg[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[1] <= 2:
        once = _joined(arg[2])
        return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(once, repeat=n)} if once is not None else None
    return None


def _joined(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        own = _strings(node)
        if own is None or len(out) * len(own) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in own}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Branches of trigrams: a text that matches has all trigrams of one branch. Empty: no trigram is mandatory.

    Neighbouring parts that match few strings are joined into runs; a run whose strings all have three characters
    or more gives one branch a string. Of several runs the one with the longest shortest string is taken.
    """
    runs, now = [], {""}
    for node in parser.parse(pattern):
        own = _strings(node)
        if own is None or len(now) * len(own) > MAX_STRINGS:
            runs.append(now)
            now = own if own is not None else {""}
        else:
            now = {a + b for a in now for b in own}
    runs.append(now)
    best = max(runs, key=lambda r: (min(map(len, r)), -len(r)))
    if min(map(len, best)) < 3:
        return []
    branches = []
    for s in sorted(best):
        grams = list(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2)))
        step = max(1, -(-(len(grams) - 1) // max(1, PER_BRANCH - 1)))
        branches.append(frozenset(grams[::step] + grams[-1:]))
    return branches


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index over lower-cased texts, of the trigrams that rules ask for: (gram, doc_id)."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    found = F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]), lambda g: g.isNotNull())
    return low.select("doc_id", F.explode(found).alias("gram"))


def candidates(docs: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(doc_id, rules): the rules of which a document's postings meet a branch; documents without any are absent."""
    grams = sorted({g for branches in queries.values() for b in branches for g in b})
    index = materialize(postings(docs, grams), "secret-postings")
    asked = [(grams.index(g), rule, no, len(b)) for rule, branches in queries.items() for no, b in enumerate(branches) for g in sorted(b)]
    # One row for each trigram of a branch: fixed by the rules, not by the data.
    asked = F.broadcast(docs.sparkSession.createDataFrame(asked, "gram int, rule int, branch int, need int"))
    met = index.distinct().join(asked, "gram").groupBy("doc_id", "rule", "branch", "need").count().filter("count = need")
    return met.groupBy("doc_id").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def _found(text: Column, rule: Rule) -> Column:
    found = spans.matches(text, rule.pattern)
    return F.filter(found, lambda s: rule.keep(s["value"])) if rule.keep else found


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, base and spans: arrays of (start, no, end, kind) by start and then by rule; base has those of base rules.

    Each pattern is turned into a Boolean query of trigrams. One pass over the texts writes postings of the
    trigrams asked for; they are intersected by document, which gives each rule its candidates. A rule without a
    mandatory trigram scans every text. Candidates are verified by their patterns: their list is broadcast if its
    measured size is small, and joined by shuffle otherwise. The last join has ids and spans only. Lower-casing
    the index can only add candidates.

    Null text is the empty one and has no spans. Rows that share a doc_id share candidates, and each is verified
    by its own text. Rows without a doc_id are verified by every rule. Each row of docs gives one row; other
    columns are ignored; an empty table gives none.
    """
    queries = {no: branches for no, rule in enumerate(rules) if (branches := trigram_query(rule.pattern))}
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.xxhash64("text").alias("key")
    listed = materialize(candidates(docs, queries), "secret-candidates")
    hit = docs.join(small(listed), "doc_id").select("doc_id", "text", "rules")
    hit = hit.unionByName(docs.filter("doc_id is null").withColumn("rules", F.array(*map(F.lit, queries))))
    checked = [F.when(F.array_contains("rules", no), _found(F.col("text"), rule)).otherwise(spans.none()) if no in queries else spans.none() for no, rule in enumerate(rules)]
    verified = hit.select("doc_id", key, spans.kinds([(r.kind, c) for r, c in zip(rules, checked)]).alias("verified")).filter(F.size("verified") > 0).distinct()
    full = [spans.none() if no in queries else _found(F.col("text"), rule) for no, rule in enumerate(rules)]
    read = docs.select("doc_id", key, spans.kinds([(r.kind, c) for r, c in zip(rules, full)]).alias("full"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key"))
    both = read.alias("a").join(verified.alias("b"), same, "left")
    every = F.when(F.col("b.verified").isNull(), F.col("a.full")).otherwise(F.array_sort(F.concat("a.full", "b.verified")))
    out = both.select("a.doc_id", every.alias("spans"))
    bases = [no for no, rule in enumerate(rules) if rule.base]
    return out.select("doc_id", F.filter("spans", lambda s: s["no"].isin(bases)).alias("base"), "spans")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans' text, and the text of all spans."""
    return found.select(
        "doc_id",
        *[spans.count(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(spans.text_of(F.col("base")), 256).alias("base_sha256"),
        spans.text_of(F.col("spans")).alias("spans"),
    )
