"""Collocations against a plain count of all phrases."""

import random
import re
import time
from collections import Counter

import pytest

from sievelight.llm import collocations, common

SCHEMA = "doc_id long, text string, lang string, w1 string, f long, part int, key int"


def brute(rows, least, covered=80, top=2000):
    """The same by dictionaries."""
    low = str.maketrans(collocations.UPPER[:26], collocations.LOWER[:26])
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + d])) for d in range(1, 5) for i in range(len(w) - d + 1))
    held = Counter()
    for (lang, w), a in f.items():
        if a >= least and len(w) > 2:
            for d in range(2, len(w)):
                for i in range(len(w) - d + 1):
                    held[lang, w[i : i + d]] = max(held[lang, w[i : i + d]], a)
    out = {}
    for (lang, w), a in f.items():
        if a >= least and len(w) > 1 and 100 * held[lang, w] < covered * a:
            score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, lang, "x", 1, 2, 3) for i, (t, lang) in enumerate(rows)], SCHEMA)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r[c] for c in names) for r in collocations.collocations(df, **how).collect())


def texts(seed, n, words):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "é", "K", "the", "of"]
    return [(" ".join(rng.choice([" ", "\t", " ", "  "]).join(rng.choices(vocabulary, k=rng.randint(0, 12))) + rng.choice([".", "\n", ",", "", "?!"]) for _ in range(6)), rng.choice(["en", "fr", None])) for _ in range(n)]


@pytest.mark.parametrize("group_rows", [1 << 18, 40, 3])
def test_equals_brute_force(spark, group_rows):
    """Whether groups hold many prefixes, few, or none, so that all suffixes are combined."""
    rows = texts(1, 300, 9)
    assert run(spark, rows, least=5, group_rows=group_rows) == brute(rows, 5)


def test_hot_copies_ties_and_top(spark):
    rows = texts(2, 60, 5) + [("New York City hall. new york city hall", "en")] * 100 + [("a a a a a a a a", "en")] * 20
    got = run(spark, rows, least=5, group_rows=50, top=7)
    assert got == brute(rows, 5, top=7) and any(r[2] == "new york city hall" for r in got)


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None), ("", "en"), ("...", None), ("one", "en")], least=1) == []
    long = " ".join(["x y z"] * 50_000)
    rows = [(long, None)] * 2 + [("Kelvin K k K İ", "en")] * 3
    assert run(spark, rows, least=2) == brute(rows, 2)


def test_groups_are_bounded(spark):
    """No group of prefixes has more suffixes than twice its budget, and each prefix has one group."""
    df = spark.createDataFrame([(i, t, lang, "x", 1, 2, 3) for i, (t, lang) in enumerate(texts(3, 400, 12))], SCHEMA)
    pairs = collocations.suffixes(df).groupBy("lang", "w1", "w2").count().withColumnRenamed("count", "f").cache()
    plan = collocations.vertical_partition(pairs, 5, 60)
    held = pairs.withColumn("key", collocations._key()).join(plan, "key").filter("part is not null").groupBy("part").sum("f").collect()
    assert len(held) > 10 and max(r["sum(f)"] for r in held) <= 120


def test_suffixes_are_made_once(spark):
    """Frequent and rare prefixes share one pass over the texts, and rare pairs are not written one by one."""
    df = spark.createDataFrame([(i, t, lang, "x", 1, 2, 3) for i, (t, lang) in enumerate(texts(4, 200, 1))], SCHEMA)
    pairs = collocations.suffixes(df).groupBy("lang", "w1", "w2").count().withColumnRenamed("count", "f").cache()
    found = collocations.subtrees(df, pairs, 5, 60)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("arrays_zip") < 2
    assert found.filter("w4 is null").count() > 10
    rows = collocations.suffixes(df, 2)
    assert rows.columns == ["lang", "w1", "w2"] and rows.groupBy("lang", "w1", "w2").count().exceptAll(pairs).isEmpty()


def test_pieces_are_made_once(spark):
    """No filter makes the pieces of a text a second time, and blanks of any kind and number part words."""
    rows = [("  a\tB  c \t.\t,  ,\t \t\n d", "en"), ("\té  B\tc\u00a0d \t e!" + " " * 50 + "A b c", None), ("a b c" + "\t" * 50, "en"), ("É B c d. É B\tC D", None)] * 2
    df = spark.createDataFrame([(i, t, lang, "x", 1, 2, 3) for i, (t, lang) in enumerate(rows)], SCHEMA)
    for depth in (2, 4):
        plan = collocations.suffixes(df, depth)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lower(") == 1 and plan.count("explode(") == 2 and plan.count("sequence(") == 1
    # As test_suffixes_are_made_once, whose arrays_zip suffixes() no longer calls: the texts are not read again behind the written subtrees.
    pairs = collocations.suffixes(df, 2).groupBy("lang", "w1", "w2").count().withColumnRenamed("count", "f")
    assert "sequence(" not in collocations.subtrees(df, pairs, 2, 60)._jdf.queryExecution().optimizedPlan().toString()
    assert run(spark, rows, least=2) == brute(rows, 2)


def test_no_number_of_prefixes_moves_all_suffixes(spark, monkeypatch):
    """Where the frequent prefixes are too many for a broadcast, suffixes of rare ones still do not move, nor are shuffle files kept."""
    written = {}

    def materialize(df, name, **how):
        written[name] = (df._jdf.queryExecution().executedPlan().toString(), how.get("release"))
        return common.materialize(df, name, **how)

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(collocations, "materialize", materialize)
    rows = texts(5, 200, 9) + [(f"rare{i} words{i} of{i} mine{i} stand{i}", "en") for i in range(500)]
    assert run(spark, rows, least=5) == brute(rows, 5)
    plan, _ = written["colloc-subtrees"]
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert all(release for _, release in written.values())


def test_suffixes_with_a_rare_pair_do_not_move(spark):
    """A rare first or second pair ends a suffix, a rare third one its last word."""
    rows = [("a b c d", "en"), ("b c. c x", "en"), ("p b c d", "en"), ("a b c x", "en"), ("a b x d", "en"), ("a b c", "en"), ("a b c d", "fr")] * 2 + [("a b. b c. c d", "en")]
    df = spark.createDataFrame([(i, t, lang, "x", 1, 2, 3) for i, (t, lang) in enumerate(rows)], SCHEMA)
    pairs = collocations.suffixes(df, 2).groupBy("lang", "w1", "w2").count().withColumnRenamed("count", "f")
    plan = collocations.prefix_cells(collocations.vertical_partition(pairs, 5, 1000), collocations.MOST_CELLS).cache()
    got = Counter((r["lang"], r["head"], r["w4"]) for r in collocations.moving(df, plan, collocations.MOST_CELLS).collect())
    assert got == {("en", "a b c", "d"): 2, ("en", "a b c", None): 4, ("en", "b c d", None): 4}


@pytest.mark.parametrize("cells, group_rows", [(1, 1 << 18), (1, 40), (8, 60), (64, 30)])
def test_prefixes_that_share_a_cell(spark, monkeypatch, cells, group_rows):
    """Rare prefixes pass where others set their bits, and frequent ones go without a group in cells that are one: counts stay exact."""
    monkeypatch.setattr(collocations, "MOST_CELLS", cells)
    monkeypatch.setattr(collocations, "CELL_WORDS", 1)
    rows = texts(6, 60, 5) + [("New York City hall. new york city hall", "en")] * 100 + [(f"r{i} s{i} t{i} u{i}", "en") for i in range(300)] * 3
    assert run(spark, rows, least=5, group_rows=group_rows) == brute(rows, 5)


def test_cells_are_few_and_hold_all_prefixes(spark):
    """However many prefixes there are, their cells have a fixed size; each prefix finds its bits, and its group or itself among those without."""
    pairs = spark.range(40_000).selectExpr("'en' lang", "cast(id as string) w1", "'x' w2", "if(id % 100 = 0, 1000L, 1 + id % 7) f")
    for count, grouped, alone in ((64, 0, 0), (1024, 1000, 300)):  # in 64, each cell has more suffixes than a group may have
        plan = collocations.vertical_partition(pairs, 2, 900, count).cache()
        cells = {r["cell"]: r for r in collocations.prefix_cells(plan, count).collect()}
        assert len(cells) == count and {len(r["bits"]) for r in cells.values()} == {collocations.CELL_WORDS}
        for r in plan.collect():
            cell, key = cells[r["key"] & count - 1], r["key"] & (1 << 64) - 1
            two = 1 << (key >> 21 & 63) | 1 << (key >> 27 & 63)
            assert cell["bits"][key >> 16 & collocations.CELL_WORDS - 1] & two == two
            assert r["part"] == cell["part"] or (r["part"] is None and r["key"] in cell["heavy"])
        assert sum(r["part"] is not None for r in cells.values()) >= grouped and sum(len(r["heavy"]) for r in cells.values()) >= alone
    assert collocations.cell_count(pairs, 2, 900) == 2048 and collocations.cell_count(pairs, 2000, 900) == 1


def test_shuffle_files_go_once_a_table_is_written(spark):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}

    before, kept = shuffled(), spark.conf.get(common.RELEASE)
    df = common.materialize(spark.range(1000).repartition(7, "id"), "released", release=True)
    assert spark.conf.get(common.RELEASE) == kept
    for _ in range(100):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and df.count() == 1000
