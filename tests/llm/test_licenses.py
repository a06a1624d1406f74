"""Licence scans: the base phrases against a plain search, templates against whole and altered texts."""

import random

import pytest

from sievelight.llm import license_scan
from sievelight.llm.license_scan import TEMPLATES, Template, words_of

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
MIT = next(t.text for t in TEMPLATES if t.label == "mit" and not t.base)


def brute(text):
    """n_words, n_base, first, last, labels of the base phrases, by comparing at every place."""
    words, places = words_of(text or ""), []
    for phrase, label in BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def run(docs, **how):
    return {r["doc_id"]: r for r in license_scan.scan(docs, **how).collect()}


def base_of(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


def test_base_equals_brute_force(make_docs):
    rng = random.Random(4)
    pool = "gnu general public license apache Apache MIT mit cc by CC BY-NC 2.0 the é İ Kelvin".split() + ["License,", "\n", "GNU General Public License", "Apache-License"]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(200)] + [None, "", "...", "mit license " * 20_000 + "x", "CC\tBY", "MIT\nLicense"]
    got = run(make_docs(*texts))
    assert [base_of(got[i]) for i in range(len(texts))] == [brute(t) for t in texts]
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got.values())


def test_whole_table_equals_brute_force(small_docs):
    got = run(small_docs)
    assert {i: base_of(r) for i, r in got.items()} == {r["doc_id"]: brute(r["text"]) for r in small_docs.collect()}


@pytest.mark.parametrize("t", TEMPLATES, ids=lambda t: t.label)
def test_each_template_finds_its_text(make_docs, t):
    got = run(make_docs("plain words of a text", f"# {'word ' * 30}\n{t.text.upper()}\n and more", "another one"))
    assert t.label in got[1]["labels"].split(",") and got[1]["score"] == 1.0 and got[0]["labels"] == got[2]["labels"] == ""


def test_altered_texts(make_docs):
    words = MIT.split()
    named = MIT.replace("any person", "Any Person At All Named Here")
    cut = " ".join(words[:12])
    without = MIT.replace("sublicense", "share")
    shuffled = " ".join(random.Random(1).sample(words, len(words)))
    got = run(make_docs(named, cut, without, shuffled, MIT + " " + MIT))
    assert [got[i]["labels"] for i in range(5)] == ["mit", "", "", "", "mit"]


def test_phrases_far_apart_are_no_template(make_docs):
    a, b = TEMPLATES[16].phrases
    assert TEMPLATES[16].label == "isc"
    assert run(make_docs(f"{a} {'and ' * 500} {b}"))[0]["labels"] == ""


def test_rows_and_ids(make_docs):
    docs = make_docs((1, "MIT License"), (1, "MIT License"), (1, "none"), (None, "MIT License"), (None, "x"))
    rows = sorted((r["doc_id"] or 0, r["labels"], r["n_base"]) for r in license_scan.scan(docs).collect())
    assert rows == [(0, "", 0), (0, "mit", 1), (1, "", 0), (1, "mit", 1), (1, "mit", 1)]
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_words_outside_ascii(make_docs):
    own = (Template("x", "Licence Générale É", ("licence générale",)),)
    got = run(make_docs("la licence générale É.", "la licence GÉNÉRALE é", "LICENCE générale É"), templates=own)
    assert [got[i]["labels"] for i in range(3)] == ["x", "", "x"]


def test_rare_words_are_looked_up(small_docs):
    """A phrase is looked up by its rarest word: `mit` is a German word, and `by` an English one."""
    words = sorted({w for t in TEMPLATES for w in words_of(t.text)})
    index = license_scan.build_index(TEMPLATES, license_scan.rarity(small_docs, words))
    anchors = {" ".join(r[5]): r[0] for r in index.phrases}
    assert anchors["mit license"] == "license" and anchors["cc by"] == "cc"
