import random

import corpus_pipeline
from sievelight.llm import simhash


def changed(words, places):
    return " ".join(f"new{i}" if i in places else w for i, w in enumerate(words))


def test_stage_takes_copies_with_changed_words(spark, make_docs):
    rng = random.Random(5)
    texts, leave = [], set()
    for n in range(40):  # of 200 words 4 changed: a resemblance of 176 / 216; 6 changed: 166 / 226
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts += [" ".join(words), changed(words, {20, 70, 120, 170}), changed(words, {20, 50, 80, 110, 140, 170})]
        leave.add(3 * n + 1)
    docs = make_docs(*texts)
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    left = set(range(120)) - {r["doc_id"] for r in stage(spark, docs, "").collect()}
    assert left <= leave and len(left) >= 36
    assert len(simhash.keep_one(docs).collect()) > 110


def test_resembling_groups_take_nulls_and_repeats(make_docs):
    docs = make_docs("One two three", None, " ", "one TWO\nthree", (3, "One two three"), (None, "one two three"), (9, "four five six"))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["component_id"]) for r in simhash.resembling_groups(docs).collect())
    assert got == [(-1, 0), (0, 0), (1, 1), (2, 1), (3, 0), (3, 0), (9, 9)]
    assert simhash.resembling_groups(docs.limit(0)).count() == 0
