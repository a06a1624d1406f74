"""The pipeline's near copies against all pairs by brute force, in crowds of texts that share a template."""

import random

import corpus_pipeline
from sievelight.llm import simhash


def shingled(text):
    words = text.lower().split()
    return frozenset(zip(*(words[i:] for i in range(5)))) if len(words) >= 5 else frozenset([tuple(words)])


def brute_components(texts):
    sets = [shingled(t) for t in texts]
    least = list(range(len(texts)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for b in range(len(sets)):
        for a in range(b):
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                ra, rb = find(a), find(b)
                least[max(ra, rb)] = min(ra, rb)
    return [find(i) for i in range(len(texts))]


def crowd(rng, pairs):
    """Texts of one template that resemble each other by about 0.7, each with a copy that it resembles by 0.8 to 0.88."""
    template = [f"t{i}" for i in range(200)]
    texts = []
    for n in range(pairs):
        one = list(template)
        for at in rng.sample(range(0, 200, 6), 4):
            one[at] = f"p{n}x{at}"
        two = list(one)
        for at in rng.sample(range(3, 200, 10), rng.choice([3, 4, 5])):
            two[at] = f"q{n}x{at}"
        texts += [" ".join(one), " ".join(two)]
    return texts


def test_a_crowd_loses_no_pair(make_docs):
    texts = crowd(random.Random(3), 250)
    want = brute_components(texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.resembling_groups(make_docs(*texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert 200 < len(set(want)) < 500


def test_short_and_mixed_texts_equal_brute_force(spark, make_docs):
    rng = random.Random(8)
    texts = []
    for n in range(120):
        words = [rng.choice("a b c d e f".split()) for _ in range(rng.randrange(1, 14))]
        texts += [" ".join(words), " ".join(words[: rng.randrange(1, len(words) + 1)])]
    passage = " ".join(f"shared{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"own{n}_{i}" for i in range(rng.randrange(5, 40))) for n in range(60)]
    want = brute_components(texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.resembling_groups(make_docs(*texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    left = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash"](spark, make_docs(*texts), "").collect()}
    assert left == set(want)


def test_rare_pairs_are_found_without_any_group(spark):
    """The index alone, without the SimHash steps before it, leaves out no pair."""
    rng = random.Random(4)
    sets = [frozenset(rng.sample(range(40), rng.randrange(1, 25))) for _ in range(150)]
    sets += [s | {100 + i} for i, s in enumerate(sets[:80])]
    rows = []
    for i, s in enumerate(sets):
        p = len(s) - -(-len(s) * 4 // 5) + 1
        rows.append((i, i, len(s), sorted(s, reverse=True)[:p]))
    made = spark.createDataFrame(rows, "fp long, root long, n long, rare array<long>")
    met = {(r["a"], r["b"]) for r in simhash.rare_pairs(made, 0.8).collect()}
    want = {(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert want and want <= met
