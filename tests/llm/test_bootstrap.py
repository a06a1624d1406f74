from sievelight.llm import pii


def context(rows):
    return {r["doc_id"] for r in rows for s in r["spans"] if s["kind"] == "context"}


def test_discovered_identifiers_teach_patterns(make_docs):
    """Passports, of a shape that no seed has, are met where addresses are; they teach a pattern that finds the last one."""
    passports = ["AB123456", "CD234567", "EF345678"]
    texts = [f"write to holder user{chr(97 + n)}@example.com now" for n in range(20)]
    texts += [f"write to holder {p} now" for p in passports] + [f"the travel document {p} expired" for p in passports]
    texts += ["the travel document GH456789 expired", "a spare part GH999999 broke"]
    found = pii.find(make_docs(*texts)).collect()
    assert context(found) == set(range(20, 27))
    assert context(pii.find(make_docs(*texts), rounds=1).collect()) == set(range(20, 23))


def test_instances_do_not_vote_for_themselves(spark):
    edges = [("p", f"known{n}", 1) for n in range(5)] + [("p", f"new{n}", 0) for n in range(5)]
    scores = pii.score_patterns(spark.createDataFrame(edges, "pattern string, instance string, seed int")).collect()
    assert [(r["pattern"], round(r["score"], 3), r["seeds"]) for r in scores] == [("p", 0.556, 5)]


def brute_scores(edges, rounds, min_score, min_seeds):
    """score_patterns by plain loops over (pattern, instance, seed)."""
    votes = {(p, i): s for p, i, s in edges}
    for turn in range(rounds):
        patterns = {}
        for (p, i), v in votes.items():
            patterns.setdefault(p, []).append(v)
        scores = {p: (sum(v) / (len(v) - 1 if len(v) > sum(v) else len(v)), sum(v)) for p, v in patterns.items() if sum(v)}
        if turn + 1 < rounds:
            trusted = {p for p, (s, n) in scores.items() if s >= min_score and n >= min_seeds}
            votes = {(p, i): 1 if s else int(any(q in trusted for q, j, t in edges if j == i and not t and q != p)) for p, i, s in edges}
    return scores


def test_scores_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    for rounds in (1, 2, 3):
        seed_of = {i: int(rng.random() < 0.6) for i in range(30)}
        edges = sorted({(f"p{rng.randrange(8)}", i, seed_of[i]) for i in range(30) for _ in range(3)})
        df = spark.createDataFrame(edges, "pattern string, instance long, seed int")
        got = {r["pattern"]: (round(r["score"], 9), r["seeds"]) for r in pii.score_patterns(df, rounds, 0.7, 2).collect()}
        assert got == {p: (round(s, 9), n) for p, (s, n) in brute_scores(edges, rounds, 0.7, 2).items()}


def brute_words(text, start):
    import regex

    words = regex.findall(r"[\p{L}\p{N}]+", text[:start].lower())
    named = [words[-1:], words[-2:] if len(words) > 1 else []]
    return [regex.sub("[0-9]+", "0", " ".join(w)) for w in named if w]


def test_contexts_are_whole_words_however_far(spark, make_docs):
    """Words longer than any window, and entities far behind the last word, have the context that a plain search finds."""
    texts = ["holder a@b.cc", "a@b.cc", "x" * 50 + " a@b.cc", "y" * 3000 + " " + "z" * 3000 + ": a@b.cc", "mail" + " " * 2000 + "a@b.cc", "two words -- " + "-" * 60 + "a@b.cc", "É1 ſ23 a@b.cc", "one, two; three: a@b.cc b@c.dd"]
    for r in pii.extract(make_docs(*texts)).collect():
        for s in r["seen"]:
            assert sorted(s["patterns"]) == sorted(set(brute_words(texts[r["doc_id"]], s["start"]))), (r["doc_id"], s)


def test_contexts_equal_brute_force(small_docs):
    """Context spans of the whole table from the extracted occurrences, scored and matched by plain loops."""
    seen, edges = {}, {}
    for r in pii.extract(small_docs).collect():
        seen[r["doc_id"]] = r["seen"]
        for s in r["seen"]:
            for p in s["patterns"]:
                edges[p, s["instance"]] = max(edges.get((p, s["instance"]), 0), int(s["kind"] is not None))
    scores = brute_scores([(p, i, v) for (p, i), v in edges.items()], pii.ROUNDS, pii.MIN_SCORE, pii.MIN_SEEDS)
    trusted = {p for p, (s, n) in scores.items() if s >= pii.MIN_SCORE and n >= pii.MIN_SEEDS}
    want = {d: sorted({(s["start"], s["end"]) for s in rows if s["kind"] is None and trusted & set(s["patterns"])}) for d, rows in seen.items()}
    got = {r["doc_id"]: sorted((s["start"], s["end"]) for s in r["spans"] if s["kind"] == "context") for r in pii.find(small_docs).collect()}
    assert got == want
