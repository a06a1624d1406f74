import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from sievelight.llm import components, exact_dedup, simhash

EDGES = ["same  text", "same text", "same\n\ttext", None, "", " ", "x" * 300_000, "x" * 300_000, "other", (8, "other"), (8, "other"), (None, "other"), "ſame", "\x1fsame text"]


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def got_exact(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=repr)


def test_exact_edges(make_docs):
    docs = make_docs(*EDGES)
    assert got_exact(exact_dedup.assign_groups(docs)) == brute_exact([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_exact_collisions_are_told_apart(make_docs):
    """With a hash of the length alone, texts of one length collide and must still be grouped by their bytes."""
    docs = make_docs("aa", "bb", "aa", "bb", "cc", "ddd", "", None)
    bad = lambda norm: F.unhex(F.md5(F.length(norm).cast("string")))
    assert got_exact(exact_dedup.assign_groups(docs, hashed=bad)) == brute_exact([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_exact_empty_and_whole_table(make_docs, small_docs):
    assert exact_dedup.assign_groups(make_docs("a").limit(0)).count() == 0
    assert got_exact(exact_dedup.assign_groups(small_docs)) == brute_exact([(r["doc_id"], r["text"]) for r in small_docs.collect()])


def test_exact_keep_one(make_docs):
    docs = make_docs(*EDGES)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == 7


def brute_fp(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    bits = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def brute_components(rows):
    fps = [(i, brute_fp(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a][1] ^ fps[b][1]).count("1") <= 2:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        least[root(k)] = min(x for x in (least.get(root(k)), i) if x is not None) if (least.get(root(k)), i) != (None, None) else None
    return sorted(((i, f"{fp:016x}", least[root(k)]) for k, (i, fp) in enumerate(fps)), key=repr)


def got_components(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=repr)


def test_simhash_equals_brute_force(small_docs, make_docs):
    assert got_components(simhash.near_groups(small_docs)) == brute_components([(r["doc_id"], r["text"]) for r in small_docs.collect()])
    base = [f"w{i}" for i in range(400)]
    near = [" ".join(base[:k] + ["odd"] + base[k:]) for k in range(0, 400, 40)]
    docs = make_docs("ONE", "one", "", None, " \n", "a b", "A B", " ".join(base), *near, "É b c", "é b c", (40, "a b"), (40, "a b"), (None, "a b"))
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got_components(simhash.near_groups(docs)) == want
    assert len({c for _, _, c in want}) < len(want) - 5
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_ball_links_connect_all_pairs(spark):
    fps = [0, 1, 3, 7, 1 << 63, (1 << 63) | 5, 0xFF00, 0xFF03, 0xFF0F, 123456789]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = {(r["a"], r["b"]) for r in simhash.ball_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert all(bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2 for a, b in links)
    seen = {f: f for f in signed}
    for _ in signed:
        for a, b in links:
            seen[a] = seen[b] = min(seen[a], seen[b])
    for x, a in zip(fps, signed):
        for y, b in zip(fps, signed):
            if bin(x ^ y).count("1") <= 2:
                assert seen[a] == seen[b]
    with pytest.raises(ValueError):
        simhash.ball_links(spark.createDataFrame([(0,)], "fp long"), 3)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 400)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    assert roots == {**{i: 0 for i in range(401)}, 1000: 1000, 1001: 1000}


def test_simhash_keep_one(make_docs):
    docs = make_docs("a b c d", "A b c d", "something else entirely", None)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [0, 2, 3]
