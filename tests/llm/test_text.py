import base64
import hashlib
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import bpe, langid, quality

public_tokenizers = pytest.importorskip("public_tokenizers")


def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", None, "Hello world's  end\n\n x", "a" * 5000, " " * 3000, "你好，世界 ½ Ⅷ ²", "é ​ \x1c\x85 x", "<|endoftext|>", "!?" * 700, "naïve café ĳ ﬁ", "😀👍🏽 emoji\tz", "12 345 6789", "'s 're I'LL don't", "x\r\n\r\n  y   ", "Hello world's  end\n\n x"]


def test_bpe_equals_the_library_and_round_trips(make_docs, small_docs):
    enc = tiktoken_encoding()
    for docs, warm in ((make_docs(*TEXTS), False), (make_docs(*TEXTS), True), (small_docs, False)):
        rows = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, warm=warm)
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        got = rows.collect()
        assert len(got) == docs.count()
        for r in got:
            assert r["ids"] == enc.encode_ordinary(texts[r["doc_id"]])
            assert bytes(r["decoded"]).decode() == texts[r["doc_id"]]
    digest = bpe.digests(rows).filter("doc_id = 0").first()
    assert digest["ids_sha256"] == hashlib.sha256(" ".join(map(str, enc.encode_ordinary(texts[0]))).encode()).hexdigest()
    assert bpe.round_trip(small_docs.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_long_texts_are_encoded_by_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 7)
    text = "Some words, " * 400_000
    got = bpe.round_trip(make_docs(text), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).first()
    assert len(text) > bpe.LONG_TEXT and bytes(got["decoded"]).decode() == text
    assert got["ids"][:8] == tiktoken_encoding().encode_ordinary(text[:100])[:8]
    assert len(got["ids"]) == len(tiktoken_encoding().encode_ordinary(text))


def test_every_language_is_learned(spark):
    """More languages than any old bound: a word of each, all predicted, by the sparse model and the dense one alike."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = ["".join(rng.choice(letters, 9)) for _ in range(300)]
    docs = spark.createDataFrame([(i, f"{w} {w}", f"l{i:03d}") for i, w in enumerate(words)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert len(model.langs) == 300
    dense = model.word_scores(words)
    assert [model.langs[i] for i in dense.argmax(axis=1)] == [f"l{i:03d}" for i in range(300)]
    kept, langid.DENSE, model.dense = langid.DENSE, 0, None
    try:
        assert np.allclose(model.word_scores(words + ["zz", "unseen", "é"])[:300], dense, atol=1e-9)
    finally:
        langid.DENSE = kept
    assert {r["lang_pred"] for r in langid.predict(docs, model).collect()} == set(model.langs)


def test_many_languages_share_the_room(spark):
    """With room for less than one n-gram a language each still has one; scripts beyond the basic plane are packed alike."""
    docs = spark.createDataFrame([(i, f"{chr(0x4E00 + i) * 3} x", f"l{i:03d}") for i in range(200)] + [(999, "\U00020000\U00020001\U00020000", "rare")], "doc_id long, text string, lang string")
    model = langid.learn(docs, all_grams=100)
    assert len(model.langs) == 201 and set(np.unique(model.langs_of)) == set(range(201))
    whole = langid.learn(docs)
    for gram in ("\U00020000", "\U00020001\U00020000", "^\U00020000\U00020001", "x", "^x$"):
        at = np.searchsorted(whole.grams, langid._packed(langid._points(gram), len(gram))[0])
        assert whole.grams[at] == langid._packed(langid._points(gram), len(gram))[0] and whole.sizes[at] == len(gram)
    assert {r["lang_pred"] for r in langid.predict(docs.filter("doc_id = 999"), whole).collect()} == {"rare"}


def test_blocks_change_no_label(monkeypatch):
    rng = np.random.default_rng(7)
    scores = rng.normal(size=(500, 3)).astype(np.float32)
    for n in range(1, 60):
        rows = rng.integers(0, 500, n)
        monkeypatch.setattr(langid, "ROOM", 10**9)
        whole = [langid._one_language(scores, rows, s) for s in (0.5, 5.0, 50.0)]
        monkeypatch.setattr(langid, "ROOM", 12)
        assert [langid._one_language(scores, rows, s) for s in (0.5, 5.0, 50.0)] == whole


def plain_scores(model, word):
    """Chances of a word in each language from the model's tables, one n-gram after the other."""
    padded, total = f"^{word.lower()}$", np.zeros(len(model.langs))
    places = {int(g): i for i, g in enumerate(model.grams)}
    for n in (1, 2, 3):
        for i in range(1 if n == 1 else 0, len(padded) - n + 1 - (n == 1)):
            key = 0
            for c in padded[i : i + n]:
                key = key << 21 | ord(c)
            if key not in places:
                total += model.base[0]
                continue
            total += model.base[n]
            a, b = model.firsts[places[key]], model.firsts[places[key] + 1]
            for lang, gain in zip(model.langs_of[a:b], model.gains[a:b]):
                total[lang] += gain
    fits = model.scripts.get(langid.script_of(word[0]))
    if fits is None:
        return np.full(len(total), -np.log(len(total)))
    total = np.where(fits, total, -np.inf)
    p = np.exp(total - total.max())
    return np.log(0.98 * p / p.sum() + 0.02 / len(p))


def test_predictions_equal_brute_force(spark, small_docs):
    """Words, scores, best path, prediction and spans of each text computed anew, word by word."""
    import re

    model = langid.learn(small_docs)
    texts = {r["doc_id"]: r["text"] or "" for r in small_docs.limit(30).collect()}
    texts[10**6] = texts[min(texts)][:150] + " мир " + max(texts.values(), key=len)[:150]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in langid.predict(docs, model).collect():
        text = texts[r["doc_id"]]
        found = [(m.start(), m.end(), "".join(filter(str.isalpha, m[0]))) for m in re.finditer(r"[^\W\d_]+", text)]
        if not any(w for _, _, w in found):
            assert (r["lang_pred"], r["score"], r["spans"]) == ("und", 0.0, [])
            continue
        table = np.array([plain_scores(model, w) if w else np.zeros(len(model.langs)) for _, _, w in found])
        letters = np.array([len(w) for _, _, w in found])
        label = {lang: i for i, lang in enumerate(model.langs)}
        path = np.full(len(found), -1)
        for s in r["spans"]:
            for i, (a, b, _) in enumerate(found):
                if s["start"] <= a and b <= s["end"]:
                    path[i] = label[s["lang"]]
        assert (path >= 0).all()
        cost = table[np.arange(len(path)), path].sum() - langid.SWITCH * (np.diff(path) != 0).sum()
        assert cost == pytest.approx(brute_viterbi(table, langid.SWITCH), abs=1e-3)
        share = np.bincount(path, letters, len(model.langs))
        assert share[label[r["lang_pred"]]] == share.max()
        assert r["score"] == pytest.approx(np.exp(table[:, label[r["lang_pred"]]]) @ letters / letters.sum(), abs=1e-4)


def test_higher_order_fold_equals_the_plain_one(spark, small_docs):
    import regex

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    words = {w for r in small_docs.limit(40).collect() for w in regex.findall(public_tokenizers.PATTERN, r["text"])} | {"é", " ", "\n\n", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\x00"}
    got = {r["word"]: r["ids"] for r in bpe.fold_distinct(spark.createDataFrame([(w,) for w in sorted(words)], "word string"), ranks).collect()}
    assert got == {w: [ranks[p] for p in bpe.fold_merges(w.encode(), ranks)] for w in words}
    found = bpe.frequent_words(small_docs, ranks, public_tokenizers.PATTERN)
    assert found and all(list(v) == [ranks[p] for p in bpe.fold_merges(k.encode(), ranks)] for k, v in list(found.items())[:2000])


def test_long_words_fold_alike():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = np.random.default_rng(0)
    for _ in range(200):
        word = bytes(rng.choice(list(b"aeinrst xyz\xc3\xa9"), rng.integers(41, 120)))
        short, bpe.SHORT = bpe.SHORT, sys.maxsize
        plain = bpe.fold_merges(word, ranks)
        bpe.SHORT = short
        assert bpe.fold_merges(word, ranks) == plain and b"".join(plain) == word


def brute_viterbi(scores, switch):
    state = scores[0].astype(float)
    for row in scores[1:]:
        state = np.maximum(state, state.max() - switch) + row
    return state.max()


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    texts = [rng.normal(size=(rng.integers(1, 40), 4)) * rng.choice([0.3, 1, 4]) for _ in range(200)]
    lengths = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    joined = np.concatenate(texts)
    path = langid._viterbi(joined, np.arange(len(joined)), starts, lengths, 3.0)
    for t, a, n in zip(texts, starts, lengths):
        p = path[a : a + n]
        cost = sum(t[i, p[i]] for i in range(n)) - 3.0 * sum(p[i] != p[i - 1] for i in range(1, n))
        assert cost == pytest.approx(brute_viterbi(t, 3.0))
        one = langid._one_language(t, np.arange(n), 3.0)
        if one >= 0:
            assert t[:, one].sum() == pytest.approx(cost)


def test_language_held_out_and_spans(spark, make_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.fold(F.col("doc_id"), 4) == 2
    model = langid.learn(docs.filter(~held))
    out = langid.predict(docs.filter(held), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in out)
    by_lang = {r["lang"]: r["text"] for r in docs.filter("n_chars > 1500").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).collect()}
    mixed = by_lang["en"][:700] + " " + by_lang["de"][:700]
    edge = make_docs(mixed, None, "", "123 !? ²", "ß", "Привет мир", "x" * 200_000, (3, "le de la"), (3, "le de la"))
    got = {}
    for r in langid.predict(edge, model).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [s["lang"] for s in got[0][0]["spans"]] == ["en", "de"] and got[0][0]["spans"][0]["end"] == pytest.approx(700, abs=60)
    assert [got[i][0]["lang_pred"] for i in (1, 2)] == ["und", "und"] and "und" in [r["lang_pred"] for r in got[3]]
    assert got[5][0]["lang_pred"] in model.langs and len(got[3]) == 3
    assert langid.predict(edge.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(edge, None).collect()} == {"und"}
    assert langid.learn(docs.limit(0)) is None


def test_scripts_narrow_candidates(spark):
    rows = [(i, "мама мыла раму и папу", "ru") for i in range(30)] + [(100 + i, "the cat sat on a mat", "en") for i in range(30)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    scores = np.exp(model.word_scores(["рама", "cat"]))
    assert scores[0][model.langs.index("ru")] > 0.97 and scores[1][model.langs.index("en")] > 0.97
    assert langid.script_of("я") == "Cyrillic" and langid.script_of("漢") == "Han" and langid.script_of("é") == "Latin"


def test_quality_held_out(spark, make_docs):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = quality.fold(F.col("doc_id"), 5) == 0
    model = quality.learn(docs, labels.filter(~held))
    out = quality.score(docs.filter(held), model).join(labels, "doc_id").collect()
    score, y = np.array([r["score"] for r in out]), np.array([r["quality"] for r in out])
    order = score.argsort().argsort()
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.99 and ((score >= 0.3) == y).mean() > 0.96
    print('held-out AUC', auc, 'share right at 0.3', ((score >= 0.3) == y).mean(), 'at 0.5', ((score >= 0.5) == y).mean())
    # Scores computed anew with the library alone: the difference of the whole texts' sizes decides, and nothing else.
    import zstandard

    texts = {r["doc_id"]: r["text"].encode() for r in docs.filter(held).limit(60).collect()}
    plain = dict(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    for r in [r for r in out if r["doc_id"] in texts]:
        size = {}
        for name, data in (("good", model.good), ("bad", model.bad)):
            tool = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data), **plain)
            size[name] = sum(len(tool.compress(texts[r["doc_id"]][i : i + 2048])) for i in range(0, len(texts[r["doc_id"]]), 2048))
        x = (size["bad"] - size["good"]) / (len(texts[r["doc_id"]]) + 64)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(model.at + model.slope * x))), abs=1e-9)
    assert model.slope > 0
    edge = make_docs(None, "", "x", "word " * 60_000, (9, "a"), (9, "a"))
    got = quality.score(edge, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    # Long texts train too.
    long = docs.withColumn("text", F.concat(F.repeat("text", 40)))
    assert quality.learn(long, labels.filter(~held), max_train=40, max_pieces=300) is not None
    assert quality.learn(docs, labels.filter("quality = 1")) is None
    assert {r["score"] for r in quality.score(edge, None).collect()} == {0.5}
    assert quality.score(edge.limit(0), model).count() == 0
