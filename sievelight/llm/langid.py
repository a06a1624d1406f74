"""Language ID: scripts narrow the candidates, Viterbi over per-word scores labels spans of mixed-language text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from sievelight.llm.common import materialize, small

#: Bounds of the model: labelled rows read of each language, n-grams kept of each, and of all together, which they
#: share equally. No language is ever left out, however many there are.
MAX_TRAIN, MAX_GRAMS, ALL_GRAMS = 2000, 20_000, 4_000_000
#: Bounds of memory in a task, which change no result: words kept, numbers held at a time, and numbers of a dense model.
MAX_WORDS, ROOM, DENSE = 100_000, 4_000_000, 8_000_000
#: Longest n-gram, cost of a switch of language (nats), and share of each word's chance that goes to all languages alike.
ORDER, SWITCH, NOISE = 3, 10.0, 0.02

#: First code point of Unicode ranges and the script of their letters.
SCRIPTS = [
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"),
    (0x0750, "Arabic"), (0x0780, "Thaana"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Bopomofo"),
    (0x3130, "Hangul"), (0x31F0, "Kana"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE70, "Arabic"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
]
_STARTS = [s for s, _ in SCRIPTS]

#: Runs of letters; matches may hold other numerals, which _letters drops.
_WORD = re.compile(r"[^\W\d_]+")


def script_of(letter: str) -> str:
    at = bisect_right(_STARTS, ord(letter)) - 1
    return SCRIPTS[at][1] if at >= 0 else "Other"


def script_column(letter: Column) -> Column:
    """script_of as a column of the first character."""
    names = F.array(*[F.lit(name) for _, name in SCRIPTS])
    before = F.size(F.filter(F.array(*map(F.lit, _STARTS)), lambda start: start <= F.ascii(letter)))
    return F.when(before > 0, F.element_at(names, before)).otherwise("Other")


def _letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null where the id is null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def _packed(points: np.ndarray, n: int) -> np.ndarray:
    """Each run of n code points as one integer; runs of other lengths never come out alike, as code points have 21 bits."""
    out = points[: len(points) - n + 1].copy()
    for k in range(1, n):
        out = (out << 21) | points[k : len(points) - n + 1 + k]
    return out


def _packed_column(gram: Column) -> Column:
    """_packed of a whole n-gram as a column."""
    points = [F.ascii(F.substring(gram, i + 1, 1)).cast("long") for i in range(ORDER)]
    packed = points[0]
    for n, point in enumerate(points[1:], 2):
        packed = F.when(F.length(gram) >= n, F.shiftleft(packed, 21).bitwiseOR(point)).otherwise(packed)
    return packed


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Model:
    """Languages by share, log chances of n-grams, and the languages that use each script.

    grams are the packed n-grams in order. An n-gram of n letters has the log chance base[n] in each language, and
    gains on it where the language has it: those of gram i are langs_of[firsts[i]:firsts[i + 1]] and gains likewise.
    base[0] is for n-grams that none has.
    """

    def __init__(self, langs: list[str], grams: np.ndarray, sizes: np.ndarray, base: np.ndarray, firsts: np.ndarray, langs_of: np.ndarray, gains: np.ndarray, scripts: dict[str, np.ndarray]):
        self.langs, self.grams, self.sizes, self.base, self.scripts = langs, grams, sizes, base, scripts
        self.firsts, self.langs_of, self.gains = firsts, langs_of, gains
        self.dense = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "dense": None}

    def _sums(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each word the sums of its n-grams' log chances; rows are places of n-grams plus one, 0 for unknown ones."""
        k = len(self.langs)
        if (len(self.grams) + 1) * k <= DENSE:
            if self.dense is None:
                self.dense = np.concatenate([self.base[:1], self.base[self.sizes]])
                self.dense[np.repeat(np.arange(1, len(self.grams) + 1), np.diff(self.firsts)), self.langs_of] += self.gains
            return np.add.reduceat(self.dense[rows], np.cumsum(counts) - counts, axis=0)
        word = np.repeat(np.arange(len(counts)), counts)
        kinds = np.where(rows > 0, self.sizes[np.maximum(rows, 1) - 1], 0)
        total = np.bincount(word * len(self.base) + kinds, minlength=len(counts) * len(self.base)).reshape(-1, len(self.base)) @ self.base
        known = np.flatnonzero(rows)
        first = self.firsts[rows[known] - 1]
        n = self.firsts[rows[known]] - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return total + np.bincount(np.repeat(word[known], n) * k + self.langs_of[at], self.gains[at], len(counts) * k).reshape(-1, k)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row for each word of letters: the log chance of each language, over the languages that use its script."""
        padded = [f"^{w.lower()}$" for w in words]
        sizes = np.array([len(w) for w in padded])
        points = _points("".join(padded))
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(points))  # characters from here to the word's end
        k = len(self.langs)
        total = np.zeros((len(words), k))
        for n in range(1, ORDER + 1):
            inside = left[: len(points) - n + 1] >= n
            if n == 1:  # single letters without the edges
                inside = (left > 1) & (left < np.repeat(sizes, sizes))
            keys = _packed(points, n)[inside]
            at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
            total += self._sums(np.where(self.grams[at] == keys, at + 1, 0), sizes - 2 if n == 1 else sizes - n + 1)
        anywhere = np.ones(k, bool)
        scripts = [script_of(w[0]) for w in words]
        total = np.where([self.scripts.get(x, anywhere) for x in scripts], total, -np.inf)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        scores = np.log((1 - NOISE) * p / p.sum(axis=1, keepdims=True) + NOISE / k)
        scores[[x not in self.scripts for x in scripts]] = -np.log(k)  # a script that no learned language uses
        return scores


def learn(docs: DataFrame, *, max_train: int = MAX_TRAIN, max_grams: int = MAX_GRAMS, all_grams: int = ALL_GRAMS) -> Model | None:
    """Model from docs(doc_id, text, lang) with non-null lang; None if there are none.

    Every language is learned. About max_train rows of each are drawn by a hash of the id. Words, their n-grams and
    the scripts of their first letters are counted by Spark; the most frequent n-grams of each language reach the
    driver as columns of numbers, max_grams of each or, of many languages, an equal share of all_grams but at least
    one, so the model does not grow with the data.
    """
    marked = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    counts = materialize(marked.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "langid-langs")
    langs = [r["lang"] for r in counts.orderBy(F.desc("rows"), "lang").collect()]
    if not langs:
        return None
    max_grams = min(max_grams, max(1, all_grams // len(langs)))
    drawn = marked.join(small(counts), "lang").filter(F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(1 << 20)) * F.col("rows") < max_train * (1 << 20))
    words = drawn.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w")).groupBy("lang", "w").count()
    words = materialize(words, "langid-words")
    scripts = words.groupBy("lang", script_column(F.col("w")).alias("script")).agg(F.sum("count").alias("n"))
    padded = F.concat(F.lit("^"), F.col("w"), F.lit("$"))
    size = F.length("w") + 2

    def pieces(n: int) -> Column:
        """All n-grams; single letters without the edges."""
        first, last = (F.lit(2), size - 1) if n == 1 else (F.lit(1), size - n + 1)
        return F.when(last >= first, F.transform(F.sequence(first, F.greatest(last, first)), lambda i: F.substr(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    grams = words.select("lang", "count", F.explode(F.concat(*map(pieces, range(1, ORDER + 1)))).alias("g")).groupBy("lang", "g").agg(F.sum("count").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "g")
    kept = grams.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= max_grams)
    own = kept.select("lang", _packed_column(F.col("g")).alias("g"), F.length("g").alias("size"), "n").toArrow()
    if not own.num_rows:  # labelled texts without a letter
        return None

    at = {lang: i for i, lang in enumerate(langs)}
    named = own.column("lang").combine_chunks().dictionary_encode()
    lang = np.array([at[x] for x in named.dictionary.to_pylist()], np.int64)[named.indices.to_numpy(zero_copy_only=False)]
    packed, size, n = (own.column(c).to_numpy().astype(np.int64) for c in ("g", "size", "n"))
    order, first, gram = np.unique(packed, return_index=True, return_inverse=True)
    sizes = size[first]
    sort = np.lexsort((lang, gram))
    gram, lang, n = gram[sort], lang[sort], n[sort]
    k = len(langs)
    # Log chances of n-grams of one length, smoothed by half a count.
    totals = [np.bincount(lang[sizes[gram] == m], n[sizes[gram] == m], k) for m in range(1, ORDER + 1)]
    rooms = np.array([t + 0.5 * (sizes == m + 1).sum() + 1 for m, t in enumerate(totals)])
    base = np.concatenate([np.log(0.5 / (sum(totals) / ORDER + 0.5 * len(order) + 1))[None], np.log(0.5 / rooms)])
    gains = np.log((n + 0.5) / 0.5).astype(np.float32)
    firsts = np.searchsorted(gram, np.arange(len(order) + 1))
    uses: dict[str, np.ndarray] = {}
    for r in scripts.collect():  # at most the scripts times the languages
        uses.setdefault(r["script"], np.zeros(k))[at[r["lang"]]] += r["n"]
    all_letters = sum(uses.values(), np.zeros(k))
    # A language uses a script in which it writes a hundredth of its words or more; a script that none uses so stands open to those that have it.
    open_to = {s: (v >= 0.01 * np.maximum(all_letters, 1)) if (v >= 0.01 * np.maximum(all_letters, 1)).any() else v > 0 for s, v in uses.items()}
    return Model(langs, order, sizes, base, firsts, lang, gains, open_to)


class _Words(dict):
    """Word -> row of a matrix of scores; row 0, which favours none, is for matches without letters."""

    def __init__(self, model: Model | None):
        super().__init__()
        self.model = model
        self.scores, self.sizes = np.zeros((1, len(model.langs) if model else 1), np.float32), np.zeros(1, np.int32)

    def add(self, words: set[str]) -> None:
        letters = {w: _letters(w) for w in words - self.keys()}
        self.update((w, 0) for w, x in letters.items() if not x)
        new = [w for w, x in letters.items() if x]
        if new:
            self.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
            own = [letters[w] for w in new]
            step = max(1, min(10_000, ROOM // len(self.model.langs)))
            blocks = [self.model.word_scores(own[i : i + step]).astype(np.float32) for i in range(0, len(own), step)]
            self.scores = np.concatenate([self.scores, *blocks])
            self.sizes = np.concatenate([self.sizes, np.array([len(x) for x in own], np.int32)])


def _one_language(scores: np.ndarray, rows: np.ndarray, switch: float) -> int:
    """The language that labels all words on the best path, or -1 where that is not certain; rows are the words' scores.

    Of paths beside the single best language: one that uses it too has as many switches as stretches in other
    languages, or more, so it gains nothing if no stretch favours another language by more than switch. One that
    never uses it has a switch less than stretches, of which one is a prefix and one a suffix; it gains nothing if
    moreover the best prefix and the best suffix together do not favour others by more than switch. Long texts are
    gone through in blocks.
    """
    k = scores.shape[1]
    blocks = range(0, len(rows), max(1, ROOM // k))
    best = int(sum(scores[rows[at : at + blocks.step]].sum(axis=0, dtype=np.float64) for at in blocks).argmax())
    last, low, high, stretch = np.zeros(k), np.zeros(k), 0.0, -np.inf
    for at in blocks:
        own = scores[rows[at : at + blocks.step]]
        gain = last + np.cumsum(own - own[:, best : best + 1], axis=0, dtype=np.float64)
        before = np.minimum(np.minimum.accumulate(np.concatenate([low[None], gain]), axis=0), 0)
        stretch = max(stretch, (gain - before[:-1]).max())
        last, low, high = gain[-1], before[-1], max(high, gain.max())
    return best if max(stretch, high + (last - low).max()) <= switch else -1


def _viterbi(scores: np.ndarray, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each word of many texts; a change of language between words costs switch.

    Texts stand one after the other in rows, which names the scores of each word, and are worked through side by
    side, a word of each at a step.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    k = scores.shape[1]
    own = np.arange(k)
    kind = np.int16 if k < 1 << 15 else np.int32
    back, path = np.empty((len(rows), k), kind), np.empty(len(rows), kind)
    state = scores[rows[starts]].astype(np.float64)
    ends = np.empty(len(starts), kind)
    live = len(starts)
    for t in range(1, int(lengths[0]) + 1):
        now = int(np.searchsorted(-lengths, -t, "left"))  # texts with more than t words
        ends[now:live] = state[now:live].argmax(axis=1)
        live = now
        if not live:
            break
        at, held = starts[:live] + t, state[:live]
        top = held.argmax(axis=1)[:, None]
        moved = np.take_along_axis(held, top, 1) - switch
        stay = held >= moved
        back[at] = np.where(stay, own, top)
        state[:live] = np.where(stay, held, moved) + scores[rows[at]]
    last = starts + lengths - 1
    path[last] = ends
    for t in range(int(lengths[0]) - 1, 0, -1):
        live = int(np.searchsorted(-lengths, -t, "left"))
        at = starts[:live] + t
        path[at - 1] = back[at, path[at]]
    return path


def label(texts: list[str | None], words: _Words, switch: float = SWITCH) -> list[tuple[str, float, list]]:
    """(language, score, spans) of each text; words keeps the scores of words seen before."""
    model = words.model
    parts, lengths = [], []
    for at in range(0, len(texts), 64):  # the words themselves are held for a few texts at a time
        found = [_WORD.findall(t) if t else [] for t in texts[at : at + 64]]
        words.add(set(chain.from_iterable(found)))
        lengths += map(len, found)
        parts.append(np.fromiter(map(words.__getitem__, chain.from_iterable(found)), np.int32, sum(map(len, found))))
    found = None
    rows = np.concatenate([np.empty(0, np.int32), *parts])
    lengths = np.array(lengths, np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[: len(texts)].astype(np.int64)
    single = [_one_language(words.scores, rows[a : a + n], switch) if n else 0 for a, n in zip(starts, lengths)]
    mixed = [i for i, x in enumerate(single) if x < 0]
    paths = {}
    room = max(1, ROOM // len(model.langs))
    while mixed:  # as many texts side by side as fit into a bounded number of words
        total = np.cumsum(lengths[mixed])
        n = max(1, int(np.searchsorted(total, room, "right")))
        group, mixed = mixed[:n], mixed[n:]
        joined = np.concatenate([np.arange(starts[i], starts[i] + lengths[i]) for i in group])
        at = np.concatenate([[0], np.cumsum(lengths[group])])
        path = _viterbi(words.scores, rows[joined], at[:-1], lengths[group], switch)
        paths.update((i, path[a:b]) for i, a, b in zip(group, at[:-1], at[1:]))
    out = []
    for i, (text, a, n) in enumerate(zip(texts, starts, lengths)):
        own, weight = rows[a : a + n], words.sizes[rows[a : a + n]]
        letters = int(weight.sum())
        if not letters:
            out.append(("und", 0.0, []))
            continue
        path = paths.get(i)
        share = np.bincount(path, weight, len(model.langs)) if path is not None else None
        best = single[i] if share is None else int(share.argmax())  # of equals the one with more rows, as they stand so
        chance = min(1.0, float(np.exp(words.scores[own, best].astype(np.float64)) @ weight / letters))
        if path is None or (ends := np.flatnonzero(np.diff(path, append=-1))).size == 1:
            out.append((model.langs[best], chance, [(0, len(text), model.langs[best])]))
            continue
        places = [m.span() for m in _WORD.finditer(text)]
        firsts = np.concatenate([[0], ends[:-1] + 1])
        out.append((model.langs[best], chance, [(places[x][0], places[y][1], model.langs[path[y]]) for x, y in zip(firsts, ends)]))
    return out


def _parts(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about size bytes of text, or one row if that is longer."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def predict(docs: DataFrame, model: Model | None, *, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), spans (array of start, end, lang; code points) for every row and whole text.

    Words are runs of letters. Each scores the languages that use its script; the best path over the words, with
    a penalty for each switch, gives spans, and the language with most letters in its spans is predicted. The
    score is the mean chance of that language over the letters. Text that is null or has no letter is `und`
    with score 0 and no spans; so is everything without a model. Repeated rows are labelled each; other
    columns are ignored; an empty table gives no rows. Nothing is shuffled.
    """
    return annotate(docs.select("doc_id", "text"), model, "found", switch=switch).select("doc_id", "found.*")


def annotate(docs: DataFrame, model: Model | None, column: str, *, switch: float = SWITCH) -> DataFrame:
    """All columns of docs(text, ...) and one more, whose name docs must not have: lang_pred, score and spans as predict has them.

    Nothing is joined. The model is broadcast.
    """
    if column in docs.columns:
        raise ValueError(f"docs has a column {column}")
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"`{column}` struct<lang_pred:string,score:double,spans:array<struct<start:int,end:int,lang:string>>>").fields])
    at = docs.columns.index("text")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    held = docs.sparkSession.sparkContext.broadcast(model)
    most = max(1000, min(MAX_WORDS, ROOM // len(model.langs))) if model is not None else 0

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        words = _Words(model)
        for batch in frames:
            for rows in _parts(batch, at):
                if len(words) > most:
                    words = _Words(model)
                texts = rows.column(at).to_pylist()
                found = label(texts, words, switch) if model is not None else [("und", 0.0, [])] * len(texts)
                spans = pa.array([[{"start": a, "end": b, "lang": c} for a, b, c in x[2]] for x in found], span)
                own = pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), spans], ["lang_pred", "score", "spans"])
                yield pa.RecordBatch.from_arrays([*rows.columns, own], schema.names)

    # Columns go in under plain names, as a task's rows are looked up by theirs.
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(batches, schema)
