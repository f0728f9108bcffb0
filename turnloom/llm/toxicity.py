"""Toxicity of restored text: a noisy channel over characters, then a word model.

1. Language model: counts of character trigrams (28 classes: boundary, a-z, other letters) over all texts.
   Each Arrow batch is counted by numpy and summed; at most 28 ** 3 counts ever leave a task.
2. Restoration: words that aren't plain (digits or marks among or around letters, letters doubled or drawn
   out, letters spaced apart) become a lattice: a character may stand for itself or for the letters it
   imitates, be noise inside a word, or repeat the one before. Viterbi over pairs of characters finds the
   most likely letters under the language model and the channel's costs. A mark at a word's edge may be
   punctuation or a letter; the model of characters can't always tell ("a$$"), so such a word shows the best
   letters of each reading. A plain word with a doubled letter shows itself, too.
3. Score: logistic regression on the restored words: how often words of the learned list occur, and
   which. It is fitted on the driver on at most ``most_labelled`` labelled rows, taken in hash order of
   doc_id, one for each distinct text, and only from rows with crc32(doc_id) mod 5 <> 0.

Scores use the text alone. Scale: two passes without any shuffle of text, plus a look-up of the labelled
sample, whose texts stay on the executors; the driver gets the trigram counts, a word list and the few
features of at most ``most_labelled`` rows.

Defined cases: null, empty and blank texts score the model's bias; no labels, or labels of one class only, give
the share of that class (0 without any), and null labels or ids don't count; of several labels of a document the highest holds; of
equal texts one is learned from; repeated rows score alike; texts and their words are scored whole, however long; words of digits
alone are numbers; an empty table gives an empty table; other columns pass through drop_toxic and are no input.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm import workers
from turnloom.session import spread, staged, text_batches

MOST_LABELLED, MOST_WORDS, LEAST_DOCS = 20_000, 256, 5
#: What a character may imitate, a property of how people write around filters.
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l"}
#: Natural logs of the channel.
SAME, IMITATED, NOISE, DRAWN_OUT, DOUBLED, LOST = -0.05, -1.5, -1.0, -0.7, -3.5, -7.0
N_CLASSES = 28
LETTERS = 32
OTHER = 27
UNIT = rf"(?:[^\W_]|[{re.escape(''.join(c for c in IMITATES if not c.isalnum()))}])"
#: Three or more single letters or imitating characters; no character is both that and a gap, so a search is linear.
SPACED = re.compile(rf"(?<![^\W_]){UNIT}(?:[\s._*\-]+{UNIT}){{2,}}(?![^\W_])")
DOUBLE = re.compile(r"(.)\1")
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…“”„«»‘’–—¿¡"
#: Marks that imitate no letter, so at an edge they are punctuation.
IDLE = "".join(c for c in EDGE if c not in IMITATES)


def _byte_classes() -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[97:123] = table[65:91] = np.arange(1, 27)
    table[128:] = OTHER
    return table


def _char_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    workers.free()
    table, counts = _byte_classes(), np.zeros(N_CLASSES**3, np.int64)
    for batch in batches:
        for t in batch.column(0).to_pylist():
            if t:
                c = table[np.frombuffer((" " + t + " ").encode(), np.uint8)]
                counts += np.bincount((c[:-2] * N_CLASSES + c[1:-1]) * N_CLASSES + c[2:], minlength=N_CLASSES**3)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["trigram", "n"])


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log probabilities [a, b, c] of class c after a, b, from all texts."""
    rows = spread(docs.select(text)).mapInArrow(_char_counts, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect()  # 28 ** 3 rows at most
    counts = np.zeros(N_CLASSES**3)
    for trigram, n in rows:
        counts[trigram] = n
    counts = counts.reshape(N_CLASSES, N_CLASSES, N_CLASSES)
    pairs = counts.sum(0)
    back = (pairs + 0.5) / (pairs + 0.5).sum(1, keepdims=True)
    return np.log((counts + 5.0 * back[None]) / (counts.sum(2, keepdims=True) + 5.0))


def marks(word: str) -> list[str]:
    """What a restored word shows: itself and its beginnings of 3 to 7 letters (compounds share those)."""
    return [word, *(word[:k] + "~" for k in range(3, min(len(word), 8)))] if word else []


def spelled(path: tuple | None) -> str:
    letters = []
    while path:
        path, last = path
        letters.append(last)
    return "".join(reversed(letters))


def beginning(path: tuple | None, known: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """How many letters a path has, and the first of them, enough for its marks. known: what is told of the paths it goes on from, by their id."""
    way = []
    while path and id(path) not in known:
        way.append(path)
        path = path[0]
    n, head = known[id(path)] if path else (0, "")
    for step in reversed(way):
        n, head = n + 1, head + step[1] if n < 8 else head
        known[id(step)] = n, head
    return n, head


class Restorer:
    """wanted: the marks to count; None counts all."""

    def __init__(self, lm: np.ndarray, wanted: dict[str, int] | None = None):
        self.lm = lm.tolist()
        self.wanted = wanted
        self.heads = None if wanted is None else {m[:3] for m in wanted}  # all marks of a word begin as it does
        self.known: dict[str, tuple[str, ...]] = {}

    def shown(self, word: str, whole: bool = True) -> tuple[str, ...]:
        """The marks of a word; of its beginnings only, if ``word`` is not the whole word."""
        if self.heads is not None and word[:3] not in self.heads:
            return ()
        return tuple(m for m in marks(word)[not whole :] if self.wanted is None or m in self.wanted)

    def viterbi(self, word: str) -> str:
        """The most likely letters behind a word without white space, in lower case."""
        return self.best_path(word)[1]

    def best_path(self, word: str) -> tuple[float, str]:
        """The log likelihood of the best path and its letters."""
        score, path = self.endings(word, [len(word)])[0]
        return score, spelled(path)

    def endings(self, word: str, cuts: list[int], loose: int = 0) -> list[tuple[float, tuple | None]]:
        """Scores and paths of the word's beginnings up to each of ``cuts`` (ascending), in one pass; a path is (path before, last letter). The first ``loose`` characters may be noise."""
        lm = self.lm
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # letters as (letters before, last one)
        found: list[tuple[float, tuple | None]] = []
        run = 0
        for i, ch in enumerate(word):
            if len(found) < len(cuts) and cuts[len(found)] == i:
                found.append(self.ending(states))
            run = run + 1 if i and word[i - 1] == ch else 1
            drawn = run > 1 and (word[i + 1 : i + 2] == ch or run > 2)
            if ch.isalpha():
                options = [(ch, SAME)] + ([("", DRAWN_OUT if drawn else DOUBLED)] if run > 1 else [])
            else:
                options = [(x, IMITATED) for x in IMITATES.get(ch, "")] + [("", LOST if ch in IMITATES and i >= loose else NOISE)]
            nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, out) in states.items():
                for emitted, cost in options:
                    if emitted:
                        c = ord(emitted) - 96 if "a" <= emitted <= "z" else OTHER
                        key, s, o = (b, c), score + cost + lm[a][b][c], (out, emitted)
                    else:
                        key, s, o = (a, b), score + cost, out
                    if key not in nxt or s > nxt[key][0]:
                        nxt[key] = (s, o)
            states = nxt
        if len(found) < len(cuts):
            found.append(self.ending(states))
        return found

    def ending(self, states: dict[tuple[int, int], tuple[float, tuple | None]]) -> tuple[float, tuple | None]:
        return max(((score + self.lm[a][b][0], out) for (a, b), (score, out) in states.items()), key=lambda x: x[0])

    def word(self, raw: str) -> str:
        """The likeliest restored form of one lower-case word."""
        return self.forms(raw)[0][0]

    def forms(self, raw: str) -> list[tuple[str, bool]]:
        """The restored forms of one lower-case word, the likeliest first; more than one if it has marks at its edges that imitate letters, or a doubled letter.

        A form is its letters and whether they are all of it: the likeliest is, and so are those of up to LETTERS letters; of longer ones there is the
        beginning, so that a word with very many marks takes time and room by its length."""
        bare, marked = raw.strip(EDGE), raw.strip(IDLE)
        plain = bare.isalpha()
        if plain and bare == marked and not DOUBLE.search(bare):
            return [(bare, True)]  # marks at the edge are punctuation
        if not any(c.isalpha() or c in IMITATES and not c.isdigit() for c in raw):
            return [(bare, True)]
        lead = len(marked) - len(marked.lstrip(EDGE)) if bare else 0
        end, size = lead + len(bare), len(marked)
        cuts = [i for i in range(max(end, 1), size + 1) if i in (end, size) or marked[i] != marked[i - 1]]  # marks after a cut are punctuation
        read = self.endings(marked, cuts)
        if lead:  # each mark of the beginning a letter, or as is likelier, or punctuation
            read += self.endings(marked, cuts, lead) + [(s + NOISE * lead, x) for s, x in self.endings(marked[lead:], [i - lead for i in cuts])]
        read = sorted([(s + NOISE * (size - i), x) for (s, x), i in zip(read, cuts * 3)], key=lambda x: -x[0])
        sizes: dict[int, tuple[int, str]] = {}
        told = [(spelled(read[0][1]), True)]
        for _, path in read[1:]:
            n, head = beginning(path, sizes)
            told.append((spelled(path), True) if n <= LETTERS else (head, False))
        return list(dict.fromkeys(told + ([(bare, True)] if plain else [])))

    def shown_by(self, raw: str) -> tuple[str, ...]:
        if raw.isalpha() and not DOUBLE.search(raw):
            return self.shown(raw)  # its only form
        forms = self.forms(raw)
        return self.shown(*forms[0]) if len(forms) == 1 else tuple(dict.fromkeys(m for form in forms for m in self.shown(*form)))

    def counts(self, text: str | None) -> Counter:
        """Marks of the restored words with their counts."""
        found: Counter = Counter()
        if not text:
            return found
        low = text.lower()
        known = self.known
        for raw, n in Counter(low.split()).items():
            shown = known.get(raw)
            if shown is None:
                if len(known) > (20_000 if self.wanted is None else 100_000):
                    known.clear()
                shown = known[raw] = self.shown_by(raw)
            for m in shown:
                found[m] += n
        for m in SPACED.finditer(low):
            letters = self.viterbi(re.sub(r"[\s._*\-]+", "", m[0]))  # linear, so the whole run
            start, end = m.span()
            while start and low[start - 1] in EDGE:
                start -= 1
            while end < len(low) and low[end] in EDGE:
                end += 1
            alone = len(m[0].split()) == 1 and (start == 0 or low[start - 1].isspace()) and (end == len(low) or low[end].isspace())
            told = self.shown_by(low[start:end]) if alone else ()  # a dotted word was counted as a word
            found.update(x for size in range(3, min(len(letters), 14) + 1) for at in range(len(letters) - size + 1) for x in self.shown(letters[at : at + size])[:1] if x not in told)
        return found


class Scorer:
    """Weights over a word list and over how many of its words occur; pickled to the workers."""

    def __init__(self, words: list[str], weights: np.ndarray):
        self.at = {w: i for i, w in enumerate(words)}
        self.weights = weights  # bias, log count, share, then one a word

    def features(self, counts: Counter, length: int) -> np.ndarray:
        x = np.zeros(3 + len(self.at))
        x[0] = 1.0
        total = 0
        for mark, n in counts.items():
            i = self.at.get(mark)
            if i is not None:
                x[3 + i] = 1.0
                if mark[-1] != "~":
                    total += n
        x[1] = math.log1p(total)
        x[2] = min(1.0, 20.0 * total / max(length, 1))
        return x

    def score(self, counts: Counter, length: int) -> float:
        z = float(self.features(counts, length) @ self.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _mark_counts(batches: Iterator[pa.RecordBatch], lm: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (mark, toxic and clean texts that show it); partial counts, flushed as they grow."""
    workers.free()
    restorer, found = Restorer(lm), ({}, {})

    def flush() -> pa.RecordBatch:
        keys = list(found[0].keys() | found[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([found[y].get(k, 0) for k in keys], pa.int64()) for y in (1, 0))], ["mark", "n1", "n0"])
        found[0].clear()
        found[1].clear()
        return out

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                mine = found[1 if y else 0]
                for mark in restorer.counts(text):
                    mine[mark] = mine.get(mark, 0) + 1
            if len(found[0]) + len(found[1]) > 50_000:
                yield flush()
    yield flush()


def choose_words(sample: DataFrame, lm: np.ndarray, most_words: int, least_docs: int) -> list[str]:
    """The marks that speak most for toxic texts; at most ``most_words`` reach the driver."""
    total = {bool(r["toxic"]): r["n"] for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(True, 0), total.get(False, 0)
    if not n1 or not n0:
        return []
    counted = sample.select("text", "toxic").mapInArrow(lambda it: _mark_counts(it, lm), "mark string, n1 long, n0 long").groupBy("mark").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    odds = F.log(((F.col("n1") + 0.5) / (n1 + 1.0)) / ((F.col("n0") + 0.5) / (n0 + 1.0))) * F.sqrt("n1")
    best = counted.where((F.col("n1") >= max(least_docs, 0.01 * n1)) & (F.col("n1") * float(n0) > 10.0 * F.col("n0") * float(n1))).orderBy(F.round(odds, 6).desc(), "mark").limit(most_words)
    return sorted(r["mark"] for r in best.select("mark").collect())


def _features(batches: Iterator[pa.RecordBatch], lm: np.ndarray, scorer: Scorer) -> Iterator[pa.RecordBatch]:
    restorer = Restorer(lm, scorer.at)
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            rows = [scorer.features(restorer.counts(t), len(t.split()) if t else 0) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([x[1:3].tolist() for x in rows]), pa.array([np.flatnonzero(x[3:]).tolist() for x in rows], pa.list_(pa.int32()))], ["toxic", "dense", "shown"])


def fit(sample: DataFrame, lm: np.ndarray, most_words: int = MOST_WORDS, least_docs: int = LEAST_DOCS) -> Scorer:
    """sample: (text, toxic), bounded by the caller. Its few features a row are fitted on the driver."""
    words = choose_words(sample, lm, most_words, least_docs)
    model = Scorer(words, np.zeros(3 + len(words)))
    rows = sample.select("text", "toxic").mapInArrow(lambda it: _features(it, lm, model), "toxic int, dense array<double>, shown array<int>").collect()
    labels = np.array([float(r[0] > 0) for r in rows])
    share = float(labels.mean()) if len(labels) else 0.0
    if not words or not 0 < share < 1:
        z = math.log(share / (1 - share)) if 0 < share < 1 else 30.0 if share else -30.0
        return Scorer([], np.array([z, 0.0, 0.0]))
    x = np.zeros((len(rows), 3 + len(words)), np.float32)
    for i, r in enumerate(rows):
        x[i, 0] = 1.0
        x[i, 1:3] = r[1]
        x[i, [3 + j for j in r[2]]] = 1.0
    x, labels = x[order := np.lexsort((*x.T[:3], labels))], labels[order]  # the same sums whatever the order of arrival
    w = model.weights
    ridge = np.full(len(w), 1.0)
    ridge[:3] = [1e-4, 1e-2, 1e-2]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (labels - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = np.round(w, 9)
    return model


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> tuple[np.ndarray, Scorer]:
    """docs: (doc_id, text); labels: (doc_id, toxic). The language model from all docs, the scorer from the labelled sample."""
    text_batches(docs.sparkSession)
    lm = language_model(docs)
    mine = labels.where("doc_id is not null and toxic is not null").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = mine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)  # a bounded top-k
    rows = docs.join(F.broadcast(chosen), "doc_id").where("text is not null")
    one = rows.groupBy(F.md5("text")).agg(F.min(F.struct("doc_id", "toxic", "text")).alias("r")).select("r.text", F.col("r.toxic").cast("int").alias("toxic"))
    return lm, fit(staged(one, "labelled"), lm)


def score_documents(docs: DataFrame, lm: np.ndarray, scorer: Scorer, text: str = "text") -> DataFrame:
    """``docs`` with a last column ``score`` (double). Other columns pass through."""
    text_batches(docs.sparkSession)
    schema = docs.drop("score").schema.add("score", "double")
    names = [f.name for f in schema][:-1]
    shipped = docs.sparkSession.sparkContext.broadcast((lm, scorer))  # 28 ** 3 numbers and a short word list

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.free()
        model, by = shipped.value
        restorer = Restorer(model, by.at)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = [by.score(restorer.counts(t), len(t.split()) if t else 0) for t in part.column(names.index(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*names, "score"])

    return spread(docs.drop("score")).mapInArrow(run, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    lm, scorer = train(docs.select("doc_id", "text"), labels, most_labelled)
    scored = score_documents(docs.select("doc_id", "text"), lm, scorer)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """The documents scored below 0.5, with the columns of ``docs``."""
    lm, scorer = train(docs.select("doc_id", "text"), labels, most_labelled)
    narrow = docs.select(*docs.columns)
    return score_documents(narrow.withColumnRenamed("score", "__score") if "score" in docs.columns else narrow, lm, scorer).where("score < 0.5").drop("score").toDF(*docs.columns)
