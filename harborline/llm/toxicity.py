"""Toxicity by a support vector machine on a subsequence string kernel, approximated with Nyström landmarks.

The kernel compares two words by the three-letter subsequences they share, each occurrence weighted by DECAY to the
number of letters it skips, within SPAN letters. A word with inserted or replaced characters therefore stays near the word
it comes from, and marks between letters do not count at all. The kernel, divided by the root of each word's squared weights
(one for each occurrence), to the power of DEGREE is again a kernel
and tells near words from words that merely share a syllable.

Landmarks are words of labelled sentences: those that tell toxic documents best (log-likelihood ratio of their document
counts) and as many that stand for the rest. A sentence is the sum of its words' Nyström features. Only documents are labelled, so
the machine is fitted a few times, and each time the sentences of toxic documents that it does not find toxic leave the
positive side. A document's score is a logistic function of its worst and mean sentences and its worst words.

Fitting takes a bounded sample of labelled rows to the driver; scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import re
import warnings
import zlib
from array import array
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from harborline.llm.common import free_names, on_workers

SPAN = 4
DECAY = 0.6
DEGREE_DOUBLINGS = 3
DEGREE = 2**DEGREE_DOUBLINGS
LANDMARKS = 192
PENALTY = 1.0
ROUNDS = 3
# The bound of the sample to fit on: rows per class, characters per text, and characters of all texts of a class together.
# With about 60 characters a sentence and 0.8 kB for each of them, the fit holds less than 300 MB.
FIT_ROWS = 3000
FIT_CHARS = 20_000
FIT_TOTAL = 8_000_000
HELD_OUT_FOLDS = 5

# Words a worker remembers, words and texts scored together, sentences fitted together; none changes a result.
MEMORY_WORDS = 300_000
BATCH_SENTENCES = 16_384
BATCH_WORDS = 1_000
BATCH_TEXTS = 64

NOT_IN_WORD = re.compile(r"[^\w]|_")
SPELLED_OUT = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
OFFSETS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]


def letter_codes() -> np.ndarray:
    """Codes 1 to 63 of letters by code point (plain Latin letters each have their own); 0 for everything else."""
    codes = np.zeros(0x10000, np.int32)
    for point in range(len(codes)):
        if not 0xD800 <= point < 0xE000 and chr(point).isalpha():
            codes[point] = point - 96 if 97 <= point <= 122 else 27 + point % 37
    return codes


LETTERS = letter_codes()


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence, lower-cased; letters spelled out one by one make one more word.

    A sentence ends with a line, or with a full stop, exclamation or question mark before a blank.
    """
    if not text:
        return []
    text = text.lower()
    found = [w for s in text.replace("! ", ". ").replace("? ", ". ").replace("\n", ". ").split(". ") if (w := s.split())]
    if sum([list(map(len, s)).count(1) for s in found]) > 2:
        found += [["".join(m.group().split())] for m in SPELLED_OUT.finditer(text)]
    return found


def plain_word(token: str) -> str:
    return token if token.isalpha() else NOT_IN_WORD.sub("", token)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words: the word's number, the subsequence's code and the weight of each occurrence."""
    gap = "\0" * SPAN
    points = np.frombuffer((gap.join(words) + gap).encode("utf-32-le", "replace"), np.uint32)
    codes = LETTERS[np.minimum(points, len(LETTERS) - 1)]
    owner = np.repeat(np.arange(len(words)), [len(w) + SPAN for w in words])
    n = len(codes) - SPAN
    owners, keys, weights = [], [], []
    for a, b in OFFSETS:
        x, y, z = codes[:n], codes[a:n + a], codes[b:n + b]
        at = np.flatnonzero((x > 0) & (y > 0) & (z > 0))
        owners.append(owner[at])
        keys.append((x[at] << 12) | (y[at] << 6) | z[at])
        weights.append(np.full(len(at), DECAY ** (b - 2)))
    return np.concatenate(owners), np.concatenate(keys), np.concatenate(weights)


@dataclass
class Landmarks:
    """The kernel between any words and the landmarks, by the subsequences that landmarks have."""

    words: list[str]
    number: np.ndarray = field(init=False)
    starts: np.ndarray = field(init=False)
    owners: np.ndarray = field(init=False)
    weights: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        owner, key, weight = subsequences(self.words)
        known = np.unique(key)
        self.number = np.zeros(1 << 18, np.int32)
        self.number[known] = np.arange(1, len(known) + 1)
        table = np.zeros((len(known) + 1, len(self.words)))
        np.add.at(table, (self.number[key], owner), weight)
        norm = np.sqrt(np.bincount(owner, weight**2, len(self.words)))
        feature, self.owners = np.nonzero(table)
        self.weights = table[feature, self.owners] / norm[self.owners]
        self.starts = np.searchsorted(feature, np.arange(len(table) + 1))

    def kernel(self, words: list[str]) -> np.ndarray:
        """One row per word, one column per landmark; a word without a subsequence is like none."""
        owner, key, weight = subsequences(words)
        norm = np.sqrt(np.bincount(owner, weight**2, len(words)).astype(float))
        feature = self.number[key]
        hit = feature > 0
        owner, weight, feature = owner[hit], weight[hit], feature[hit]
        n = self.starts[feature + 1] - self.starts[feature]
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) + np.repeat(self.starts[feature] - np.cumsum(n) + n, n)
        size = len(self.words)
        found = np.bincount(owner[row] * size + self.owners[at], self.weights[at] * weight[row], len(words) * size).astype(float).reshape(-1, size)
        found /= np.maximum(norm, 1e-9)[:, None]
        for _ in range(DEGREE_DOUBLINGS):
            found *= found
        return found


def document_features(sentence_scores: np.ndarray, word_scores: np.ndarray) -> list[float]:
    worst, worst_words = np.sort(sentence_scores), np.sort(word_scores)
    n, few, few_words = len(worst), worst[-3:], worst_words[-3:]
    return [worst[-1], few.sum() / len(few), worst.sum() / n, (n - worst.searchsorted(0.0, "right")) / n, worst_words[-1], few_words.sum() / len(few_words)]


@dataclass
class Model:
    landmarks: Landmarks
    alpha: np.ndarray  # of each landmark, in a word's score
    offset: float  # of a sentence
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    logit: np.ndarray | None = None
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def word_scores(self, tokens: list[str]) -> np.ndarray:
        """The score of each token; words not known yet are scored together."""
        if len(tokens) > MEMORY_WORDS:
            return np.concatenate([self.word_scores(tokens[at:at + MEMORY_WORDS]) for at in range(0, len(tokens), MEMORY_WORDS)])
        found = np.fromiter(map(self.known.get, tokens, repeat(np.nan)), float, len(tokens))
        missing = np.flatnonzero(np.isnan(found))
        if len(missing):
            new = list({tokens[n] for n in missing})
            if len(self.known) + len(new) > MEMORY_WORDS:
                self.known.clear()
            for at in range(0, len(new), BATCH_WORDS):
                part = new[at:at + BATCH_WORDS]
                self.known.update(zip(part, (self.landmarks.kernel([plain_word(w) for w in part]) @ self.alpha).tolist()))
            found[missing] = [self.known[tokens[n]] for n in missing]
        return found

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Six figures per text, of its sentences and words; a text without words is a sentence without words."""
        split = [sentences(t) for t in texts]
        scored = self.word_scores([w for found in split for s in found for w in s])
        sizes = np.array([len(s) for found in split for s in found], int)
        of_sentences = np.add.reduceat(scored, np.cumsum(sizes) - sizes) + self.offset if len(sizes) else scored
        words = np.cumsum([0, *[sum(map(len, found)) for found in split]])
        ends = np.cumsum([0, *map(len, split)])
        empty = [self.offset, self.offset, self.offset, float(self.offset > 0), 0.0, 0.0]
        rows = [
            document_features(of_sentences[a:b], scored[c:d]) if b > a else empty for a, b, c, d in zip(ends[:-1], ends[1:], words[:-1], words[1:])
        ]
        return np.array(rows, float).reshape(-1, 6)

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        texts = list(texts)
        parts = [self.features(texts[at:at + BATCH_TEXTS]) for at in range(0, len(texts), BATCH_TEXTS)]
        x = (np.concatenate([np.empty((0, 6)), *parts]) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.logit[:-1] + self.logit[-1], -500, 500)))


def fit(texts: list[str | None], toxic: np.ndarray, weight: np.ndarray | None = None) -> Model:
    """A model from texts and their labels. ``weight``: how many rows each stands for. With one class it scores that class's share."""
    toxic = np.asarray(toxic, int)
    weight = np.ones(len(toxic)) if weight is None else np.asarray(weight, float)
    # Words as numbers in plain arrays: the lists of a text's words live no longer than the loop over it.
    document, sizes, word, number = array("i"), array("i"), array("i"), {}
    for n, text in enumerate(texts):
        for s in sentences(text):
            document.append(n)
            sizes.append(len(s))
            word.extend(number.setdefault(plain_word(w), len(number)) for w in s)
    document, sizes, word = (np.frombuffer(a, "i4") if a else np.empty(0, "i4") for a in (document, sizes, word))
    label, starts, spoken = toxic[document], np.cumsum(sizes) - sizes, len(sizes)
    vocabulary = list(number)
    if len(set(label.tolist())) < 2:
        model = Model(Landmarks(["none"]), np.zeros(1), 0.0)
        return constant(model, float(np.average(toxic, weights=weight)) if len(toxic) else 0.0)
    landmarks = Landmarks(choose_landmarks(vocabulary, word, np.repeat(document, sizes), toxic))
    between = landmarks.kernel(landmarks.words)
    values, vectors = np.linalg.eigh((between + between.T) / 2)
    large = values > 1e-6
    root = vectors[:, large] / np.sqrt(values[large])
    features = np.ones((spoken, root.shape[1] + 1), np.float32)  # the last column is for the offset
    for at in range(0, spoken, BATCH_WORDS):
        part = word[starts[at]:starts[at + BATCH_WORDS] if at + BATCH_WORDS < spoken else len(word)]
        distinct, where = np.unique(part, return_inverse=True)
        near = landmarks.kernel([vocabulary[n] for n in distinct]).astype(np.float32)
        features[at:at + BATCH_WORDS, :-1] = np.add.reduceat(near[where], starts[at:at + BATCH_WORDS] - starts[at]) @ root
    del vocabulary, number, word
    used, v = np.ones(spoken, bool), None
    for _ in range(ROUNDS):
        v = support_vectors(features, label, used, v)
        found = products(features, v)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, document, found)
        used = (label == 0) | (found > 0) | (found == worst[document])
    del features
    model = Model(landmarks, root @ v[:-1], float(v[-1]))
    rows = np.concatenate([model.features(texts[at:at + BATCH_TEXTS]) for at in range(0, len(texts), BATCH_TEXTS)])
    model.mean, model.scale = rows.mean(0), rows.std(0) + 1e-9
    model.logit = logistic((rows - model.mean) / model.scale, toxic, weight)
    return model


def constant(model: Model, share: float) -> Model:
    share = min(max(share, 1e-6), 1 - 1e-6)
    model.mean, model.scale, model.logit = np.zeros(6), np.ones(6), np.append(np.zeros(6), np.log(share / (1 - share)))
    return model


def choose_landmarks(vocabulary: list[str], word: np.ndarray, document: np.ndarray, toxic: np.ndarray) -> list[str]:
    """The words that tell toxic documents best, and a hashed choice of the others; all have a subsequence."""
    of_word, of_document = np.divmod(np.unique(word.astype("i8") * len(toxic) + document), len(toxic))
    bad = np.bincount(of_word, toxic[of_document], len(vocabulary))
    seen = np.bincount(of_word, minlength=len(vocabulary)).astype(float)
    n_bad, n_all = toxic.sum(), len(toxic)
    expected = seen * n_bad / n_all

    def part(found: np.ndarray, due: np.ndarray) -> np.ndarray:
        return found * np.log(np.maximum(found, 1e-9) / np.maximum(due, 1e-9))

    ratio = part(bad, expected) + part(seen - bad, seen - expected) + part(n_bad - bad, n_bad - expected) + part(n_all - n_bad - seen + bad, n_all - n_bad - seen + expected)
    parts = [vocabulary[at:at + BATCH_WORDS] for at in range(0, len(vocabulary), BATCH_WORDS)]
    has_one = np.concatenate([np.bincount(subsequences(part)[0], minlength=len(part)) > 0 for part in parts])
    telling = sorted(np.flatnonzero(has_one & (bad > expected)), key=lambda n: (-ratio[n], vocabulary[n]))[:LANDMARKS // 2]
    others = sorted(np.flatnonzero(has_one), key=lambda n: (zlib.crc32(vocabulary[n].encode("utf-8", "replace")), vocabulary[n]))[:LANDMARKS // 2]
    return sorted({vocabulary[n] for n in [*telling, *others]}) or ["none"]


def products(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``x @ v`` in double precision, without a copy of all of ``x``."""
    return np.concatenate([np.empty(0), *[x[at:at + BATCH_SENTENCES] @ v for at in range(0, len(x), BATCH_SENTENCES)]])


def support_vectors(x: np.ndarray, label: np.ndarray, used: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Weights and offset of a linear machine on the ``used`` rows with squared hinge loss, both classes weighing the same, by Newton steps."""
    sign = np.where(label > 0, 1.0, -1.0)
    cost = PENALTY * used.sum() / 2 / np.where(label > 0, (used & (label > 0)).sum(), (used & (label == 0)).sum())
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    v = np.zeros(x.shape[1]) if start is None else start
    for _ in range(12):
        inside = np.flatnonzero(used & (sign * products(x, v) < 1))
        left, right = ridge.copy(), np.zeros(len(v))
        for at in range(0, len(inside), BATCH_SENTENCES):
            part = inside[at:at + BATCH_SENTENCES]
            held = x[part]
            weighted = held.T * cost[part].astype(x.dtype)
            left += weighted @ held
            right += weighted @ sign[part]
        following = np.linalg.solve(left, right)
        done = np.abs(following - v).max() <= 1e-3 * np.abs(following).max()
        v = following
        if done:
            break
    return v


def logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    weight = weight / weight.mean()
    penalty = 1e-3 * len(x)
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + penalty * np.eye(len(b)), x.T @ (weight * (label - p)) - penalty * b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return b


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS == 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS, total: int = FIT_TOTAL) -> Model:
    """Fit on at most ``rows`` labelled rows of each class, chosen by a hash of their id, that are not held out.

    A document with several labels is toxic if one says so. Rows without an id or a label, texts of more than ``chars``
    characters, and the texts of a class from where they have more than ``total`` characters together, do not take part in the fit.
    If that leaves no text of one class, there is a warning, and all documents get the same score.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = dict(usable.groupBy("toxic").count().collect())
    chosen = [usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most twice ``rows``
    texts = docs.select("doc_id", "text").where(F.length("text") <= chars).join(ids, "doc_id")
    # At most twice ``rows`` rows, so this window is small.
    upto = F.sum(F.length("text")).over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    sample = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("upto", upto).where(F.col("upto") <= total)
    sample = sample.drop("upto").orderBy("doc_id").toPandas()
    toxic = sample["toxic"].to_numpy()
    if len(set(toxic.tolist())) < 2 <= len(totals):
        warnings.warn("no text of one class is short enough to fit on; all documents get the same score", stacklevel=2)
    held = {c: max(1, int((toxic == c).sum())) for c in (0, 1)}
    return fit(sample["text"].tolist(), toxic, np.array([totals.get(c, 0) / held[c] for c in toxic]))


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    on_workers(spark)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(None if t is None else t for t in texts), dtype=float)

    return score(text)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``; the score sees nothing but the whole text.

    Null and empty texts get the score of a document without words. A null id is not held out.
    """
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(docs.sparkSession, fit_on(docs, labels), F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is below one half, all their columns as they are."""
    (name,) = free_names(docs, "toxicity")
    return docs.withColumn(name, score_column(docs.sparkSession, fit_on(docs, labels), docs["text"])).where(F.col(name) < 0.5).drop(name)
