"""Toxicity: bags of subword vectors, averaged, into a linear softmax.

A word is the mean of the vectors of its character n-grams (with word ends
marked), so a misspelt or inflected word that was never seen shares vectors with
those that were. A window of neighbouring words is the mean of its words, and a
softmax of two classes sits on top. Vectors and softmax are trained together.
The label of a document is that of its worst window: each round of training
pushes the window that now scores highest, and a document's score is the highest
of its windows. So one insult in a long text isn't averaged away.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import fold, fresh, labelled_sample, newton

#: Hash buckets of n-grams, length of a vector, shortest and longest n-gram, words of a window.
BUCKETS, WIDTH, SHORTEST, LONGEST_GRAM, WINDOW = 1 << 17, 16, 3, 5, 2
#: Labelled documents of each class that are used at most, and characters of the longest of them.
PER_CLASS, LONGEST = 2000, 6_000
ROUNDS, RATE, EVERY, FEW, INIT, SEED = 20, 0.1, 4.0, 3.0, 0.01, 7
FOLDS, THRESHOLD = 5, 0.5
#: Words that a worker remembers, and characters of the longest of those; longer ones are cut into parts.
REMEMBERED, PART = 300_000, 40

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Vectors as 32-bit floats of BUCKETS x WIDTH, softmax weights, and bias of class 1 over class 0."""

    vectors: bytes
    weights: tuple[float, ...]
    bias: float


def words(text: str | None) -> list[str]:
    """Runs of letters in lower case; runs longer than PART as parts of that length."""
    found = _WORD.findall((text or "").lower())
    if any(len(w) > PART for w in found):
        found = [w[i:i + PART] for w in found for i in range(0, len(w), PART)]
    return found


def grams(word: str) -> list[int]:
    """Buckets of the n-grams of a word and of the whole word."""
    marked = f"<{word}>"
    found = [marked[i:i + n] for n in range(SHORTEST, LONGEST_GRAM + 1) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in {*found, marked}]


class _Sample:
    """Words of a sample of texts as numbers, with the buckets of each distinct word."""

    def __init__(self, texts: list[str]):
        import numpy as np

        index: dict[str, int] = {}
        flat, sizes, tokens, lengths, kept = array("i"), array("i"), array("i"), [], []
        for i, text in enumerate(texts):
            found = words(text)
            for w in found:
                if w not in index:
                    index[w] = len(index)
                    buckets = grams(w)
                    sizes.append(len(buckets))
                    flat.extend(buckets)
            if found:
                tokens.extend(map(index.__getitem__, found))
                lengths.append(len(found))
                kept.append(i)
        self.kept = np.array(kept, dtype=np.int64)
        self.flat, self.sizes, self.tokens = (np.array(a, dtype=np.int32) for a in (flat, sizes, tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.lengths = np.array(lengths, dtype=np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        # a window starts at every word; at the end of a text it is shorter
        left = np.repeat(self.begin + self.lengths, self.lengths) - np.arange(len(self.tokens))
        self.reach = np.minimum(left, WINDOW).astype(np.int8)

    def windows(self, values):
        """Mean of the values of the words of each window."""
        import numpy as np

        total = values.copy()
        for k in range(1, WINDOW):
            at = np.flatnonzero(self.reach > k)
            total[at] += values[at + k]
        return total / self.reach

    def words_of(self, windows):
        """What each word gets if each window deals its value out evenly: the transpose of ``windows``."""
        import numpy as np

        each = windows / self.reach
        total = each.copy()
        for k in range(1, WINDOW):
            at = np.flatnonzero(self.reach > k)
            total[at + k] += each[at]
        return total

    def documents(self, place, buckets: int, y):
        """For each class in how many texts each bucket occurs; ``place`` numbers the buckets of ``flat``."""
        import numpy as np

        held = np.zeros((2, buckets), dtype=np.int64)
        for start, stop, label in zip(self.begin, np.append(self.begin[1:], len(self.tokens)), y):
            words_here = np.unique(self.tokens[start:stop])
            spans = [place[self.starts[w]:self.starts[w] + self.sizes[w]] for w in words_here]
            held[label, np.unique(np.concatenate(spans))] += 1
        return held


def _highest(values, begin):
    """Position of the first highest value of each run that starts at ``begin``."""
    import numpy as np

    top = np.maximum.reduceat(values, begin)
    runs = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(values))))
    at = np.flatnonzero(values == top[runs])
    return at[np.unique(runs[at], return_index=True)[1]]


def fit(texts: list[str], labels: list[int], rows: tuple[int, int] | None = None) -> Model:
    """Train on all texts, and calibrate on what models of either half say of the other half.

    ``rows`` tells how common the labels 0 and 1 are; without it they are as common as here.
    A model that can't tell unseen texts apart so calls all of them the more common label.
    """
    import numpy as np

    whole = _fit(texts, labels)
    halves = [list(range(i, len(texts), 2)) for i in (0, 1)]
    if min((labels[i] for i in halves[0]), default=0) == max((labels[i] for i in halves[0]), default=0):
        return whole
    z, y = [], []
    for mine, other in (halves, halves[::-1]):
        model = _fit([texts[i] for i in mine], [labels[i] for i in mine])
        scorer = Scorer(evidence(model), model.bias)
        z += [scorer.logit(texts[i]) for i in other]
        y += [labels[i] for i in other]
    z, y = np.array(z), np.array(y, dtype=float)
    if y.min() == y.max():
        return whole
    rows = rows or (int((y == 0).sum()), int(y.sum()))
    share = (rows[1] + 1) / (sum(rows) + 2)
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * len(y)
    slope, intercept = newton(z, y, weight)
    slope = max(slope, 0.0)
    return Model(whole.vectors, tuple(w * slope for w in whole.weights), whole.bias * slope + intercept)


def _fit(texts: list[str], labels: list[int]) -> Model:
    """Train vectors and softmax together by full-batch Adagrad on the highest windows.

    Without texts of either class every text scores 0 or 1, whichever was seen, or 0 if none was.
    """
    import numpy as np

    rng = np.random.default_rng(SEED)
    vectors = rng.normal(0, INIT, (BUCKETS, WIDTH)).astype(np.float32)
    weights = np.stack([-np.ones(WIDTH), np.ones(WIDTH)]).astype(np.float32) * 0.3
    bias = np.array([1.0, -1.0], dtype=np.float32)
    if len(set(labels)) < 2:
        certain = 20.0 if 1 in labels else -20.0
        return Model(np.zeros_like(vectors).tobytes(), (0.0,) * WIDTH, certain)
    s = _Sample(texts)
    y = np.array(labels)[s.kept]
    if len(set(y.tolist())) < 2:
        return Model(np.zeros_like(vectors).tobytes(), (0.0,) * WIDTH, -20.0)
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()).astype(np.float32)
    # every window of a clean text is clean; of a toxic one only the worst is known to be toxic
    clean = np.flatnonzero(np.repeat(y == 0, s.lengths))
    part = np.repeat((share / s.lengths).astype(np.float32), s.lengths)[clean]
    used, place = np.unique(s.flat, return_inverse=True)
    place = place.astype(np.int32)
    # vectors start along the softmax by how much more often toxic texts hold the n-gram
    held = s.documents(place, len(used), y)
    odds = [np.log((h + 1) / (n + 2)) for h, n in zip(held, ((y == 0).sum(), (y == 1).sum()))]
    never = np.log(1 / ((y == 1).sum() + 2)) - np.log(1 / ((y == 0).sum() + 2))
    direction = weights[1] - weights[0]
    vectors[used] += ((odds[1] - odds[0] - never)[:, None] * direction[None, :] / (direction @ direction)).astype(np.float32)
    # steps stay small until a few texts agree
    unit = FEW * 0.5 / (y == 1).sum() / WINDOW / s.sizes.mean()
    memory = [np.full((len(used), WIDTH), unit ** 2, dtype=np.float32), np.full_like(weights, 1e-8), np.full_like(bias, 1e-8)]
    for _ in range(ROUNDS):
        direction = weights[1] - weights[0]
        per_word = np.add.reduceat((vectors[used] @ direction)[place], s.starts) / s.sizes
        windows = s.windows(per_word.astype(np.float32)[s.tokens])
        top = _highest(windows, s.begin)
        p = 1 / (1 + np.exp(-np.clip(windows[top] + bias[1] - bias[0], -30, 30)))
        error = np.zeros(len(windows), dtype=np.float32)
        error[top] = share * (p - y)
        error[clean] += EVERY * part / (1 + np.exp(-np.clip(windows[clean] + bias[1] - bias[0], -30, 30)))
        # gradient by the logit of class 1 over class 0, from the windows to words, n-grams and vectors
        by_word = np.bincount(s.tokens, s.words_of(error), len(s.sizes)) / s.sizes
        by_gram = np.bincount(place, np.repeat(by_word, s.sizes), len(used)).astype(np.float32)
        slopes = [by_gram[:, None] * direction[None, :], np.zeros_like(weights), np.array([-error.sum(), error.sum()], dtype=np.float32)]
        slopes[1][1] = by_gram @ vectors[used]
        slopes[1][0] = -slopes[1][1]
        for m, g in zip(memory, slopes):
            m += g * g
        vectors[used] -= RATE * slopes[0] / np.sqrt(memory[0])
        weights -= RATE * slopes[1] / np.sqrt(memory[1])
        bias -= RATE * slopes[2] / np.sqrt(memory[2])
    return Model(vectors.tobytes(), tuple(map(float, weights[1] - weights[0])), float(bias[1] - bias[0]))


def evidence(model: Model) -> bytes:
    """What each vector adds to the logit: the softmax of a mean of vectors is that of the mean of these."""
    import numpy as np

    vectors = np.frombuffer(model.vectors, dtype=np.float32).reshape(-1, WIDTH)
    return (vectors @ np.array(model.weights, dtype=np.float32)).tobytes()


class Scorer:
    """Scores texts; remembers the evidence of the words it has met."""

    def __init__(self, evidence: bytes, bias: float):
        import numpy as np

        self.evidence = np.frombuffer(evidence, dtype=np.float32)
        self.bias = bias
        self.known: dict[str, float] = {}

    def _word(self, word: str) -> float:
        found = float(self.evidence[grams(word)].mean())
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = found
        return found

    def score(self, text: str | None) -> float:
        """Of the worst window; a text without words has no evidence but the bias."""
        import math

        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.logit(text)))))

    def logit(self, text: str | None) -> float:
        """What ``score`` is the logistic function of."""
        import numpy as np

        known, add = self.known, self._word
        each = []
        for w in words(text):
            value = known.get(w)
            each.append(add(w) if value is None else value)
        if not each:
            worst = 0.0
        elif len(each) <= WINDOW:  # the windows at the end of a text are shorter
            worst = max(sum(each[i:]) / (len(each) - i) for i in range(len(each)))
        else:
            running = np.concatenate([[0.0], np.cumsum(each)])
            worst = float((running[WINDOW:] - running[:-WINDOW]).max()) / WINDOW
            worst = max([worst, *(sum(each[-n:]) / n for n in range(1, WINDOW))])
        return worst + self.bias


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST) -> Model:
    """Fit on a bounded sample of labelled documents outside fold 0."""
    rows = labelled_sample(documents, labels, "toxic", per_class, longest, FOLDS).collect()
    total = [next((r["rows"] for r in rows if r["label"] == k), 0) for k in (0, 1)]
    return fit([r["text"] for r in rows], [r["label"] for r in rows], (total[0], total[1]))


def probability(documents: DataFrame, model: Model, text: Column) -> Column:
    """Probability that a text is toxic; null and empty texts score by the bias alone."""
    # of fixed size: BUCKETS numbers
    shared = documents.sparkSession.sparkContext.broadcast((evidence(model), model.bias))
    made: list[Scorer] = []

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Scorer(*shared.value))
        return pd.Series([made[0].score(t) for t in texts], dtype="float64")

    return scored(text)


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Nulls: a null text scores like an empty one; a null doc_id has a null
    ``held_out``. Repeated rows are scored each. Other columns are not read.
    """
    return (
        documents.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), probability(documents, model, F.col("text")).alias("score"))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )


def keep_clean(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below the threshold, with their own columns.

    Null and empty texts have the score of no evidence; whole texts of any length are
    scored; repeated rows are judged each.
    """
    (name,) = fresh(documents, "toxic_score")
    return documents.withColumn(name, probability(documents, model, F.col("text"))).filter(F.col(name) < threshold).drop(name)
