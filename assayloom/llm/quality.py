"""Quality classifier: which of two dictionaries compresses a text better.

One zstandard dictionary is built from good, one from bad labelled texts. A text
is cut into chunks of a fixed number of bytes, so that a long text is seen whole
through the dictionaries, each chunk is compressed with either, and the summed
sizes give ``(bad - good) / (bad + good)``. A logistic curve, fitted on labelled
texts that are in neither dictionary, turns that into a probability.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import fold, fresh, labelled_sample, newton

#: Bytes of a chunk, bytes of a dictionary and compression level.
CHUNK, DICTIONARY, LEVEL = 512, 112 * 1024, 3
#: Labelled documents of each class that are used at most, and characters of the longest of them.
PER_CLASS, LONGEST = 3000, 20_000
FOLDS, THRESHOLD = 5, 0.3


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the curve from size difference to probability."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float


def _chunks(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)]


def _dictionary(texts: list[str]) -> bytes:
    import zstandard

    pieces = [c for t in texts for c in _chunks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on: they are the dictionary
        return b"".join(pieces)[-DICTIONARY:]


def _compressor(dictionary: bytes):
    import zstandard

    kept = zstandard.ZstdCompressionDict(dictionary)
    kept.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False)


class Scorer:
    """Scores texts one by one; holds the prepared dictionaries."""

    def __init__(self, model: Model):
        self.model = model
        self.good, self.bad = (_compressor(d) if d else None for d in (model.good, model.bad))

    def difference(self, text: str | None) -> float:
        """In -1 to 1, higher if the good dictionary compresses better; 0 for an empty text."""
        if self.good is None or self.bad is None:
            return 0.0
        good = bad = 0
        for chunk in _chunks(text):
            good += len(self.good.compress(chunk))
            bad += len(self.bad.compress(chunk))
        return (bad - good) / (bad + good) if good else 0.0

    def score(self, text: str | None) -> float:
        z = self.model.slope * self.difference(text) + self.model.intercept
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(good: list[str], bad: list[str], good_rows: int, bad_rows: int) -> Model:
    """Every second text goes into the dictionaries, the others calibrate.

    ``good_rows`` and ``bad_rows`` weight the calibration by how common each
    class is. Without texts of a class the score is the smoothed share of good
    rows for every text.
    """
    import numpy as np

    share = (good_rows + 1) / (good_rows + bad_rows + 2)
    prior = Model(b"", b"", 0.0, math.log(share / (1 - share)))
    if len(good) < 2 or len(bad) < 2:
        return prior
    scorer = Scorer(Model(_dictionary(good[::2]), _dictionary(bad[::2]), 1.0, 0.0))
    if scorer.good is None or scorer.bad is None:
        return prior
    held = good[1::2] + bad[1::2]
    x = np.array([scorer.difference(t) for t in held])
    y = np.repeat([1.0, 0.0], [len(good[1::2]), len(bad[1::2])])
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * len(y)
    slope, intercept = newton(x, y, weight)
    return Model(scorer.model.good, scorer.model.bad, slope, intercept)


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST) -> Model:
    """Fit on a bounded sample of labelled documents outside fold 0."""
    rows = labelled_sample(documents, labels, "quality", per_class, longest, FOLDS).collect()
    texts = {k: [r["text"] for r in rows if r["label"] == k] for k in (0, 1)}
    total = {k: next((r["rows"] for r in rows if r["label"] == k), 0) for k in (0, 1)}
    return fit(texts[1], texts[0], total[1], total[0])


def probability(model: Model, text: Column) -> Column:
    """Probability that a text is good; null and empty texts score as a text of no evidence."""
    shared = text_model(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        scorer = shared()
        return pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return scored(text)


def text_model(model: Model):
    """A function that prepares the scorer once per worker."""
    made = []

    def get() -> Scorer:
        if not made:
            made.append(Scorer(model))
        return made[0]

    return get


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Nulls: a null text scores like an empty one; a null doc_id has a null
    ``held_out``. Repeated rows are scored each. Other columns are not read.
    """
    return (
        documents.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), probability(model, F.col("text")).alias("score"))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )


def keep_good(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with their own columns.

    Null and empty texts have the score of no evidence; whole texts of any length are
    scored; repeated rows are judged each.
    """
    (name,) = fresh(documents, "good_score")
    return documents.withColumn(name, probability(model, F.col("text"))).filter(F.col(name) >= threshold).drop(name)
