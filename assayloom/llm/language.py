"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams of a language, most frequent
first. A document gets a profile of its own and the language whose profile it is
least out of place with: the distance sums, over the document's n-grams, how far
each one's rank is from its rank in the language's profile.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import fold, saved

#: Longest n-gram, n-grams of a profile, and what a profile's absent n-gram costs.
LONGEST, PROFILE = 3, 400
FOLDS, HELD = 4, 2
UNKNOWN = "und"
#: What marks the end of a word.
END = 1
#: Counts that a task holds before it passes them on.
GRAMS_KEPT = 2_000_000

def letters():
    """For each code point whether it is a letter."""
    import sys

    import numpy as np

    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def gram_codes(text: str | None, table):
    """All n-grams of one to LONGEST characters, each as one number; None without a letter.

    ``table`` comes from ``letters()``. Text is lower-cased; whatever is not a letter separates words. Longer n-grams
    may hold word ends, marked by code point 1. Only equal n-grams have equal numbers.
    """
    import numpy as np

    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = table[points]
    if not letter.any():
        return None
    padded = np.full(len(points) + 2, END, dtype=np.int64)
    padded[1:-1] = np.where(letter, points, END)
    ends = padded == END
    a = padded[~(ends & np.concatenate([[False], ends[:-1]]))]
    two = a[:-1] << 21 | a[1:]
    three = two[:-1] << 21 | a[2:]
    return np.concatenate([a[a > END], two, three[a[1:-1] > END]])


def profile(text: str | None, table):
    """Codes of a text's most frequent n-grams, ties by code; None without a letter."""
    import numpy as np

    found = gram_codes(text, table)
    if found is None:
        return None
    codes, counts = np.unique(found, return_counts=True)
    if len(codes) > PROFILE:  # all that are as frequent as the last one stay for the ties
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")[:PROFILE]]


def gram_counts(documents: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, code, n) over all rows with a language and a text. Tasks count before rows are moved."""

    def merged(parts):
        import numpy as np

        codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        held: dict[str, list] = {}
        table = letters()
        for batch in batches:
            for name, texts in batch.groupby("lang")["text"]:
                found = [c for c in (gram_codes(t, table) for t in texts) if c is not None]
                if found:
                    held.setdefault(name, []).append(np.unique(np.concatenate(found), return_counts=True))
                    if len(held[name]) >= 16:
                        held[name] = [merged(held[name])]
            if sum(len(c) for parts in held.values() for c, _ in parts) > GRAMS_KEPT:
                for name, parts in held.items():
                    codes, n = merged(parts)
                    yield pd.DataFrame({"lang": name, "code": codes, "n": n})
                held.clear()
        for name, parts in held.items():
            codes, n = merged(parts)
            yield pd.DataFrame({"lang": name, "code": codes, "n": n})

    known = documents.select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    return known.mapInPandas(counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def train(documents: DataFrame) -> dict[str, list[int]]:
    """Codes of each language's most frequent n-grams, from all documents outside the held-out fold.

    Documents without an id are used; those without a language or text are not.
    What reaches the driver is bounded by the number of languages.
    """
    learned = documents.filter(F.coalesce(fold("doc_id", FOLDS) != HELD, F.lit(True)))
    counts = saved(gram_counts(learned), "grams")
    names = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    # one ordered limit for each language: nothing is sorted in a single task
    return {
        name: [r["code"] for r in counts.filter(F.col("lang") == name).orderBy(F.desc("n"), "code").limit(PROFILE).collect()]
        for name in names
    }


class Judge:
    """Finds the language whose profile is least out of place."""

    def __init__(self, profiles: dict[str, list[int]]):
        import numpy as np

        self.names = sorted(profiles)
        self.table = letters()
        codes = sorted({c for p in profiles.values() for c in p})
        self.codes = np.array(codes, dtype=np.int64)
        place = {c: i for i, c in enumerate(codes)}
        self.ranks = np.full((len(self.names), len(codes) + 1), -1, dtype=np.int64)
        for row, name in enumerate(self.names):
            for rank, code in enumerate(profiles[name]):
                self.ranks[row, place[code]] = rank

    def judge(self, text: str | None) -> tuple[str, float]:
        """(language, score). The score is 1 less the distance's share of the largest there can be."""
        import numpy as np

        codes = profile(text, self.table)
        if codes is None or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == codes, at, len(self.codes))
        ranks = self.ranks[:, at]
        out = np.where(ranks >= 0, np.abs(ranks - np.arange(len(codes))), PROFILE)
        distance = out.sum(axis=1)
        best = int(distance.argmin())  # ties: the first name
        return self.names[best], float(1 - distance[best] / (PROFILE * len(codes)))


def predict(documents: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    A text that is null or has no letter is ``und`` with score 0, as is every
    text if no language was learned. A null doc_id has a null ``held_out``.
    Repeated rows are judged each; other columns are not read.
    """
    made: list[Judge] = []

    @F.pandas_udf("lang_pred string, score double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Judge(profiles))
        return pd.DataFrame([made[0].judge(t) for t in texts], columns=["lang_pred", "score"])

    return documents.select(
        "doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), judged("text").alias("judged"),
    ).select("doc_id", "held_out", "judged.lang_pred", "judged.score")
