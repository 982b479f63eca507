"""Spelling variants: blocked Gram matrices of letter counts, then exact edits.

Words of one profile (how many of their letters fall into each of a few classes)
are cut into blocks. Two words that differ by one code point have profiles whose
squared distance is at most two, so only blocks of equal or neighbouring profiles,
thus of equal or adjacent lengths, meet. For two blocks the product of their
letter-count matrices gives all squared distances |a|^2 + |b|^2 - 2ab at once; pairs
at most two apart are kept, and one edit is verified letter by letter. No pair of
words becomes a row: a pair of blocks returns each word's number of near words and
the best of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import saved

#: A run of letters, once A-Z are lower-cased.
RUN = "[a-zÀ-ÿ]"
#: Classes of letters (code point modulo this) that make a word's profile.
CLASSES = 5
#: Words of a block, and their letters together, at most on average.
BLOCK, LETTERS = 1024, 1 << 16
#: Different words that a task counts before it hands them on.
HELD = 200_000


def word_counts(documents: DataFrame, shortest: int = 7, damage: int | None = 31) -> DataFrame:
    """(word, n): how often each word of at least ``shortest`` letters occurs in whole texts.

    Words are the maximal runs of ``A-Za-z`` and U+00C0 to U+00FF, with A-Z in lower
    case. With ``damage``, a run loses one letter wherever that number divides the
    crc32 of ``doc_id:run``: repeatable misspellings. A null doc_id counts as an
    empty one, a null text has no words; rows that repeat count again.
    """
    runs = re.compile(f"{RUN}{{{shortest},}}")

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for batch in batches:
            for key, value in zip(batch.column("id").to_pylist(), batch.column("text")):
                text = value.as_py() or ""
                # lower() of bytes leaves other letters than A-Z alone
                found = runs.findall(text.encode().lower().decode())
                if damage is None:
                    held.update(found)
                    continue
                start = zlib.crc32(f"{key or ''}:".encode())
                for run, n in Counter(found).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % damage == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                    if len(run) >= shortest:
                        held[run] += n
                if len(held) > HELD:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    texts = documents.select(F.col("doc_id").cast("string").alias("id"), F.col("text"))
    return texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _letters(words, length):
    """Code points as a matrix, a row for each word of ``length``."""
    import numpy as np

    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), length)


def _profiled(words: DataFrame) -> DataFrame:
    """The words with ``profile``: how many letters each class has. It tells the length."""

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            names = batch.column("word").to_pylist()
            row = np.repeat(np.arange(len(names)), [len(w) for w in names])
            classes = np.frombuffer("".join(names).encode("utf-32-le"), dtype="<u4") % CLASSES
            counts = np.bincount(row * CLASSES + classes, minlength=len(names) * CLASSES).astype(np.int32)
            profiles = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * CLASSES), pa.array(counts))
            yield batch.append_column("profile", profiles)

    return words.mapInArrow(profiled, "word string, n long, profile array<int>")


def _counts(letters):
    """Letter-count matrix; exact as float32 while squares stay below 2**24."""
    import numpy as np

    rows, length = letters.shape
    column = np.where(letters < 0xC0, letters - 97, letters - 0xC0 + 26).astype(np.int64)
    flat = np.bincount((np.arange(rows)[:, None] * 90 + column).ravel(), minlength=rows * 90)
    return flat.reshape(rows, 90).astype(np.float32 if length < 2000 else np.float64)


def one_edit(left, right):
    """For each row of letters: is the right one the left one with one letter replaced, or one inserted?"""
    import numpy as np

    length = left.shape[1]
    if right.shape[1] == length:
        return (left != right).sum(axis=1) == 1
    before = np.logical_and.accumulate(left == right[:, :length], axis=1).sum(axis=1)
    after = np.logical_and.accumulate((left == right[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + after >= length


def near_pairs(left, right, same: bool):
    """Positions (i, j) of words one edit apart; words of a list have one length, right ones the same or one more.

    With ``same`` both lists are one, and each pair is found once.
    """
    import numpy as np

    a, b = _letters(left, len(left[0])), _letters(right, len(right[0]))
    x, y = _counts(a), _counts(b)
    sizes = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None]
    used = x.any(axis=0) & y.any(axis=0)
    i, j = np.nonzero(sizes - 2 * (x[:, used] @ y[:, used].T) <= 2)
    if same:
        i, j = i[i < j], j[i < j]
    step = max(1, (1 << 22) // a.shape[1])
    near = [one_edit(a[i[k:k + step]], b[j[k:k + step]]) for k in range(0, len(i), step)]
    near = np.concatenate(near) if near else np.zeros(0, dtype=bool)
    return i[near], j[near]


def _sides(words, _, at, other_words, other_counts, other, schema):
    """A batch (word, near, best, best_n) for one side of the pairs (at, other)."""
    import numpy as np

    counts = other_counts.to_numpy(zero_copy_only=False).astype(np.int64)
    names = other_words.to_pylist()
    rank = np.empty(len(names), dtype=np.int64)
    # Python compares texts by code points
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    order = np.lexsort((rank[other], -counts[other], at))
    at, other = at[order], other[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    best = other[first]
    return pa.RecordBatch.from_arrays([
        words.take(pa.array(at[first])), pa.array(np.diff(np.r_[first, len(at)])), other_words.take(pa.array(best)), pa.array(counts[best]),
    ], schema=schema)


def _compared(pairs: DataFrame) -> DataFrame:
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, left, right in zip(batch.column("same").to_pylist(), batch.column("left"), batch.column("right")):
                a, b = ([side.values.field(c) for c in ("word", "n")] for side in (left, right))
                i, j = near_pairs(a[0].to_pylist(), b[0].to_pylist(), same)
                if len(i):
                    yield _sides(*a, i, *b, j, schema)
                    yield _sides(*b, j, *a, i, schema)

    return pairs.mapInArrow(compared, "word string, near long, best string, best_n long")


def _block_pairs(words: DataFrame) -> DataFrame:
    """(same, left, right): blocks of (word, n) that may hold near words, each pair of blocks once."""
    length = F.aggregate("profile", F.lit(0), lambda s, x: s + x)
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(LETTERS) / length)))
    sizes = saved(words.groupBy("profile").count().select("profile", F.ceil(F.col("count") / room).cast("int").alias("blocks")), "profiles")
    dealt = words.join(sizes, "profile").withColumn("block", F.pmod(F.xxhash64("word"), "blocks").cast("int"))
    blocks = saved(dealt.groupBy("profile", "block").agg(F.collect_list(F.struct("word", "n")).alias("words")), "blocks")

    # one way of each neighbourhood: the same, a letter more, a letter of a later class for one of an earlier
    unit = [[int(i == j) for j in range(CLASSES)] for i in range(CLASSES)]
    steps = [[0] * CLASSES, *unit] + [[x - y for x, y in zip(unit[j], unit[i])] for i in range(CLASSES) for j in range(i + 1, CLASSES)]
    moved = F.zip_with("profile", "step", lambda x, y: x + y)
    step = F.explode(F.array(*(F.array(*map(F.lit, s)) for s in steps))).alias("step")
    met = sizes.select("profile", F.col("blocks").alias("here"), step).select(F.col("profile").alias("p"), "here", moved.alias("q")).join(
        sizes.select(F.col("profile").alias("q"), F.col("blocks").alias("there")), "q"
    )
    numbered = met.select("p", "q", "there", F.explode(F.sequence(F.lit(0), F.col("here") - 1)).alias("i"))
    numbered = numbered.select("p", "q", "i", F.explode(F.sequence(F.when(F.col("p") == F.col("q"), F.col("i")).otherwise(0), F.col("there") - 1)).alias("j"))
    left = blocks.select(F.col("profile").alias("p"), F.col("block").alias("i"), F.col("words").alias("left"))
    right = blocks.select(F.col("profile").alias("q"), F.col("block").alias("j"), F.col("words").alias("right"))
    same = (F.col("p") == F.col("q")) & (F.col("i") == F.col("j"))
    return numbered.join(left, ["p", "i"]).join(right, ["q", "j"]).select(same.alias("same"), "left", "right")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word on the way from form to form, by pointer doubling."""
    ends = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = saved(ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ends = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return ends


def group(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of (word, n), words given once.

    Two words are near if one letter more, less or other makes one the other. ``form``
    is the most frequent near word (of equal ones the first by code points) if it is
    at least ``ratio`` times (more than once) as frequent, else null; ``root`` is where
    the way from form to form ends. Words hold letters of ``RUN`` only.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its variants: ratio is 2 or more")
    words = saved(_profiled(words), "words")
    partial = _compared(_block_pairs(words))
    # negated, so the least is the most frequent, then the first by code points
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    near = partial.groupBy("word").agg(F.sum("near").alias("n_near"), best)
    frequent = -F.col("best.n") >= ratio * F.col("n")
    found = saved(words.select("word", "n").join(near, "word", "left").select(
        "word", F.when(frequent, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(frequent, -F.col("best.n")).alias("form_n"),
    ), "forms")
    roots = _roots(found.filter("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(documents: DataFrame, shortest: int = 7, least: int = 2, damage: int | None = 31, ratio: int = 10) -> DataFrame:
    """``group`` over the words of whole texts that occur at least ``least`` times."""
    return group(word_counts(documents, shortest, damage).filter(F.col("n") >= least), ratio)
