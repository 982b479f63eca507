"""Phrase collocations by the relational method of SETM.

The occurrences of phrases of one length are a relation (piece, position, phrase),
kept sorted and written out after each length, in blocks of whole pieces. A length is
extended by merge-joining it with itself by piece and adjacent position: two phrases
of k words that overlap in all but one word are one of k + 1. The results are grouped
and counted over the corpus, and the occurrences are semi-joined with the frequent
groups before the next length, for a phrase can't be more frequent than its parts.

Within a block a phrase has a small number, and counts leave it once per block and
phrase; so a word that a third of all texts hold is one row per block. As long as the
frequent groups of a length are few, by a check of their size, tasks know them all
and no occurrence is moved; beyond that they are joined with the groups of a block. A pair of exact ids stands for a longer phrase:
nothing rests on hashes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.common import saved

#: Characters that end a piece; blanks and tabs part words.
ENDS = ".,;:!?\n\x0b\x0c\r"
#: Words and ends of a block, at most but for one document.
BLOCK = 1 << 18
#: Frequent phrases of a length that all tasks may know, in number and in bytes together.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 1 << 25

#: Blocks of a file, for a file of lists is read as one batch; and its compression.
FILE = {"maxRecordsPerFile": 16, "compression": "zstd"}
#: Groups that a task counts at once, and that are counted together on average.
HELD, PART = 1 << 21, 1 << 21
#: Below so many ids two of them make one 64-bit number.
PACKED = 1 << 31
#: Characters of a text that are cut at once.
SLICE = 1 << 20


class Phrases(NamedTuple):
    """``totals`` (lang, n) counts all words; ``lengths[k - 1]`` holds the frequent phrases of k words:
    (id, lang, phrase, last, f, left, right, firsts, rests), where ``firsts[i]`` counts the first i + 1
    words, ``rests[i]`` what follows them, and left and right are the ids of all words but the last and
    all but the first."""

    totals: DataFrame
    lengths: list[DataFrame]


def _packed(values) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs; the first byte tells how many."""
    import numpy as np

    kind = np.min_scalar_type(values.max(initial=0))
    return bytes([kind.itemsize]) + values.astype(kind.newbyteorder("<")).tobytes()


def _unpacked(data: bytes):
    import numpy as np

    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


class _Open:
    """The block of one language that is being filled: numbers of words, in the order of the texts."""

    def __init__(self):
        self.numbers = defaultdict(count().__next__)
        for end in ENDS.encode():
            self.numbers[bytes([end])]
        self.parts, self.size = [], 0

    def add(self, tokens):
        import numpy as np

        self.parts.append(np.fromiter(map(self.numbers.__getitem__, tokens), dtype=np.int32, count=len(tokens)))
        self.size += len(tokens)

    def row(self, block: int, lang: str):
        """The sorted relation: a gap of one leads to the next word of the same piece, a larger one to another piece."""
        import numpy as np

        stream = np.concatenate(self.parts)
        positions = np.flatnonzero(stream >= len(ENDS))
        codes = stream[positions] - len(ENDS)
        words = [w.decode() for w in list(self.numbers)[len(ENDS):]]
        counts = np.bincount(codes, minlength=len(words))
        gaps = np.diff(positions, prepend=0)
        return {"block": block, "lang": lang, "gaps": _packed(gaps), "codes": _packed(codes), "words": words, "counts": counts}


_WORDS = pa.schema([
    ("block", pa.int64()), ("lang", pa.string()), ("gaps", pa.binary()), ("codes", pa.binary()), ("words", pa.list_(pa.string())),
    ("counts", pa.list_(pa.int32())),
])
_PAIRS = pa.schema([
    ("block", pa.int64()), ("lang", pa.string()), ("gaps", pa.binary()), ("codes", pa.binary()), ("lefts", pa.list_(pa.int64())),
    ("rights", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
])


def _batch(row: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)


def occurrences(documents: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(block, lang, gaps, codes, words, counts): all words of whole texts, in blocks of one language.

    ``codes`` are numbers into ``words``, in the order of the texts; ``gaps`` part their
    positions; both are packed numbers, for only tasks look into them. A null language is ``und``; null and wordless texts add nothing.
    """
    token = re.compile(b"[^\\x20\\x09.,;:!?\\x0A-\\x0D]+|[.,;:!?\\x0A-\\x0D]")
    between = re.compile(b"[\\x20\\x09.,;:!?\\x0A-\\x0D]")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filling, block = defaultdict(_Open), TaskContext.get().partitionId() << 33
        held = 0
        for batch in batches:
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("text")):
                # lower() of bytes leaves other letters than A-Z alone
                value, at = (value.as_py() or b"").lower(), 0
                while at < len(value):
                    seam = between.search(value, at + SLICE)
                    end = seam.start() if seam else len(value)
                    tokens = token.findall(value, at, end)
                    filling[name].add(tokens)
                    held += len(tokens)
                    at = end
                if value:
                    filling[name].add([b"\n"])
                while held > BLOCK:
                    largest = max(filling, key=lambda k: filling[k].size)
                    done = filling.pop(largest)
                    held -= done.size
                    yield _batch(done.row(block, largest), _WORDS)
                    block += 1
        for name, rest in filling.items():
            yield _batch(rest.row(block, name), _WORDS)
            block += 1

    texts = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(cut, "block long, lang string, gaps binary, codes binary, words array<string>, counts array<int>")


def _merged(batches: Iterator[pa.RecordBatch], numbers_of, last: bool) -> Iterator[pa.RecordBatch]:
    """The relations of phrases a word longer: frequent occurrences merge-joined with those at the next position.

    ``numbers_of`` gives which numbers of a row's block are frequent, with their ids.
    """
    import numpy as np

    for batch in batches:
        for row in range(batch.num_rows):
            gaps, codes = (_unpacked(batch.column(c)[row].as_py()) for c in ("gaps", "codes"))
            numbers, ids = numbers_of(batch, row)
            if not len(numbers):
                continue
            small = np.full(codes.max() + 1, -1, dtype=np.int64)
            small[numbers] = np.arange(len(numbers))
            phrase = small[codes]
            stays = phrase >= 0
            positions, phrase = np.cumsum(gaps)[stays], phrase[stays]
            at = np.flatnonzero(np.diff(positions) == 1)
            if not len(at):
                continue
            pairs, number, counts = np.unique(phrase[at] * len(ids) + phrase[at + 1], return_inverse=True, return_counts=True)
            made = {"block": batch.column("block")[row].as_py(), "lang": batch.column("lang")[row].as_py(), "counts": counts}
            made["gaps"], made["codes"] = (b"", b"") if last else (_packed(np.diff(positions[at], prepend=0)), _packed(number.ravel()))
            made["lefts"], made["rights"] = ids[pairs // len(ids)], ids[pairs % len(ids)]
            yield _batch(made, _PAIRS)


_LONGER = "block long, lang string, gaps binary, codes binary, lefts array<long>, rights array<long>, counts array<int>"


def _known(state: DataFrame, found: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """``_merged`` where each task knows all frequent groups: no occurrence is moved."""
    import numpy as np

    table = found.select("id", *keys).toArrow()
    ids = table["id"].to_numpy()
    if "word" in keys:
        langs = table["lang"].to_numpy(zero_copy_only=False)
        words = table["word"].combine_chunks()
        held = {lang: (words.take(pa.array(at)), ids[at]) for lang in set(langs) for at in [np.flatnonzero(langs == lang)]}
    else:
        pair = table["left"].to_numpy() << 32 | table["right"].to_numpy()
        order = np.argsort(pair)
        held = pair[order], ids[order]
    sent = state.sparkSession.sparkContext.broadcast(held)

    def word_numbers(batch, row):
        import pyarrow.compute as pc

        known = sent.value.get(batch.column("lang")[row].as_py())
        if known is None:
            return (), ()
        place = pc.index_in(batch.column("words")[row].values, value_set=known[0])
        numbers = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
        return numbers, known[1][place.drop_null().to_numpy()]

    def pair_numbers(batch, row):
        pairs, ids = sent.value
        left, right = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("lefts", "rights"))
        pair = left << 32 | right
        place = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        numbers = np.flatnonzero(pairs[place] == pair) if len(pairs) else np.zeros(0, dtype=np.int64)
        return numbers, ids[place[numbers]]

    numbers_of = word_numbers if "word" in keys else pair_numbers
    names = ["words"] if "word" in keys else ["lefts", "rights"]
    return state.select("block", "lang", "gaps", "codes", *names).mapInArrow(lambda batches: _merged(batches, numbers_of, last), _LONGER)


def _joined(state: DataFrame, rows: DataFrame, found: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """``_merged`` with the frequent groups of each block joined to it, however many there are."""

    def numbers_of(batch, row):
        return (batch.column("numbers")[row].values.field(c).to_numpy(zero_copy_only=False) for c in ("number", "id"))

    held = rows.join(found.select("id", *keys), keys).groupBy("block").agg(F.collect_list(F.struct("number", "id")).alias("numbers"))
    wide = state.select("block", "lang", "gaps", "codes").join(held, "block")
    return wide.mapInArrow(lambda batches: _merged(batches, numbers_of, last), _LONGER)


def _tally(keys, counts):
    """The distinct keys, sorted, and the sums of their counts."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _counted(state: DataFrame, minimum: int) -> DataFrame:
    """(left, right, f) of the groups that occur often enough, where ids fit 31 bits.

    A task adds up its blocks, deals the sums out by a hash of the group, and hands each
    part on as one sorted and compressed list; parts are as many as keeps them small.
    """
    parts = 1 + (state.agg(F.coalesce(F.sum(F.size("counts").cast("long")), F.lit(0))).first()[0] // PART)
    schema = pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("n", pa.int64())])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def rows(held):
            keys, counts = _tally(*(np.concatenate(x) for x in zip(*held)))
            part = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64)) if parts <= len(keys) else np.r_[np.unique(part[order], return_index=True)[1], len(keys)]
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if s < e:
                    at = order[s:e]
                    gaps, n = np.diff(keys[at], prepend=0).astype("<i8"), counts[at].astype("<i8")
                    yield int(part[at[0]]), pa.compress(gaps.tobytes(), "zstd", asbytes=True), pa.compress(n.tobytes(), "zstd", asbytes=True), e - s

        held, size = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                left, right, n = (batch.column(c)[row].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lefts", "rights", "counts"))
                held.append((left << 32 | right, n))
                size += len(n)
                if size > 2 * HELD:
                    held = [_tally(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][0])
                    if size > HELD:
                        out = list(rows(held))
                        held, size = [], 0
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows(held)), schema.types)], schema=schema)

    def summed(table: pa.Table) -> pa.Table:
        import numpy as np

        keys, counts = [], []
        for k, c, n in zip(table["keys"], table["counts"], table["n"].to_pylist()):
            keys.append(np.cumsum(np.frombuffer(pa.decompress(k.as_py(), 8 * n, "zstd", asbytes=True), dtype="<i8")))
            counts.append(np.frombuffer(pa.decompress(c.as_py(), 8 * n, "zstd", asbytes=True), dtype="<i8"))
        keys, counts = _tally(np.concatenate(keys), np.concatenate(counts))
        keys, counts = keys[counts >= minimum], counts[counts >= minimum]
        return pa.table({"left": keys >> 32, "right": keys & 0xFFFFFFFF, "f": counts})

    sums = state.select("lefts", "rights", "counts").mapInArrow(dealt, "part long, keys binary, counts binary, n long")
    return sums.groupBy("part").applyInArrow(summed, "left long, right long, f long")


def _numbered(groups: DataFrame) -> tuple[DataFrame, int]:
    """The rows with ``id``: 0, 1, 2, ... without a gap, by the sizes of the written parts; and their number."""
    spark = groups.sparkSession
    marked = saved(groups.withColumn("mark", F.monotonically_increasing_id()), "frequent")
    part = F.shiftright("mark", 33)
    starts, total = [], 0
    # a row per part of the table
    for r in marked.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((r["part"], total))
        total += r["count"]
    offsets = spark.createDataFrame(starts, "part long, start long")
    return marked.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn(
        "id", F.col("start") + F.col("mark").bitwiseAND((1 << 33) - 1)
    ).drop("part", "mark", "start"), total


def _rows(state: DataFrame, keys: list[str]) -> DataFrame:
    """A row per block and phrase: (block, lang, number, key columns, n)."""
    zipped = F.arrays_zip(*(F.col(f"{k}s").alias(k) for k in keys if k != "lang"), F.col("counts").alias("n"))
    return state.select("block", "lang", F.posexplode(zipped).alias("number", "key")).select("block", "lang", "number", "key.*")


def _extended(state: DataFrame, found: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """The relation of phrases a word longer, and who may appear in it is told by ``found``.

    Frequent groups whose size is checked to be small are told to all tasks; more of
    them are joined with the groups of each block.
    """
    size = F.octet_length("word") if "word" in keys else F.lit(16)
    rows, total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES:
        return _known(state, found, keys, last)
    return _joined(state, _rows(state, keys), found, keys, last)


def frequent_phrases(documents: DataFrame, lang: str = "lang", text: str = "text", longest: int = 5, minimum: int = 100) -> Phrases:
    """Phrases of 1 to ``longest`` words that occur at least ``minimum`` times in a language, and all words' number.

    Occurrences lie within a piece and may overlap. Everything is counted over whole
    texts and all rows, repeated ones as well; an empty table has no phrases.
    """
    state = saved(occurrences(documents, lang, text), "occurrences", **FILE)
    totals = saved(state.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")).filter("n > 0"), "totals")

    def summed(keys):
        return _rows(state, keys).groupBy(*keys).agg(F.sum(F.col("n").cast("long")).alias("f")).filter(F.col("f") >= minimum)

    keys = ["lang", "word"]
    found, ids = _numbered(summed(keys))
    none = F.array().cast("array<long>")
    lengths = [found.select(
        "id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.lit(None).cast("long").alias("left"),
        F.lit(None).cast("long").alias("right"), none.alias("firsts"), none.alias("rests"),
    )]
    for k in range(2, longest + 1):
        state = saved(_extended(state, found, keys, k == longest), "occurrences", **FILE)
        keys = ["left", "right"]
        found, ids = _numbered(_counted(state, minimum) if ids < PACKED else summed(keys))
        left = lengths[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.concat("firsts", F.array("f")).alias("firsts"))
        right = lengths[-1].select(F.col("id").alias("right"), "last", F.concat(F.array("f"), "rests").alias("rests"))
        named = found.join(left, "left").join(right, "right")
        lengths.append(saved(named.select(
            "id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f", "left", "right", "firsts", "rests"
        ), "phrases"))
    return Phrases(totals, lengths)


def _scored(phrases: DataFrame, totals: DataFrame, words: int) -> DataFrame:
    """With the cut that scores lowest: (l, r, n, score). Whole numbers of up to 38 digits."""
    cut = [
        F.struct(F.expr(
            f"cast(1000 as decimal(4, 0)) * (cast(f as decimal(18, 0)) * cast(n as decimal(18, 0)))"
            f" div (cast(firsts[{k - 1}] as decimal(18, 0)) * cast(rests[{k - 1}] as decimal(18, 0)))"
        ).alias("score"), F.lit(k).alias("k"), F.expr(f"firsts[{k - 1}]").alias("l"), F.expr(f"rests[{k - 1}]").alias("r"))
        for k in range(1, words)
    ]
    low = F.array_min(F.array(*cut))
    return phrases.join(totals, "lang").select("id", "lang", "phrase", F.col("f").alias("a"), "n", low.alias("low")).select(
        "id", "lang", "phrase", "a", "low.l", "low.r", "n", "low.score"
    )


def collocations(found: Phrases, cover: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two words or more of each language.

    A phrase of frequency ``a`` is cut into two parts of frequencies ``l`` and ``r`` where
    1000 * a * n / (l * r), rounded down, is least, at the first such place. It is left
    out if a longer phrase that holds it has ``cover`` percent of its occurrences or more.
    No phrase is more frequent than a part of it, so phrases one word longer decide that.
    Ranks go by score, then frequency, then the bytes of the phrase.
    """
    parts = []
    for i, phrases in enumerate(found.lengths[1:], 1):
        scored = _scored(phrases, found.totals, i + 1)
        if i + 1 < len(found.lengths):
            longer = found.lengths[i + 1]
            covers = longer.select(F.col("left").alias("id"), "f").unionByName(longer.select(F.col("right").alias("id"), "f"))
            most = covers.groupBy("id").agg(F.max("f").alias("most"))
            scored = scored.join(most, "id", "left").filter(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("a")))
        parts.append(scored.select("lang", "phrase", "a", "l", "r", "n", "score"))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = union.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
