"""Pack documents into sequences of bounded length: match large items, best fit for the rest.

Only lengths decide, and there are no more lengths than tokens in a sequence. So
one histogram of lengths, whose size doesn't depend on the data, is packed as a
whole, for all documents at once, in classes of equal sequences. Each piece then
finds its sequence and offset from its rank among the pieces of its length.

* Pieces longer than a third of a sequence are matched greedily, at most two to
  a sequence: the largest with the largest that fits beside it.
* Shorter pieces, longest first, go into the sequence whose gap they fill best,
  or into a new one.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.common import saved

CAPACITY, SEPARATOR = 4096, 1
#: Pieces of one length that one window ranks.
SLOT_ROWS = 500
#: Parts of texts that a task remembers, and characters of the longest of those.
REMEMBERED, LONG = 400_000, 64


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in seen)
    letters = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Tokens:
    """Ids of texts as little-endian 32-bit bytes.

    For byte-level tokenizers that normalise, split by a pattern and merge each
    part by itself. Parts that are new in a batch are given to the tokenizer's
    model, short ones are remembered. A text with characters from ``PLAIN`` on goes
    through the tokenizer as a whole, so no table of letters but its own decides;
    so does a text that holds an added token, which is cut out before the pattern.
    """

    PLAIN = "\u0530"

    def __init__(self, path: str):
        import json
        import os
        import re

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        pattern = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # one that is looked for in the normalised text could be in any text
        self.added = ["" if t["normalized"] else t["content"] for t in model.get("added_tokens") or []]
        self.pattern = regex.compile(pattern)
        # the same for ASCII alone, in lower case
        self.ascii = re.compile(pattern.replace("\\p{L}", "a-z").replace("\\p{N}", "0-9"), re.ASCII)
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}

    def _split(self, text: str) -> list[str] | None:
        if any(t in text for t in self.added):
            return None
        if text.isascii():
            return self.ascii.findall(text.lower())
        if max(text) < self.PLAIN:
            # a final sigma aside, lower case goes letter by letter here
            simple = "\u03a3" not in text and unicodedata.is_normalized("NFC", text)
            return self.pattern.findall(text.lower() if simple else self.tokenizer.normalizer.normalize_str(text))
        return None

    def _part(self, part: str) -> bytes:
        if not (part.isascii() and part.isprintable()):
            part = "".join(map(self.letters.__getitem__, part.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(part)]).tobytes()

    def batch(self, texts: list[str | None]) -> list[bytes]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        split = [self._split(t or "") for t in texts]
        new = set().union(*(p for p in split if p is not None)).difference(known)
        for part in new:
            known[part] = self._part(part)
        out = [self._whole(t) if p is None else b"".join(map(known.__getitem__, p)) for t, p in zip(texts, split)]
        for part in new:
            if len(part) > LONG:
                del known[part]
        return out

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def cut(documents: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): pieces of at most ``capacity`` tokens.

    A document is the ids of its text (null: empty) and the separator, so each
    has a piece. Only documents longer than a sequence have more than one.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, end, size = Tokens(path), separator.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"].astype("Int64"), tokens.batch(batch["text"].tolist())):
                ids += end
                for piece, start in enumerate(range(0, len(ids), size)):
                    part = ids[start:start + size]
                    rows.append((doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(pieces, schema)


def arrange(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Pack a histogram of lengths: (length, first, rows, copies, sequence, offset).

    The pieces of a length with ranks ``first`` to ``first + rows - 1`` go,
    ``copies`` to each, into the sequences from ``sequence`` on, side by side from
    ``offset`` on. Lengths are 1 to ``capacity``.
    """
    left = {s: n for s, n in histogram.items() if n}
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    opened = 0
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, number of sequences), by gap

    def place(size: int, copies: int, sequence: int, sequences: int, offset: int) -> None:
        rows = copies * sequences
        out.append((size, used[size], rows, copies, sequence, offset))
        used[size] += rows
        left[size] -= rows

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        fits = bisect_left(large, capacity - size + 1) - 1  # largest that fits beside it
        mate = large[fits] if fits >= 0 else 0
        if mate == size and left[size] == 1:  # no second one of its length
            mate = large[fits - 1] if fits > 0 else 0
        n = left[size] if not mate else left[size] // 2 if mate == size else min(left[size], left[mate])
        place(size, 1, opened, n, 0)
        if mate:
            place(mate, 1, opened, n, size)
        if capacity > size + mate:
            insort(gaps, (capacity - size - mate, opened, n))
        opened += n
        large = [s for s in large if left[s]] if not left[size] or not left.get(mate, 1) else large

    for size in sorted((s for s in left if left[s]), reverse=True):
        while left[size]:
            at = bisect_left(gaps, (size, -1, 0))
            if at == len(gaps):  # as many new sequences as the rest of this length fills
                n = -(-left[size] // (capacity // size))
                insort(gaps, (capacity, opened, n))
                opened += n
                at = bisect_left(gaps, (size, -1, 0))
            gap, first, n = gaps.pop(at)
            copies = gap // size
            full = min(n, left[size] // copies)
            if full:
                place(size, copies, first, full, capacity - gap)
                if gap > copies * size:
                    insort(gaps, (gap - copies * size, first, full))
            if full < n:
                rest = left[size]
                if rest:
                    place(size, rest, first + full, 1, capacity - gap)
                    insort(gaps, (gap - rest * size, first + full, 1))
                    full += 1
                if full < n:
                    insort(gaps, (gap, first + full, n - full))
    return out


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty and are one separator; a null doc_id stays null and
    its document is packed like any other; repeated rows are packed each; an empty
    table gives no row; other columns are not read.
    """
    spark = documents.sparkSession
    pieces = saved(cut(documents, path, capacity, separator), "pieces")
    # at most ``capacity`` lengths, whatever the number of pieces
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = arrange(counts, capacity)
    slots = spark.createDataFrame([(s, -(-n // SLOT_ROWS)) for s, n in counts.items()], "length long, slots long")
    hashed = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    dealt = pieces.join(F.broadcast(slots), "length").withColumn("slot", F.pmod(hashed, "slots")).drop("slots")
    # rank of a piece among its length: the pieces of earlier slots, then those before it in its own
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    earlier = dealt.groupBy("length", "slot").count().select(
        "length", "slot", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier")
    )
    inside = Window.partitionBy("length", "slot").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        dealt.withColumn("inside", F.row_number().over(inside) - 1).join(earlier, ["length", "slot"])
        .withColumn("rank", F.col("earlier") + F.col("inside"))
    )
    # the plan's size depends on ``capacity`` alone
    rules = spark.createDataFrame(plan, "of long, first long, rows long, copies long, sequence long, at long")
    hit = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("rows"))
    turn = F.col("rank") - F.col("first")
    return ranked.join(F.broadcast(rules), hit).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(turn / F.col("copies"))).alias("sequence_id"),
        (F.col("at") + turn % F.col("copies") * F.col("length")).alias("offset"),
    )
