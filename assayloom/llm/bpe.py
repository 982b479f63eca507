"""Byte-level BPE: encode by merge ranks, decode by the token table.

A match of the splitting pattern is merged as bytes. A segment tree stands over
the byte positions: each leaf holds the rank of the pair that starts at a live
position, each inner node the smallest below it, leftmost on ties, so its root is
the next merge. A merge updates the leaves of the position it starts at, of its
left neighbour and of the position that is gone, at logarithmic cost each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Matches of the pattern that a task remembers, and characters of the longest of those.
REMEMBERED, LONG = 600_000, 64
#: Bytes of a match that is merged together with others.
FEW = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (base64 and decimal per line)."""
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


NONE = 1 << 62


def pair_tree(keys: list[int]) -> list[int]:
    """Node 1 is the root, nodes 2i and 2i + 1 lie below node i, leaves come last; each node is the least below it."""
    size = 1 << max(0, len(keys) - 1).bit_length()
    nodes = [NONE] * size + keys + [NONE] * (size - len(keys))
    for i in range(size - 1, 0, -1):
        left, right = nodes[2 * i], nodes[2 * i + 1]
        nodes[i] = left if left < right else right
    return nodes


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match of the pattern. Bytes that no token holds raise KeyError."""
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    shift = n.bit_length()
    mask = (1 << shift) - 1
    # rank and position as one number: the least is the smallest rank, on the left
    nodes = pair_tree([NONE if (r := get(piece[i:i + 2])) is None else r << shift | i for i in range(n - 1)])
    size = len(nodes) >> 1
    after = list(range(1, n + 1))  # start of the next live part
    before = list(range(-1, n - 1))
    while (top := nodes[1]) != NONE:
        at = top & mask
        gone = after[at]
        end = after[at] = after[gone]
        left = before[at]
        if end < n:
            before[end] = at
            r = get(piece[at:after[end]])
            changed = [(at, NONE if r is None else r << shift | at)]
            if gone < n - 1:
                changed.append((gone, NONE))
        else:
            changed = [(at, NONE)]
        if left >= 0:
            r = get(piece[left:end])
            changed.append((left, NONE if r is None else r << shift | left))
        for i, key in changed:
            i += size
            if nodes[i] == key:
                continue
            nodes[i] = key
            while i > 1:
                other = nodes[i ^ 1]
                if other < key:
                    key = other
                i >>= 1
                if nodes[i] == key:
                    break  # nothing changes further up
                nodes[i] = key
    found, at = [], 0
    while at < n:
        end = after[at]
        found.append(ranks[piece[at:end]])
        at = end
    return found


class Pairs:
    """Ranks of pairs of tokens: a merge joins two tokens into the token of their bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np

        found = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        keys = sorted(found)
        self.keys = np.array([*keys, NONE], dtype=np.int64)
        self.ranks = np.array([*(found[k] for k in keys), NONE], dtype=np.int64)
        self.bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int64)

    def of(self, left, right):
        """Rank of each pair; NONE where the two don't join or one is missing (-1)."""
        import numpy as np

        keys = np.where((left < 0) | (right < 0), NONE - 1, left << 32 | right)
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)


def merge_many(pieces: list[bytes], pairs: Pairs) -> list[list[int]]:
    """``merge`` for many pieces of 2 to FEW bytes that are no tokens: a tree for each, all stepped together."""
    import numpy as np

    out: list[list[int]] = [[] for _ in pieces]
    classes: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        classes.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
    for size, chosen in classes.items():
        rows = np.arange(len(chosen))
        text = np.frombuffer(b"".join(pieces[i].ljust(size + 1, b"\0") for i in chosen), dtype=np.uint8).reshape(-1, size + 1)
        n = np.array([len(pieces[i]) for i in chosen])
        place = np.arange(size + 1)
        ids = np.where(place < n[:, None], pairs.bytes[text], -1)
        if (ids[place < n[:, None]] < 0).any():
            raise KeyError("a byte is no token")
        nodes = np.full((len(chosen), 2 * size), NONE, dtype=np.int64)

        def keyed(rank, position):
            return np.where(rank == NONE, NONE, rank << 8 | position)

        nodes[:, size:] = keyed(pairs.of(ids[:, :-1], ids[:, 1:]), place[:-1])
        level = size
        while level > 1:
            nodes[:, level >> 1:level] = np.minimum(nodes[:, level:2 * level:2], nodes[:, level + 1:2 * level:2])
            level >>= 1
        after = np.minimum(place + 1, n[:, None])
        before = np.tile(place - 1, (len(chosen), 1))
        while len(rows := rows[nodes[rows, 1] < NONE]):
            top = nodes[rows, 1]
            at = top & 255
            gone = after[rows, at]
            end = after[rows, gone]
            left = before[rows, at]
            ids[rows, at] = top >> 8
            ids[rows, gone] = -1
            after[rows, at] = end
            before[rows, end] = at
            nodes[rows, size + gone] = NONE
            nodes[rows, size + at] = keyed(pairs.of(ids[rows, at], np.where(end < n[rows], ids[rows, end], -1)), at)
            some = left >= 0
            r, x = rows[some], left[some]
            nodes[r, size + x] = keyed(pairs.of(ids[r, x], ids[r, at[some]]), x)
            for which, leaf in ((rows, gone), (rows, at), (r, x)):
                node = size + leaf
                for _ in range(size.bit_length() - 1):
                    node = node >> 1
                    nodes[which, node] = np.minimum(nodes[which, 2 * node], nodes[which, 2 * node + 1])
        live = ids >= 0
        ends = np.cumsum(live.sum(axis=1))
        flat = ids[live].tolist()
        for i, start, stop in zip(chosen, [0, *ends[:-1].tolist()], ends.tolist()):
            out[i] = flat[start:stop]
    return out


class Codec:
    """Encodes and decodes texts with one table of ranks; remembers short matches of the pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.pairs = Pairs(ranks)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.names = {rank: str(rank) for rank in ranks.values()}
        self.pattern = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null counts as empty."""
        return next(self.batch([text]))

    def batch(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text. What is new in the batch is merged together."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        matches = [self.pattern.findall(t or "") for t in texts]
        new = list(set().union(*matches).difference(known))
        short = []
        for match in new:
            piece = match.encode()
            if 2 <= len(piece) <= FEW and piece not in self.ranks:
                short.append((match, piece))
            else:
                known[match] = merge(piece, self.ranks)
        known.update(zip([m for m, _ in short], merge_many([p for _, p in short], self.pairs)))
        for found in matches:
            yield list(chain.from_iterable(map(known.__getitem__, found)))
        for match in new:
            if len(match) > LONG:
                del known[match]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids; an unknown id raises KeyError."""
        return b"".join(map(self.tokens.__getitem__, ids))


def _codec(path: str, pattern: str):
    """A function that reads the ranks once per task; the file is at the same path everywhere."""
    made: list[Codec] = []

    def get() -> Codec:
        if not made:
            made.append(Codec(read_ranks(path), pattern))
        return made[0]

    return get


def encode(documents: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with the ids of a text column; a null text has no ids. An ``ids`` column is replaced."""
    codec = _codec(path, pattern)

    @F.pandas_udf("array<int>")
    def encoded(texts: pd.Series) -> pd.Series:
        return pd.Series(list(codec().batch(texts.tolist())), dtype=object)

    return documents.withColumn(ids, encoded(text))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """The rows with the bytes of an id column; null ids are empty bytes."""
    codec = _codec(path, pattern)

    @F.pandas_udf("binary")
    def decoded(rows: pd.Series) -> pd.Series:
        return pd.Series([codec().decode([] if r is None else list(r)) for r in rows], dtype=object)

    return encoded.withColumn(data, decoded(ids))


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row.

    Texts are encoded, the ids decoded, and digests taken of both in one pass, so
    ids aren't moved between processes. Null texts count as empty, a null doc_id
    stays null, repeated rows appear each, other columns are not read.
    """
    codec = _codec(path, pattern)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec()
        for batch in batches:
            found = []
            for ids in c.batch(batch["text"].tolist()):
                listed = ",".join(map(c.names.__getitem__, ids))
                found.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            out = pd.DataFrame(found, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(rows, schema)
