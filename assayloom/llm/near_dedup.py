"""Near duplicates: MinHash bands, sequential Bayesian verification, exact links.

Documents with the same set of shingles are one class. Classes that share a band
of their MinHash signatures are candidates. A pair's signatures are compared batch
by batch; with ``m`` of ``n`` hashes equal and no prior knowledge the similarity
has the posterior Beta(1 + m, 1 + n - m), and a pair is dropped as soon as a
similarity of the threshold or more is less likely than a chosen miss probability.
What survives is verified on the full sets.

Candidates are found in two steps, so that a band shared by very many documents
doesn't make all pairs of them. First each member of a bucket is compared with one
of it; the links so found make components. Buckets that lie within one component
are done: no further link could change anything. The others are cut into tiles of
bounded size, and tiles are compared in numpy, only across components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import saved
from assayloom.llm.graph import components

#: Words of a shingle, and the least similarity of a link in percent.
SHINGLE, PERCENT = 5, 80
#: Bands and hashes of a band; hashes that are compared at most, of them in a batch, and the chance to drop a pair of the threshold at a batch.
BANDS, ROWS = 32, 4
HASHES, BATCH, MISS = 512, 32, 1e-7
#: Members of a tile, and tiles of a span: pairs of spans are dealt out to tasks. A sure bound on ids that may be broadcast: 8 bytes each.
TILE, SPAN, BROADCAST_IDS = 256, 16, 1_000_000
#: Words whose hash a task remembers.
REMEMBERED = 200_000


def mixed(x: int) -> int:
    """The x-th value of a fixed series of 64-bit numbers (splitmix64)."""
    whole = (1 << 64) - 1
    x = (x + 1) * 0x9E3779B97F4A7C15 & whole
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & whole
    x = (x ^ x >> 27) * 0x94D049BB133111EB & whole
    return x ^ x >> 31


class Shingles:
    """Hashes of the distinct shingles of texts, in order."""

    def __init__(self, size: int):
        self.size = size
        self.known: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        import xxhash

        if len(self.known) >= REMEMBERED:
            self.known.clear()
        found = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, text: str | None):
        """Words are runs without ASCII white space, A-Z in lower case; a shorter text is one shingle."""
        import numpy as np

        known, add = self.known, self._word
        found = (text or "").encode().lower().split()
        x = np.array([add(w) if (h := known.get(w)) is None else h for w in found], dtype=np.uint64)
        if not len(x):
            return x
        n = min(self.size, len(x))
        h = np.full(len(x) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[i:len(x) - n + 1 + i]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(h ^ h >> np.uint64(32))


def _series(n: int):
    """Factors and summands of the first ``n`` MinHash functions."""
    import numpy as np

    return np.array([mixed(2 * i) | 1 for i in range(n)], dtype=np.uint64), np.array([mixed(2 * i + 1) for i in range(n)], dtype=np.uint64)


def _signature(hashes, a, b):
    """32 bits of each function's least value; texts of any length in bounded memory."""
    import numpy as np

    least = np.full(len(a), 2 ** 64 - 1, dtype=np.uint64)
    for i in range(0, len(hashes), 256):
        least = np.minimum(least, (hashes[i:i + 256, None] * a + b).min(axis=0))
    return (least >> np.uint64(32)).astype("<u4")


def signatures(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature) of every row; key and signature are null without words."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _series(BANDS * ROWS)
        shingles = Shingles(size)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                h = shingles.of(text)
                if len(h):
                    rows.append((len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), _signature(h, a, b).tobytes()))
                else:
                    rows.append((0, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "set_key", "signature"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    schema = "doc_id long, n_shingles long, set_key binary, signature binary"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(signed, schema)


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For each batch the least number of equal hashes with which a pair goes on.

    With a flat prior, P(similarity >= t | m of n equal) = P(Binomial(n + 1, t) <= m).
    """
    t, found = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below <= miss:
            m += 1
            below += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        found.append(m)
    return found


def _survivors(left, right, pa, pb, least):
    """Of the pairs (pa, pb) of signatures those that no batch drops."""
    import numpy as np

    equal = np.zeros(len(pa), dtype=np.int64)
    for i, enough in enumerate(least):
        part = slice(i * BATCH, (i + 1) * BATCH)
        equal += (left[pa, part] == right[pb, part]).sum(axis=1)
        stay = equal >= enough
        pa, pb, equal = pa[stay], pb[stay], equal[stay]
        if not len(pa):
            break
    return pa, pb


def _packed(signature) -> bytes:
    """16 bits of each MinHash, then the other 16 of those that make bands."""
    import numpy as np

    rest = signature[:BANDS * ROWS] >> np.uint32(16)
    return np.concatenate([signature.astype("<u2"), rest.astype("<u2")]).tobytes()


def _matrix(signatures):
    import numpy as np

    return np.frombuffer(b"".join(signatures), dtype="<u2").reshape(-1, HASHES + BANDS * ROWS)


def _shared(left, right, pa, pb):
    """Which bands the pairs (pa, pb) share, by all bits of their hashes as the buckets do."""
    equal = left[pa, :BANDS * ROWS] == right[pb, :BANDS * ROWS]
    equal &= left[pa, HASHES:] == right[pb, HASHES:]
    return equal.reshape(-1, BANDS, ROWS).all(axis=2)


def _pruned(pairs: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """Of pairs (a, b) of ids those that survive the batches."""
    least = least_matches(percent, miss)

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            every = np.arange(len(batch))
            stay, _ = _survivors(_matrix(batch["sa"]), _matrix(batch["sb"]), every, every, least) if len(batch) else (every, every)
            yield batch[["a", "b"]].iloc[stay]

    a, b = (sets.select(F.col("id").alias(c), F.col("signature").alias(f"s{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInPandas(kept, "a long, b long")


def sets_of(documents: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, hashes, signature): shingle sets and packed MinHashes of the documents in ``ids`` (id)."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _series(HASHES)
        shingles = Shingles(size)
        for batch in batches:
            sets = [shingles.of(t) for t in batch["text"]]
            yield pd.DataFrame({
                "id": batch["id"], "hashes": [h.astype("int64") for h in sets],
                "signature": [_packed(_signature(h, a, b)) for h in sets],
            })

    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id", "left_semi")
    return texts.mapInPandas(made, "id long, hashes array<long>, signature binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar enough."""
    a, b = (sets.select(F.col("id").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
    both = F.size(F.array_intersect("ha", "hb"))
    either = F.size("ha") + F.size("hb") - both
    return pairs.join(a, "a").join(b, "b").filter(100 * both >= percent * either).select("a", "b")


def _meetings(packed: DataFrame) -> DataFrame:
    """(key, band, ta, tb, left, right): each pair of tiles of a bucket once, joined by pairs of spans.

    ``packed`` are (key, band, n, tile, members). A tile is repeated for each span it
    meets, so the pairs of a bucket of any size aren't the work of one task.
    """
    span = F.expr(f"cast(tile div {SPAN} as int)")
    last = F.expr(f"cast((ceil(n / {TILE}) - 1) div {SPAN} as int)")
    left = packed.select("key", "band", F.col("tile").alias("ta"), F.col("members").alias("left"), span.alias("sa"), F.explode(F.sequence(span, last)).alias("sb"))
    right = packed.select("key", F.col("tile").alias("tb"), F.col("members").alias("right"), span.alias("sb"), F.explode(F.sequence(F.lit(0), span)).alias("sa"))
    return left.join(right, ["key", "sa", "sb"]).filter("ta <= tb")


def _tiles(members: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """Rows (key, ta, tb, id, component, partners): per pair of tiles, who must be verified with whom.

    ``members`` are (key, band, n, id, component) of buckets with several components.
    A pair that shares several bands is looked at in the first of them only.
    """
    least = least_matches(percent, miss)

    def side(members):
        import numpy as np

        ids, component = (members.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "component"))
        return ids, component, _matrix(members.field("signature").to_pylist())

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            out = []
            for i, (key, band, ta, tb) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "band", "ta", "tb")))):
                ia, ca, sa = side(batch.column("left")[i].values)
                ib, cb, sb = side(batch.column("right")[i].values)
                across = ca[:, None] != cb[None, :]
                if ta == tb:
                    across = np.triu(across, 1)
                pa_, pb = _survivors(sa, sb, *np.nonzero(across), least)
                if not len(pa_):
                    continue
                shared = _shared(sa, sb, pa_, pb)
                here = shared[:, band] & (shared.argmax(axis=1) == band)
                pa_, pb = pa_[here], pb[here]
                rows = {int(ia[x]): (int(ca[x]), ib[pb[pa_ == x]].tolist()) for x in np.unique(pa_)}
                for x in np.unique(pb):
                    rows.setdefault(int(ib[x]), (int(cb[x]), []))
                out += [(key, ta, tb, member, c, partners) for member, (c, partners) in rows.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    schema = pa.schema([
        ("key", pa.int64()), ("ta", pa.int32()), ("tb", pa.int32()), ("id", pa.int64()), ("component", pa.int64()), ("partners", pa.list_(pa.int64())),
    ])
    tiles = F.ceil(F.col("n") / TILE)
    dealt = members.withColumn("tile", F.pmod(F.xxhash64("id"), tiles).cast("int")).join(sets.select("id", "signature"), "id")
    # a tile has about TILE members, whatever the size of its bucket
    packed = dealt.groupBy("key", "band", "n", "tile").agg(F.collect_list(F.struct("id", "component", "signature")).alias("members"))
    return _meetings(packed).select("key", "band", "ta", "tb", "left", "right").mapInArrow(
        compared, "key long, ta int, tb int, id long, component long, partners array<long>"
    )


def _linked_tiles(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components; a pair of components that is linked already isn't tried again."""

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        sets = {i: np.asarray(h) for i, h in zip(group["id"], group["hashes"])}
        component = dict(zip(group["id"], group["component"]))
        root: dict[int, int] = {}

        def find(c):
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        found = []
        for a, partners in zip(group["id"], group["partners"]):
            x = sets[a]
            for b in partners:
                p, q = find(component[a]), find(component[b])
                y = sets[b]
                if p == q or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    found.append((a, b))
                    root[max(p, q)] = min(p, q)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.join(sets.select("id", "hashes"), "id").groupBy("key", "ta", "tb").applyInPandas(linked, "a long, b long")


def classes(
    documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT, miss: float = MISS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Documents are linked if their shingle sets have a similarity of ``percent`` or
    more; ``component_id`` is the smallest doc_id reachable by links, and the row
    with that doc_id is kept. Null, empty and wordless texts have no shingle and no
    link. Rows without doc_id are linked with nothing, have no component and are
    kept. doc_id is taken as a key: rows that repeat it with the same text get the
    same result, and with another text their links count together. Other columns
    are not read.
    """
    marked = saved(signatures(documents, size), "signatures")
    sound = marked.filter("doc_id is not null and set_key is not null")
    distinct = saved(
        sound.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")), "classes"
    )
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    part = F.expr(f"substring(signature, {4 * ROWS} * band + 1, {4 * ROWS})")
    keys = distinct.select("id", "signature", band).select("id", "band", F.xxhash64("band", part).alias("key"))
    # counted within tasks first; members of a large bucket aren't brought together
    buckets = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = saved(keys.join(buckets, "key"), "members")
    ids = saved(members.select("id").distinct(), "ids")
    sets = saved(sets_of(documents, ids, size), "sets")

    stars = members.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    first = components(_linked(_pruned(stars, sets, percent, miss), sets, percent))
    placed = members.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    left = placed.join(split.select("key"), "key", "left_semi").select("key", "band", "n", "id", "component")
    more = saved(_linked_tiles(_tiles(left, sets, percent, miss), sets, percent), "more")
    across = more.join(first.withColumnRenamed("id", "a").withColumnRenamed("component", "ca"), "a", "left").join(
        first.withColumnRenamed("id", "b").withColumnRenamed("component", "cb"), "b", "left"
    ).select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = components(across)

    final = distinct.select("set_key", "id").join(first, "id", "left").select("set_key", F.coalesce("component", "id").alias("c")).join(
        second.withColumnRenamed("id", "c"), "c", "left"
    ).select("set_key", F.coalesce("component", "c").alias("component_id"))
    return marked.join(final, "set_key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """The rows that are kept, with their own columns; of rows that repeat a doc_id the first by text."""
    from pyspark.sql import Window

    from assayloom.llm.common import fresh, own_columns

    own = own_columns(documents)
    (turn,) = fresh(documents, "turn")
    found = saved(classes(documents, size, percent, miss), "kept")
    gone = found.filter("not kept").select("doc_id").distinct()
    rest = documents.join(gone, "doc_id", "left_anti").select(own)
    repeats = saved(found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeats")
    if repeats.isEmpty():
        return rest
    again = rest.join(repeats, "doc_id", "left_semi").select(own)
    first = again.withColumn(turn, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).filter(F.col(turn) == 1)
    return rest.join(repeats, "doc_id", "left_anti").select(own).unionByName(first.drop(turn))
