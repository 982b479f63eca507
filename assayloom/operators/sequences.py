"""Peptides against protein sequences and their variants, for all proteins at once.

A protein is a small directed graph: runs of the reference, one node per variant
allele, and sentinels at both ends.  Graphs of all proteins share two tables,

nodes: protein_id, node_id, pos, seq, kind      edges: protein_id, src, dst

with ``pos`` the 0-based reference position a node starts at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayloom.plans.storage import cut, written
from assayloom.schema import col

START, END = "__start__", "__end__"
CHUNK = 256  # letters that are cut into k-mers together
BIN = 4096  # positions of a bin in which seeds meet nodes
PART = 16384  # letters that are shipped to Python together
LETTERS_AT_ONCE = 1 << 20  # letters that numpy works on together
LOOKED_UP_AT_ONCE = 1 << 17  # and those that are looked up together: what is held of them stays in a core's cache
SLOTS = 23  # k-mers that are asked for are marked in a table of 2^23 bits, however many they are
_PAD = 0x110000  # stands for what lies behind the end of a sequence; no letter
#: Nodes and edges of a protein whose longest paths one task follows; larger graphs shrink in rounds.
GRAPH_AT_ONCE = 500_000


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    #: The same graph of the proteins of a table only, built of nothing else; without it, nodes and edges are filtered.
    of: Callable[[DataFrame], Graph] | None = None


# --------------------------------------------------------------- flat files


def read_flat_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of UniProt text files: protein_id, seq, seq_len and raw text."""
    entries = spark.read.text(path, lineSep="\n//").filter(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    found = lambda p, g=1: F.nullif(F.regexp_extract("value", p, g), F.lit(""))
    letters = F.regexp_replace(found(r"(?s)(?:^|\n)SQ\s+SEQUENCE[^\n]*\n(.*)"), r"\s", "")
    return entries.select(
        found(r"(?:^|\n)AC\s+([^;\s]+)").alias("protein_id"),
        F.nullif(letters, F.lit("")).alias("seq"),
        found(r"(?:^|\n)SQ\s+SEQUENCE\s+(\d+)").cast("int").alias("seq_len"),
        F.col("value").alias("text"),
    )


def proteins(entries: DataFrame) -> DataFrame:
    """(protein_id, seq, seq_len) of the complete entries."""
    return entries.filter("seq is not null and seq_len > 0").select("protein_id", "seq", "seq_len")


def incomplete_entries(entries: DataFrame) -> DataFrame:
    """Entries without a sequence or a sequence length, with the reason."""
    reason = F.when(F.col("seq").isNull(), "no sequence").when(F.coalesce("seq_len", F.lit(0)) < 1, "no sequence length")
    return entries.withColumn("reason", reason).filter("reason is not null").select("protein_id", "reason")


def variants(entries: DataFrame) -> DataFrame:
    """(protein_id, pos, end_pos, ref, alt, note): 1-based inclusive, alt empty for a deletion.

    ``ref`` and ``alt`` are null when the note cannot be read.
    """
    pattern = r'(?:^|\n)FT\s+VARIANT\s+(\d+)(?:\.\.(\d+))?\s*\nFT\s+/note="([^"\n]*)'
    part = lambda g: F.regexp_extract_all("text", F.lit(pattern), F.lit(g))
    rows = entries.select("protein_id", F.explode(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("note"))).alias("v"))
    pos = F.col("v.a").cast("int")
    change = r"([A-Z]+) -> ([A-Z]+)"
    gone = F.contains(F.col("v.note"), F.lit("Missing"))
    ref = F.nullif(F.regexp_extract("v.note", change, 1), F.lit(""))
    alt = F.nullif(F.regexp_extract("v.note", change, 2), F.lit(""))
    return rows.select(
        "protein_id",
        pos.alias("pos"),
        F.coalesce(F.nullif(F.col("v.b"), F.lit("")).cast("int"), pos).alias("end_pos"),
        F.when(~gone, ref).alias("ref"),
        F.when(gone, F.lit("")).otherwise(alt).alias("alt"),
        F.col("v.note").alias("note"),
    )


def split_variants(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): variants that make the sequence longer are dropped.

    Deletions and notes that cannot be read are kept.
    """
    longer = F.coalesce(F.length("alt") > F.length("ref"), F.lit(False))
    return found.filter(~longer), found.filter(longer)


# -------------------------------------------------------------------- seeds


def _padded(parts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """Code points of the parts with k - 1 pads behind each, where each starts and how long it is, and the same as text."""
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    starts = np.concatenate([[0], np.cumsum(sizes + k - 1)[:-1]]).astype(np.int64)
    joined = "".join(x + "\0" * (k - 1) for x in parts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    if k > 1:
        behind = (starts + sizes)[:, None] + np.arange(k - 1)
        points[behind.ravel()] = _PAD
    return points, starts, sizes, joined


def _slots(points: np.ndarray, k: int) -> np.ndarray:
    """A slot for the k letters from each place on: a polynomial modulo 2^64, doubled up to its length."""
    base = np.uint64(0x9E3779B97F4A7C15)
    whole, length, power = points.astype(np.uint64) + np.uint64(1), 1, base
    taken, count = None, 0
    while True:
        if k & length:
            if taken is None:
                taken, count = whole, length
            else:
                n = len(points) - count - length + 1
                taken, count = taken[:n] * power + whole[count:count + n], count + length
        if length * 2 > k:
            return (taken * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SLOTS)
        whole, length = whole[:-length] * power + whole[length:], length * 2
        power = np.uint64(int(power) ** 2 % (1 << 64))


def _batched(parts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of parts that hold about LOOKED_UP_AT_ONCE letters."""
    first = held = 0
    for i, part in enumerate(parts):
        held += len(part)
        if held >= min(LOOKED_UP_AT_ONCE, LETTERS_AT_ONCE):
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(parts):
        yield first, len(parts)


def _slots_of(texts: list[str], k: int) -> np.ndarray:
    """The slots of texts of at most k letters, padded behind."""
    found = [np.zeros(0, dtype=np.uint64)]
    for first, last in _batched(texts):
        points, starts, sizes, _ = _padded([x or "\0" for x in texts[first:last]], k)
        found.append(_slots(points, k)[starts])
    return np.concatenate(found)


def _marked(among: DataFrame | Sequence[str], k: int) -> np.ndarray:
    """One bit per slot that a k-mer asked for falls into: 1 MB, built by Spark from however many k-mers."""
    table = np.zeros(1 << SLOTS, dtype=bool)
    if not isinstance(among, DataFrame):
        table[_slots_of([x[:k] for x in among], k).astype(np.int64)] = True
        return np.packbits(table)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # counted from 1, as the buckets of bits are
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slots_of(batch.column(0).to_pylist(), k)).astype(np.int64) + 1)], ["slot"])

    asked = among.select(F.substring("kmer", 1, k).alias("kmer")).filter("kmer is not null")
    found = asked.mapInArrow(slots, "slot long").groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    for row in found.collect():  # at most 2^23 bits
        bits = np.unpackbits(np.frombuffer(bytes(row["bits"]), dtype=np.uint8), bitorder="little")
        table[(row["bucket"] - 1) * len(bits) + np.nonzero(bits)[0]] = True
    return np.packbits(table)


def _parts(sequences: DataFrame, k: int, size: int, key: str, seq: str) -> DataFrame:
    """(key, __at, __part, __left): texts cut every ``size`` letters, each part with the k - 1 letters that follow."""
    chunks = sequences.select(
        col(key),
        F.explode(F.sequence(F.lit(0), F.length(col(seq)) - 1, F.lit(size))).alias("__at"),
        col(seq).alias("__seq"),
    ).filter(F.length("__seq") > 0)
    part = F.substring("__seq", F.col("__at") + 1, F.lit(size + k - 1))
    return chunks.select(col(key), "__at", part.alias("__part"), (F.length("__seq") - F.col("__at")).alias("__left"))


def kmers(
    sequences: DataFrame, k: int, *, key: str = "protein_id", seq: str = "seq", among: DataFrame | Sequence[str] | None = None, merged: bool = False
) -> DataFrame:
    """(key, kmer, pos, left) of every start position; those near the end are shorter.

    The text is cut into chunks first: taking a substring costs its offset, which
    would be quadratic in the length of a long text, and chunks of a long text
    spread over tasks.

    ``among`` (a table with a column kmer, or texts) tells which k-mers are asked for: all of
    these are given, and hardly any others, so whoever asks joins or filters them once
    more; no row is built for the rest. ``merged`` gives (kmer, n, keys, first) rows instead
    whose sums, and least first position, per k-mer tell how often it occurs, and in how
    many keys; what a task meets together is merged there.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if merged:
        return _merged_kmers(sequences, k, key, seq)
    if among is not None:
        return _kmers_among(sequences, k, key, seq, _marked(among, k))
    chunks = _parts(sequences, k, CHUNK, key, seq)
    starts = F.sequence(F.lit(0), F.least(F.length("__part"), F.lit(CHUNK)) - 1)
    return chunks.select(col(key), "__at", "__part", "__left", F.explode(starts).alias("__i")).select(
        col(key),
        F.substring("__part", F.col("__i") + 1, F.lit(k)).alias("kmer"),
        (F.col("__at") + F.col("__i")).alias("pos"),
        (F.col("__left") - F.col("__i")).alias("left"),
    )


def _kmers_among(sequences: DataFrame, k: int, key: str, seq: str, marked: np.ndarray) -> DataFrame:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(marked).view(bool)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            at, left = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 3))
            for first, last in _batched(texts):
                points, starts, sizes, joined = _padded(texts[first:last], k)
                place = np.nonzero(table[_slots(points, k).astype(np.int64)])[0]
                row = np.searchsorted(starts, place, side="right") - 1
                i = place - starts[row]
                inside = i < np.minimum(sizes[row], PART)
                row, i, place = row[inside], i[inside], place[inside]
                words = [joined[p:p + n] for p, n in zip(place.tolist(), np.minimum(sizes[row] - i, k).tolist())]
                row = row + first
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(row)), pa.array(words, pa.string()),
                    pa.array((at[row] + i).astype(np.int32)), pa.array((left[row] - i).astype(np.int32)),
                ], [key, "kmer", "pos", "left"])

    schema = f"`{key}` {sequences.select(col(key)).schema[0].dataType.simpleString()}, kmer string, pos int, left int"
    return _parts(sequences, k, PART, key, seq).mapInArrow(found, schema)


def _exact_codes(points: np.ndarray, k: int) -> np.ndarray:
    """A number for the k letters from each place on: equal where the letters are, without any hash."""
    used = np.zeros(_PAD + 1, dtype=bool)
    used[points] = True
    letters = np.cumsum(used)[points] - 1
    size = int(used.sum())
    codes, most = letters, size
    for j in range(1, k):
        if most * size >= 1 << 62:
            kinds, codes = np.unique(codes, return_inverse=True)
            most = len(kinds)
        codes, most = codes[:-1] * size + letters[j:], most * size
    return codes


def _sorted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes in order, and where each was; equal ones by where they were."""
    bits = len(codes).bit_length()
    if len(codes) and codes.max() < 1 << (62 - bits):  # code and place fit one number: several times faster
        both = np.sort((codes.astype(np.int64) << bits) | np.arange(len(codes)))
        return both >> bits, both & ((1 << bits) - 1)
    order = np.argsort(codes, kind="stable")
    return codes[order], order


def _merged_kmers(sequences: DataFrame, k: int, key: str, seq: str) -> DataFrame:
    def merge(rows: list[tuple], before: tuple) -> tuple[pa.RecordBatch, tuple]:
        """The merged k-mers of some parts; ``before``: the key the parts before ended with, and its k-mers."""
        names = [r[0] for r in rows]
        number = np.cumsum([0] + [a != b for a, b in zip(names, names[1:])])
        points, starts, sizes, joined = _padded([r[2] for r in rows], k)
        takes = np.minimum(sizes, PART)
        places = np.arange(takes.sum())
        along = lambda x: np.repeat(x - (np.cumsum(takes) - takes), takes) + places
        place = along(starts)
        codes, order = _sorted(_exact_codes(points, k)[place])
        owner = np.repeat(number, takes)[order]
        fresh = np.append(True, codes[1:] != codes[:-1])
        # parts come key by key, so of equal k-mers those of a key lie together, and the last key's at the end
        other = fresh | np.append(True, owner[1:] != owner[:-1])
        if None in names:
            other &= np.repeat(np.array([x is not None for x in names]), takes)[order]
        begin = np.nonzero(fresh)[0]
        end = np.append(begin[1:], len(codes))
        n = end - begin
        keys = np.add.reduceat(other.astype(np.int64), begin)
        first = np.minimum.reduceat(along(np.array([r[1] for r in rows], dtype=np.int64))[order], begin)
        row = np.searchsorted(np.cumsum(takes), order[begin], side="right")
        here = place[order[begin]]
        words = [joined[p:p + m] for p, m in zip(here.tolist(), np.minimum(starts[row] + sizes[row] - here, k).tolist())]
        last = {words[j] for j in np.nonzero(owner[end - 1] == number[-1])[0].tolist()}
        if before[0] is not None and before[0] == names[0]:
            keys -= np.array([bool(h) and w in before[1] for h, w in zip((owner[begin] == 0).tolist(), words)], dtype=np.int64)
            if number[-1] == 0:
                last |= before[1]
        made = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n), pa.array(keys), pa.array(first)], ["kmer", "n", "keys", "first"])
        return made, (names[-1], last)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters, before = [], 0, (None, set())
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in range(3))):
                held.append(r)
                letters += len(r[2])
                if letters >= 2 * LETTERS_AT_ONCE:
                    made, before = merge(held, before)
                    held, letters = [], 0
                    yield made
        if held:
            yield merge(held, before)[0]

    # by number, so tasks aren't gathered by their size: they read little and compute much
    tasks = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = sequences.select(col(key), col(seq)).repartition(tasks, col(key)).sortWithinPartitions(col(key))
    return _parts(together, k, PART, key, seq).mapInArrow(found, "kmer string, n long, keys long, first long")


def seeds(sequences: DataFrame, peptides: DataFrame, k: int, *, key: str = "protein_id", seq: str = "seq") -> DataFrame:
    """(peptide, key, start): the first k letters match and the peptide fits into the sequence."""
    wanted = peptides.select("peptide").distinct().withColumn("kmer", F.substring("peptide", 1, k))
    hits = kmers(sequences, k, key=key, seq=seq, among=wanted.select("kmer")).join(wanted, "kmer")
    return hits.filter(F.length("peptide") <= F.col("left")).select("peptide", col(key), F.col("pos").alias("start"))


def without_match(peptides: DataFrame, matched: DataFrame) -> DataFrame:
    """Distinct peptides that are not among the matched ones."""
    return peptides.select("peptide").distinct().join(matched.select("peptide"), "peptide", "left_anti")


# -------------------------------------------------------------------- graph


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(protein_id, src, dst) of (protein_id, borders, lengths, alleles) rows: nodes that end where others start."""
    for batch in batches:
        rows, src, dst = [], [], []

        def made():
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(src, pa.string()), pa.array(dst, pa.string())], ["protein_id", "src", "dst"]
            )

        for row, (borders, lengths, alleles) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
            leaving, entering = defaultdict(list), defaultdict(list)
            for at, stop in zip(borders, borders[1:]):  # a run for each sequence of that name
                runs = [f"r{at}"] * len(lengths)
                leaving[stop] += runs
                entering[at] += runs
            for v in alleles or ():
                name = f"v{v['pos']}_{v['stop']}_{v['seq']}"
                leaving[v["stop"]].append(name)
                entering[v["pos"]].append(name)
            leaving[0] += [START] * len(lengths)
            for length in lengths:
                entering[length].append(END)
            for at, here in leaving.items():
                there = entering.get(at, ())
                for x in here:
                    src += [x] * len(there)
                    dst += there
            rows += [row] * (len(src) - len(rows))
            if len(rows) >= 1 << 17:
                yield made()
                rows, src, dst = [], [], []
        if rows:
            yield made()


def variation_graph(sequences: DataFrame, kept_variants: DataFrame) -> Graph:
    """Nodes and edges of every protein.

    The reference is cut where a variant starts or ends.  A deletion is a node
    without letters.  Nodes are linked where one ends and another starts.

    The places of a protein's variants are gathered in a row, so tables that are sorted
    have a row per protein; nodes and edges are unfolded from them. Lengths are written once:
    only runs read the texts again. Spark filters no proteins below what unfolds them, so ``of`` does.
    """
    sizes = cut(sequences.select("protein_id", F.length("seq").alias("length")))

    def some(names: DataFrame) -> Graph:
        return _unfolded(*(x.join(names.select("protein_id"), "protein_id", "left_semi") for x in (sequences, sizes, kept_variants)))

    return _unfolded(sequences, sizes, kept_variants)._replace(of=some)


def _unfolded(sequences: DataFrame, sizes: DataFrame, kept_variants: DataFrame) -> Graph:
    alleles = kept_variants.filter("alt is not null").groupBy("protein_id").agg(
        F.collect_set(F.struct((F.col("pos") - 1).alias("pos"), F.col("end_pos").alias("stop"), F.col("alt").alias("seq"))).alias("alleles")
    )
    lengths = sizes.filter("protein_id is not null").groupBy("protein_id").agg(F.collect_list("length").alias("lengths"))
    ends = F.filter(F.concat(F.col("alleles.pos"), F.col("alleles.stop")), lambda x: x.isNotNull())
    borders = F.sort_array(F.array_distinct(F.concat(F.array(F.lit(0)), "lengths", F.coalesce(ends, F.array().cast("array<int>")))))
    placed = lengths.join(alleles, "protein_id", "left").select("protein_id", borders.alias("borders"), "lengths", "alleles")
    spans = F.zip_with(F.slice("borders", 1, F.size("borders") - 1), F.slice("borders", 2, F.size("borders")), lambda x, y: F.struct(x.alias("pos"), y.alias("stop")))
    runs = (
        sequences.select("protein_id", F.col("seq").alias("__seq"))
        .join(placed.select("protein_id", spans.alias("spans")), "protein_id")
        .select("protein_id", "__seq", F.explode("spans").alias("s"))
        .select(
            "protein_id", F.col("s.pos").alias("pos"), F.substring("__seq", F.col("s.pos") + 1, F.col("s.stop") - F.col("s.pos")).alias("seq"),
            F.concat(F.lit("r"), F.col("s.pos").cast("string")).alias("node_id"), F.lit("reference").alias("kind"),
        )
    )
    variant_nodes = placed.select("protein_id", F.explode("alleles").alias("v")).select("protein_id", "v.*").select(
        "protein_id", "pos", "seq",
        F.concat_ws("_", F.concat(F.lit("v"), F.col("pos").cast("string")), F.col("stop").cast("string"), "seq").alias("node_id"),
        F.when(F.col("seq") == "", "deletion").otherwise("variant").alias("kind"),
    )
    sentinels = sizes.select(
        "protein_id",
        F.explode(F.array(
            F.struct(F.lit(0).alias("pos"), F.lit("").alias("seq"), F.lit(START).alias("node_id"), F.lit("start").alias("kind")),
            F.struct(F.col("length").alias("pos"), F.lit("").alias("seq"), F.lit(END).alias("node_id"), F.lit("end").alias("kind")),
        )).alias("s"),
    ).select("protein_id", "s.*")
    nodes = runs.unionByName(variant_nodes).unionByName(sentinels)
    placed = placed.withColumn("alleles", F.filter("alleles", lambda v: v["pos"].isNotNull() & v["stop"].isNotNull()))
    edges = placed.mapInArrow(_linked, f"protein_id {sequences.schema['protein_id'].dataType.simpleString()}, src string, dst string")
    return Graph(nodes.select("protein_id", "node_id", "pos", "seq", "kind"), edges)


def _letters(seq: Column, kind: Column) -> Column:
    return F.when(kind.isin("start", "end"), F.lit(0)).otherwise(F.length(seq))


#: Weight of a way from a node that no start leads to; no protein is that long.
_LOST = -(1 << 60)


def _to_their_ends(hung: DataFrame) -> DataFrame:
    """(protein_id, node, head, d) with each node hung on the last head of its chain, by pointer doubling.

    Two doublings a round; a chain of n nodes takes log4(n) rounds. Heads that never
    end run in a cycle.
    """

    def doubled(links):
        up = links.select("protein_id", F.col("node").alias("head"), F.col("head").alias("next"), F.col("d").alias("more"), F.lit(True).alias("met"))
        joined = links.join(up, ["protein_id", "head"], "left")
        return joined.select(
            "protein_id", "node", F.when(F.col("met"), F.col("next")).otherwise(F.col("head")).alias("head"),
            (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), F.coalesce("met", F.lit(False)).alias("met"),
        )

    links = written(hung, "links")
    left = links.count()
    while True:
        moved = written(doubled(doubled(links).drop("met")), "links")
        links = moved.drop("met")
        if moved.filter("met").isEmpty():
            return links
        if left == 0:
            raise ValueError("offsets do not settle; the graph has a cycle")
        left //= 4


def _ways_of(table: pa.Table) -> pa.RecordBatch:
    """(protein_id, node_id, offset, state) of the nodes of some whole proteins.

    Rows with a ``dst`` are edges, the others nodes. A node is settled once all edges
    into it are followed, so each edge is seen once.
    """
    table = table.combine_chunks()
    size, first = table["size"].fill_null(_LOST).to_numpy(), table["first"].fill_null(False).to_numpy(zero_copy_only=False)
    node = table["dst"].is_null().to_numpy(zero_copy_only=False)
    names = pa.chunked_array([*table["src"].chunks, *table["dst"].chunks]).combine_chunks().dictionary_encode()
    code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    protein = table["protein_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = (protein * (len(names.dictionary) + 1))
    src, dst = key + code[:len(key)], key + code[len(key):]
    known, number = np.unique(src[node], return_inverse=True)
    n = len(known)
    best, letters = np.full(n, _LOST), np.full(n, _LOST)
    np.maximum.at(letters, number, size[node])
    best[number[first[node]]] = 0
    a, b = (np.minimum(np.searchsorted(known, x[~node]), n - 1) for x in (src, dst))
    met = (known[a] == src[~node]) & (known[b] == dst[~node]) if n else np.zeros(len(a), dtype=bool)
    a, b = a[met], b[met]
    order = np.argsort(a, kind="stable")
    begin = np.searchsorted(a[order], np.arange(n + 1)).tolist()
    to, left = b[order].tolist(), np.bincount(b, minlength=n).tolist()
    best, letters = best.tolist(), letters.tolist()
    ready = [i for i, x in enumerate(left) if not x]
    settled = 0
    while ready:
        i = ready.pop()
        settled += 1
        done = max(best[i] + letters[i], _LOST)
        for j in to[begin[i]:begin[i + 1]]:
            if done > best[j]:
                best[j] = done
            left[j] -= 1
            if not left[j]:
                ready.append(j)
    reached = np.array(best, dtype=np.int64)[number]
    offset = pa.array(np.where(reached > _LOST // 2, reached, 0).astype(np.int32), mask=reached <= _LOST // 2)
    found = table.filter(pa.array(node))
    state = pa.array(["cycle" if settled < n else None] * len(found), pa.string())
    return pa.Table.from_arrays([found["protein_id"], found["src"], offset, state], ["protein_id", "node_id", "offset", "state"])


def _longest_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_ways_of`` rows sorted by protein; of a protein of too many rows only the name, with the state 'large'."""
    held, rows, left_out = [], 0, None

    def solved(table):
        return _ways_of(table).to_batches()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if left_out is not None:
            table = table.filter(pc.not_equal(table["protein_id"], left_out))
        held, rows = [*held, table], rows + len(table)
        if rows < min(GRAPH_AT_ONCE, 1 << 17):
            continue
        table = pa.concat_tables(held)
        last = table["protein_id"][-1]
        of_last = pc.sum(pc.equal(table["protein_id"], last)).as_py()
        whole, rest = table.slice(0, rows - of_last), table.slice(rows - of_last)
        if len(whole):
            yield from solved(whole)
        if of_last > GRAPH_AT_ONCE:
            left_out, rest = last, rest.slice(0, 0)
            nothing = [pa.nulls(1, batch.schema.field("src").type), pa.nulls(1, pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([last.as_py()], batch.schema.field(0).type), *nothing, pa.array(["large"])], ["protein_id", "node_id", "offset", "state"])
        held, rows = [rest], len(rest)
    if rows:
        yield from solved(pa.concat_tables(held))


def node_offsets(graph: Graph) -> DataFrame:
    """(protein_id, node_id, offset): letters on the longest path from the start.

    For any graph without a cycle; a cycle raises. Unreachable nodes have a null
    offset. Rows meet by protein, sorted, and a task follows the edges of one protein after
    another, each once. What a task holds is bounded: proteins of more than
    ``GRAPH_AT_ONCE`` nodes and edges go through ``_offsets_in_rounds`` together.
    """
    nodes = graph.nodes.select("protein_id", "node_id", _letters(F.col("seq"), F.col("kind")).cast("long").alias("size"), "kind")
    kind = nodes.schema["node_id"].dataType
    none = lambda t: F.lit(None).cast(t)
    rows = nodes.select("protein_id", F.col("node_id").alias("src"), none(kind).alias("dst"), "size", (F.col("kind") == "start").alias("first")).unionByName(
        graph.edges.filter("dst is not null").select("protein_id", "src", "dst", none("long").alias("size"), none("boolean").alias("first"))
    ).filter("protein_id is not null and src is not null")
    schema = f"protein_id {nodes.schema['protein_id'].dataType.simpleString()}, node_id {kind.simpleString()}, offset int, state string"
    found = written(rows.repartition("protein_id").sortWithinPartitions("protein_id").mapInArrow(_longest_ways, schema), "offsets")
    odd = {r["state"] for r in found.select("state").filter("state is not null").distinct().collect()}
    if "cycle" in odd:
        raise ValueError("offsets do not settle; the graph has a cycle")
    unnamed = nodes.filter("protein_id is null or node_id is null").select("protein_id", "node_id", none("int").alias("offset"))
    offsets = found.filter("state is null").drop("state").unionByName(unnamed)
    if "large" not in odd:
        return offsets
    large = found.filter("state = 'large'").select("protein_id")
    parts = Graph(*(x.join(large, "protein_id", "left_semi") for x in (graph.nodes.filter("node_id is not null"), graph.edges)))
    return offsets.unionByName(_offsets_in_rounds(parts))


def _offsets_in_rounds(graph: Graph) -> DataFrame:
    """``node_offsets`` of graphs of any size.

    All proteins shrink at once: parallel edges merge into the longest, nodes
    that are entered alike become one, and a node that is entered from one place only
    hangs on it; chains of such nodes are followed to their ends by pointer doubling,
    and edges go on from there. Variants one after the other, and variants within
    variants, so vanish in a few steps of a logarithmic number of rounds; variants that
    cross each other add a step for each crossing in a row. The edges that enter one
    node are gathered in a row.
    """
    nodes = graph.nodes.select("protein_id", "node_id", _letters(F.col("seq"), F.col("kind")).cast("long").alias("size"), "kind")
    sized = nodes.select("protein_id", F.col("node_id").alias("src"), F.col("size").alias("w"))
    inside = graph.edges.select("protein_id", "src", "dst").join(sized, ["protein_id", "src"]).select("protein_id", "src", F.col("dst").alias("dst"), "w")
    entered = inside.select("protein_id", F.col("dst").alias("node_id")).distinct().withColumn("entered", F.lit(True))
    # a null source is where all ways begin
    first = nodes.join(entered, ["protein_id", "node_id"], "left").filter("kind = 'start' or entered is null").select(
        "protein_id", F.lit(None).cast(nodes.schema["node_id"].dataType).alias("src"), F.col("node_id").alias("dst"),
        F.when(F.col("kind") == "start", F.lit(0)).otherwise(F.lit(_LOST)).cast("long").alias("w"),
    )
    edges, hung = written(inside.unionByName(first), "edges"), None
    while not edges.isEmpty():
        merged = edges.groupBy("protein_id", "src", "dst").agg(F.max("w").alias("w"))
        ways = written(merged.groupBy("protein_id", "dst").agg(F.array_sort(F.collect_list(F.struct("src", "w"))).alias("ways")), "ways")
        same = ways.groupBy("protein_id", "ways").agg(F.min("dst").alias("one"))
        twin = F.col("dst") != F.col("one")
        placed = written(ways.join(same, ["protein_id", "ways"]).filter(twin | (F.size("ways") == 1)).select(
            "protein_id", F.col("dst").alias("node"), F.when(twin, F.col("one")).otherwise(F.col("ways")[0]["src"]).alias("head"),
            F.when(twin, F.lit(0)).otherwise(F.col("ways")[0]["w"]).cast("long").alias("d"),
        ), "placed")
        if placed.isEmpty():
            raise ValueError("offsets do not settle; the graph has a cycle")
        ends = _to_their_ends(placed)
        hung = ends if hung is None else hung.unionByName(ends)
        rest = ways.join(ends.select("protein_id", F.col("node").alias("dst")), ["protein_id", "dst"], "left_anti")
        rest = rest.select("protein_id", "dst", F.explode("ways").alias("way")).select("protein_id", "way.src", "dst", "way.w")
        tops = ends.select("protein_id", F.col("node").alias("src"), "head", "d", F.lit(True).alias("met"))
        edges = written(rest.join(tops, ["protein_id", "src"], "left").select(
            "protein_id", F.when(F.col("met"), F.col("head")).otherwise(F.col("src")).alias("src"), "dst", (F.col("w") + F.coalesce("d", F.lit(0))).alias("w")
        ), "edges")
    named = nodes.select("protein_id", "node_id")
    if hung is None:  # no node at all
        return named.withColumn("offset", F.lit(None).cast("int"))
    reached = F.when(F.col("d") > _LOST // 2, F.col("d")).cast("int").alias("offset")
    final = _to_their_ends(hung).select("protein_id", F.col("node").alias("node_id"), reached)
    return named.join(final, ["protein_id", "node_id"], "left")


def check_graph(graph: Graph, offsets: DataFrame, lengths: DataFrame) -> DataFrame:
    """(protein_id, problem): no start, unreachable nodes, or an end that is off the sequence length."""
    placed = graph.nodes.join(offsets, ["protein_id", "node_id"])
    per_protein = placed.groupBy("protein_id").agg(
        F.count_if(F.col("kind") == "start").alias("starts"),
        F.count_if(F.col("offset").isNull()).alias("lost"),
        F.max(F.when(F.col("kind") == "end", F.col("offset"))).alias("stop"),
    ).join(lengths.select("protein_id", "seq_len"), "protein_id", "left")
    problem = (
        F.when(F.col("starts") == 0, "no starting point")
        .when(F.col("lost") > 0, "a node was not visited")
        .when(F.col("stop") < F.col("seq_len"), "the longest path is shorter than the sequence")
        .when(F.col("stop") > F.col("seq_len"), "the longest path is longer than the sequence")
    )
    return per_protein.withColumn("problem", problem).filter("problem is not null").select("protein_id", "problem")


def position_index(graph: Graph, offsets: DataFrame | None = None) -> DataFrame:
    """(protein_id, position, node_id, letter) for every letter of every node."""
    placed = graph.nodes.withColumnRenamed("pos", "offset") if offsets is None else graph.nodes.join(offsets, ["protein_id", "node_id"])
    letters = placed.filter(~F.col("kind").isin("start", "end") & (F.length("seq") > 0))
    rows = letters.select("protein_id", "node_id", "offset", F.posexplode(F.split("seq", "")).alias("i", "letter"))
    return rows.filter("letter <> ''").select("protein_id", (F.col("offset") + F.col("i")).alias("position"), "node_id", "letter")


# ----------------------------------------------------------------- matching


def _differences(a: Column, b: Column, n: Column) -> Column:
    """In how many of the first ``n`` letters two texts differ."""
    letters = (F.split(F.substring(x, F.lit(1), n), "") for x in (a, b))
    differ = F.filter(F.zip_with(*letters, lambda x, y: x != y), lambda d: d)
    same = F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)
    return F.when(n > 0, F.when(same, F.lit(0)).otherwise(F.size(differ))).otherwise(F.lit(0))


def _starts(found: DataFrame, letters: DataFrame, longest: int) -> DataFrame:
    """(peptide, protein_id, start, node_id, at, rest, there) of the node each seed starts in.

    Seeds and nodes meet by bins of positions. A bin holds the node's letters that lie in
    it, and as many behind as the longest peptide has: no long node is shipped whole to each of its
    bins, or to each of its seeds.
    """
    size = max(BIN, longest)
    stop = F.col("offset") + F.length("seq")
    spans = letters.filter(F.length("seq") > 0).select(
        "protein_id", "node_id", "offset", "kind", "seq", F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor((stop - 1) / size))).alias("bin")
    )
    begin = F.greatest(F.col("bin") * size - F.col("offset"), F.lit(0)).cast("int")
    many = ((F.col("bin") + 1) * size - F.col("offset") - begin + longest).cast("int")
    pieces = spans.select("protein_id", "node_id", "offset", "kind", "bin", begin.alias("begin"), F.substring("seq", begin + 1, many).alias("piece"))
    seeded = found.select("protein_id", "start", "peptide", F.floor(F.col("start") / size).alias("bin"))
    at = (F.col("start") - F.col("offset")).cast("int")
    there = lambda n: F.substring("piece", F.col("at") - F.col("begin") + 1, n)
    right = there(F.lit(1)) == F.substring("peptide", 1, 1)
    met = pieces.join(seeded, ["protein_id", "bin"]).withColumn("at", at).filter("at >= 0 and at - begin < length(piece)").select(
        "peptide", "protein_id", "start", "node_id", "at", "kind", right.alias("right"), F.col("peptide").alias("rest"), there(F.length("peptide")).alias("there")
    )
    # of the nodes that go on with the right letter, the first by name, those of the reference before; all texts of that name
    first = F.min(F.when(F.col("right"), F.struct((F.col("kind") != "reference").alias("later"), F.col("node_id"), F.col("at"))))
    chosen = met.withColumn("f", first.over(Window.partitionBy("peptide", "protein_id", "start")))
    return chosen.filter("node_id = f.node_id and at = f.at").drop("f", "kind", "right")


def match_on_graph(found: DataFrame, graph: Graph, allowed_mismatches: int = 2, offsets: DataFrame | None = None) -> DataFrame:
    """(peptide, protein_id, start, mismatches, path) of the best way through the graph per seed.

    ``path`` lists (node_id, first, last) letters.  All seeds walk together: one
    round of joins per node passed, and walks with too many mismatches stop.  Of
    walks that have come to the same node with the same letters done only the best
    goes on, so their number is bounded by the states, not by the paths.  The walk
    with the fewest mismatches wins (the first by node names on ties).
    """
    if allowed_mismatches < 0:
        raise ValueError("allowed mismatches must not be negative")
    found = cut(found)
    longest = found.agg(F.max(F.length("peptide"))).first()[0] or 0
    # the size of a file is known: a few names are broadcast, and the texts of other proteins not shuffled
    seeded = written(found.select("protein_id").distinct(), "seeded")
    part = graph.of(seeded) if graph.of else Graph(*(x.join(seeded, "protein_id", "left_semi") for x in (graph.nodes, graph.edges)))
    placed = part.nodes.withColumnRenamed("pos", "offset") if offsets is None else part.nodes.join(offsets, ["protein_id", "node_id"])
    letters = cut(placed.select("protein_id", "node_id", "offset", F.when(F.col("kind").isin("start", "end"), F.lit("")).otherwise(F.col("seq")).alias("seq"), "kind"))
    here = _starts(found, letters, longest).select(
        "*", F.lit(0).alias("done"), F.lit(0).alias("mismatches"), F.array().cast("array<struct<node_id:string,first:int,last:int>>").alias("path")
    )
    finished = edges = None
    while True:
        n = F.least(F.length("rest"), F.length("there"))
        stepped = (
            here.withColumn("n", n)
            .withColumn("mismatches", F.col("mismatches") + _differences(F.col("rest"), F.col("there"), F.col("n")))
            .filter(F.col("mismatches") <= allowed_mismatches)
            .withColumn("done", F.col("done") + F.col("n"))
            .withColumn(
                "path",
                F.when(
                    F.col("n") > 0,
                    F.concat("path", F.array(F.struct("node_id", F.col("at").cast("int").alias("first"), (F.col("at") + F.col("n") - 1).cast("int").alias("last")))),
                ).otherwise(F.col("path")),
            )
            .select("peptide", "protein_id", "start", "node_id", "done", "mismatches", "path")
        )
        lightest = F.min(F.struct("mismatches", "path"))
        stepped = cut(
            stepped.groupBy("peptide", "protein_id", "start", "node_id", "done").agg(lightest.alias("w"))
            .select("peptide", "protein_id", "start", "node_id", "done", "w.mismatches", "w.path")
        )
        complete = stepped.filter(F.col("done") >= F.length("peptide")).select("peptide", "protein_id", "start", "mismatches", "path")
        finished = complete if finished is None else finished.unionByName(complete)
        open_walks = stepped.filter(F.col("done") < F.length("peptide"))
        if open_walks.isEmpty():
            break
        if edges is None:  # walks go on in their protein, and from the first letter of a node
            walked = written(open_walks.select("protein_id").distinct(), "walked")
            edges = cut(part.edges.join(walked, "protein_id", "left_semi").withColumnRenamed("src", "node_id"))
            heads = cut(letters.join(walked, "protein_id", "left_semi").select("protein_id", "node_id", F.substring("seq", 1, longest).alias("there")))
        here = open_walks.join(edges, ["protein_id", "node_id"]).drop("node_id").withColumnRenamed("dst", "node_id").join(heads, ["protein_id", "node_id"]).select(
            "peptide", "protein_id", "start", "node_id", F.lit(0).alias("at"), F.expr("substring(peptide, done + 1)").alias("rest"), "there", "done", "mismatches", "path"
        )
    best = F.min_by(F.struct("mismatches", "path"), F.struct("mismatches", "path"))
    return finished.groupBy("peptide", "protein_id", "start").agg(best.alias("b")).select("peptide", "protein_id", "start", "b.mismatches", "b.path")


def match_sequences(
    sequences: DataFrame, kept_variants: DataFrame, peptides: DataFrame, k: int, allowed_mismatches: int = 2
) -> DataFrame:
    """``match_on_graph`` from sequences, variants and peptides; only proteins with a seed get a graph."""
    found = cut(seeds(sequences, peptides, k))
    seeded = found.select("protein_id").distinct()
    graph = variation_graph(cut(sequences.join(seeded, "protein_id", "left_semi")), cut(kept_variants.join(seeded, "protein_id", "left_semi")))
    return match_on_graph(found, graph, allowed_mismatches)


def node_hits(matches: DataFrame) -> DataFrame:
    """(protein_id, node_id, first, last, peptide) intervals of the matched paths."""
    return matches.select("protein_id", "peptide", F.explode("path").alias("p")).select(
        "protein_id", F.col("p.node_id").alias("node_id"), F.col("p.first").alias("first"), F.col("p.last").alias("last"), "peptide"
    )


# ------------------------------------------------------------------ contigs


def contigs(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, last): overlapping intervals of a node merged; first <= previous last merges.

    Intervals are first reduced to the longest per start, so a node contributes at
    most one row per letter however many peptides hit it.
    """
    longest = hits.groupBy(*map(col, keys), "first").agg(F.max("last").alias("last"))
    order = Window.partitionBy(*map(col, keys)).orderBy("first")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reached.isNull() | (F.col("first") > reached), 1).otherwise(0)
    return (
        longest.withColumn("opens", opens)
        .withColumn("number", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(*map(col, keys), "number")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .select(*map(col, keys), "first", "last")
    )


def contig_peptides(hits: DataFrame, merged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, last, peptide): which peptides a contig is made of.

    Each interval is assigned by the contig its start falls into: the latest one
    at or before it, found by filling forward along the starts of a node.
    """
    starts = hits.select(*map(col, keys), F.col("first").alias("at")).distinct()
    marks = starts.join(
        merged.select(*map(col, keys), F.col("first").alias("at"), F.col("first").alias("__first"), F.col("last").alias("__last")),
        [*keys, "at"], "left",
    )
    order = Window.partitionBy(*map(col, keys)).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    homes = marks.select(
        *map(col, keys), F.col("at").alias("first"),
        F.last("__first", ignorenulls=True).over(order).alias("contig_first"),
        F.last("__last", ignorenulls=True).over(order).alias("contig_last"),
    )
    return hits.join(homes, [*keys, "first"]).select(
        *map(col, keys), F.col("contig_first").alias("first"), F.col("contig_last").alias("last"), "peptide"
    ).distinct()


def split_nodes(graph: Graph, merged: DataFrame) -> Graph:
    """Cut every node at its contigs.

    Pieces are ``<node>.<first letter>`` with ``match`` telling matched ones; edges
    run between neighbouring pieces, and from the last piece of a node to the
    first piece of its successors.  Sentinels and empty nodes stay whole.

    The pieces are written once: edges read their names only, and not the graph again.
    """
    nodes = graph.nodes
    whole = F.col("kind").isin("start", "end") | (F.length("seq") == 0)
    points = (
        nodes.filter(~whole).select("protein_id", "node_id", F.lit(0).alias("at"))
        .unionByName(merged.select("protein_id", "node_id", F.explode(F.array(F.col("first"), F.col("last") + 1)).alias("at")))
        .distinct()
    )
    following = F.lead("at").over(Window.partitionBy("protein_id", "node_id").orderBy("at"))
    marked = merged.select("protein_id", "node_id", F.col("first").alias("at"), F.lit(True).alias("match"))
    pieces = (
        points.withColumn("next", following)
        .join(nodes, ["protein_id", "node_id"])
        .filter(F.col("at") < F.length("seq"))
        .join(marked, ["protein_id", "node_id", "at"], "left")
        .select(
            "protein_id", F.col("node_id").alias("parent"), F.concat_ws(".", "node_id", F.col("at").cast("string")).alias("node_id"),
            (F.col("pos") + F.col("at")).alias("pos"),
            F.substring("seq", F.col("at") + 1, F.coalesce("next", F.length("seq")) - F.col("at")).alias("seq"),
            "kind", F.coalesce("match", F.lit(False)).alias("match"), "at",
        )
    )
    kept = nodes.filter(whole).select(
        "protein_id", F.col("node_id").alias("parent"), "node_id", "pos", "seq", "kind", F.lit(None).cast("boolean").alias("match"), F.lit(0).alias("at")
    )
    every = written(pieces.unionByName(kept), "pieces")
    order = Window.partitionBy("protein_id", "parent").orderBy("at")
    inner = every.select("protein_id", F.col("node_id").alias("src"), F.lead("node_id").over(order).alias("dst")).filter("dst is not null")
    ends = every.groupBy("protein_id", "parent").agg(
        F.min_by("node_id", "at").alias("head"), F.max_by("node_id", "at").alias("tail")
    )
    outer = (
        graph.edges.join(ends.select("protein_id", F.col("parent").alias("src"), F.col("tail")), ["protein_id", "src"])
        .join(ends.select("protein_id", F.col("parent").alias("dst"), F.col("head")), ["protein_id", "dst"])
        .select("protein_id", F.col("tail").alias("src"), F.col("head").alias("dst"))
    )
    return Graph(every.select("protein_id", "node_id", "parent", "pos", "seq", "kind", "match"), inner.unionByName(outer))


class Matched(NamedTuple):
    graph: Graph
    matches: DataFrame
    contigs: DataFrame
    peptides: DataFrame  # which peptides make up a contig
    unmatched: DataFrame


def match_peptides(sequences: DataFrame, kept_variants: DataFrame, peptides: DataFrame, k: int = 5, allowed_mismatches: int = 2) -> Matched:
    """Seeds, graph walk, contigs and split graph in one go, for every protein and peptide."""
    if k < 2:
        raise ValueError("k must be larger than 1")
    graph = variation_graph(sequences, kept_variants)
    matches = cut(match_on_graph(seeds(sequences, peptides, k), graph, allowed_mismatches))
    hits = node_hits(matches)
    merged = contigs(hits, ["protein_id", "node_id"])
    return Matched(
        split_nodes(graph, merged), matches, merged, contig_peptides(hits, merged, ["protein_id", "node_id"]),
        without_match(peptides, matches),
    )


# ------------------------------------------------------------------ summary


def peptides_per_contig(members: DataFrame, keys: list[str]) -> DataFrame:
    """Number of peptides per contig."""
    return members.groupBy(*map(col, keys), "first", "last").agg(F.count_distinct("peptide").alias("peptides"))


def peptide_range(counts: DataFrame, key: str = "protein_id") -> DataFrame:
    """Smallest and largest number of peptides of a contig per protein."""
    return counts.groupBy(col(key)).agg(F.min("peptides").alias("min_peptides"), F.max("peptides").alias("max_peptides"))


def coverage(merged: DataFrame, sequences: DataFrame, *, key: str = "protein_id", seq: str = "seq") -> DataFrame:
    """Share of a sequence's letters inside contigs of the sequence itself."""
    covered = merged.groupBy(col(key)).agg(F.sum(F.col("last") - F.col("first") + 1).alias("covered"))
    return sequences.select(col(key), F.length(col(seq)).alias("length")).join(covered, key, "left").select(
        col(key), "length", F.coalesce("covered", F.lit(0)).alias("covered"),
        F.try_divide(F.coalesce("covered", F.lit(0)).cast("double"), F.col("length")).alias("coverage"),
    )
