"""Secrets: what a pattern finds is judged by how many repositories and owners hold it.

Each text is scanned once; a finding's secret part is known by its SHA-256 only. The
hashes of the whole corpus are counted by distinct repositories and owners. A value
that several owners, or many repositories of one owner, share is a widely copied
example; one that a single owner keeps is live-looking. Findings of the sure kinds
are always reported; those of the open kinds, where a pattern alone would name far
too much, only if live-looking.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import saved

#: Sure kinds, in the order in which spans of one start are listed. Fixed patterns.
BASE = ("assign", "access", "hex")
#: Kinds that only the ownership count decides.
OPEN = ("token", "key")
KINDS = BASE + OPEN
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
_HEX = re.compile("[0-9a-f]{32,}")
_TOKEN = re.compile("[A-Za-z0-9+/_=-]{24,}")
_KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]+-----END [A-Z ]*PRIVATE KEY-----")
_WORDS = ("password", "passwd", "secret", "token", "api")
#: Characters an assigned value has at least; different ones in an open token.
SHORTEST, DIFFERENT = 8, 12
#: Most owners, and most repositories, that hold a live-looking value.
OWNERS, REPOSITORIES = 1, 3


def _mixed(value: str) -> bool:
    """Digits, capitals and small letters, and enough different characters: a generated value, not a word or a path."""
    return (
        len(set(value)) >= DIFFERENT and any("0" <= c <= "9" for c in value)
        and any("A" <= c <= "Z" for c in value) and any("a" <= c <= "z" for c in value)
    )


def findings(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret part) of a text, in code points with the end outside; by start, then kind.

    Matches of a kind don't overlap; the leftmost come first, and those that are too
    short are dropped. An open finding that overlaps a sure one is not listed.
    """
    if not text:
        return []
    found = []
    small = text.lower()
    if any(w in small for w in _WORDS):
        found += [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= SHORTEST]
    # the rest are maximal runs: those that are long enough are the matches of "+" that are
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    sure = [(s, e) for _, s, e, _ in found]
    more = [("token", *m.span(), m[0]) for m in _TOKEN.finditer(text) if _mixed(m[0])]
    if "-----BEGIN " in text:
        more += [("key", *m.span(), m[0]) for m in _KEY.finditer(text)]
    if sure and more:
        sure.sort()
        # sure spans of different kinds may overlap: the furthest end up to each start
        ends, last = [], 0
        for _, e in sure:
            last = max(last, e)
            ends.append(last)
        starts = [s for s, _ in sure]
        more = [m for m in more if not (k := bisect_left(starts, m[2])) or ends[k - 1] <= m[1]]
    found += more
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def scan(documents: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """(row, doc_id, repository, owner, found) of every row; found are (kind, start, end, hash), in order.

    Null texts hold nothing. ``row`` numbers the rows, so repeated or null ids stay apart.
    """
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.binary())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                rows.append([
                    {"kind": k, "start": s, "end": e, "hash": hashlib.sha256(secret.encode()).digest()} for k, s, e, secret in findings(text.as_py())
                ])
            at = batch.schema.get_field_index("text")
            yield batch.remove_column(at).append_column("found", pa.array(rows, spans))

    named = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(repository).cast("string").alias("repository"),
        F.col(owner).cast("string").alias("owner"), F.col("text").cast("string").alias("text"),
    )
    return named.mapInArrow(
        scanned, "row long, doc_id long, repository string, owner string, found array<struct<kind:string,start:int,end:int,hash:binary>>"
    )


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, repositories, owners): who holds each value. A repository belongs to its owner; null is a name like others.

    Distinct rows are made within tasks first, so a value that a third of all
    repositories hold is counted in parts.
    """
    held = scanned.select("repository", "owner", F.explode("found.hash").alias("hash"))
    by_owner = held.distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def judged(
    documents: DataFrame, repository: str = "doc_id", owner: str = "source", owners: int = OWNERS, repositories: int = REPOSITORIES
) -> DataFrame:
    """(doc_id, found) of every row: found are (kind, start, end, hash, live) by start, then kind.

    ``live`` says that at most ``owners`` owners and ``repositories`` repositories hold
    the value. Sure kinds are listed whatever it says, open kinds only if it is true.
    """
    scanned = saved(scan(documents, repository, owner), "findings")
    counts = ownership(scanned).withColumn("live", (F.col("owners") <= owners) & (F.col("repositories") <= repositories))
    live = counts.filter("live").select("hash")
    # a live value is held by few rows, so neither side of this join has a hot key that stays
    held = scanned.select("row", F.explode(F.array_distinct("found.hash")).alias("hash")).join(live, "hash", "left_semi")
    lists = held.groupBy("row").agg(F.collect_list("hash").alias("live"))
    marked = F.transform("found", lambda f: F.struct(
        f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"), f["hash"].alias("hash"),
        F.coalesce(F.array_contains("live", f["hash"]), F.lit(False)).alias("live"),
    ))
    listed = F.filter(marked, lambda f: f["kind"].isin(*BASE) | f["live"])
    return scanned.join(lists, "row", "left").select("doc_id", listed.alias("found"))


def _joined(found):
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts and span lists of ``judged`` rows: (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_open, n_live)."""

    def number(*kinds):
        return F.size(F.filter("found", lambda f: f["kind"].isin(*kinds))).cast("long")

    base = F.filter("found", lambda f: f["kind"].isin(*BASE))
    return found.select(
        "doc_id", *(number(k).alias(f"n_{k}") for k in BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"), number(*OPEN).alias("n_open"), F.size(F.filter("found", lambda f: f["live"])).cast("long").alias("n_live"),
    )
