"""Exact and near duplicates against brute force."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from assayloom.llm import exact_dedup, near_dedup
from assayloom.llm.graph import components

SCHEMA = "doc_id long, text string"


def _normal(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def _groups(rows):
    held = collections.defaultdict(list)
    for doc_id, text in rows:
        held[_normal(text)].append((doc_id, len(text or "")))
    return held


def _exact(rows):
    out = []
    for normal, members in _groups(rows).items():
        named = [m for m in members if m[0] is not None]
        keep = min(named, key=lambda m: (-m[1], m[0]))[0] if named else None
        out += [(d, keep, len(members), hashlib.sha256(normal.encode()).hexdigest()) for d, _ in members]
    return sorted(out, key=str)


ROWS = [
    (5, "a b"), (1, "ab"), (2, "a  b"), (3, " a b"), (4, None), (6, ""), (7, " \t\n"), (8, "x" * 100_000), (9, "x" * 100_000),
    (10, "a b"), (None, "ab"), (None, "a   b"), (None, "alone"), (None, "alone"), (11, "é"), (12, "é"), (13, "twice"), (13, "twice"), (14, "aB"),
]


@pytest.mark.parametrize("bucket", [1, 2000])
def test_exact_classes_are_those_of_brute_force(spark, bucket):
    df = spark.createDataFrame([(*r, "k", 1, None) for r in ROWS], SCHEMA + ", key string, n int, kept string")
    got = exact_dedup.classes(df, bucket).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == _exact(ROWS)
    kept = collections.Counter(r["doc_id"] for r in got if r["kept"])
    assert sum(kept.values()) == len(_groups(ROWS))  # one row of each group, repeated rows or not
    stay = exact_dedup.keep_one(df, bucket)
    assert stay.columns == df.columns
    assert collections.Counter(r["doc_id"] for r in stay.collect()) == kept


def test_texts_that_share_a_key_are_told_apart(spark):
    rows = [(i, f"{'ab'[i % 2]}{i % 7}") for i in range(60)] + [(60, ""), (61, None), (62, "longer"), (63, "l onger")]
    weak = lambda normal: F.length(normal).cast("long")  # noqa: E731 - texts of a length have the same key
    df = spark.createDataFrame(rows, SCHEMA)
    index = exact_dedup.build(df, bucket=3, key=weak)
    assert sorted(r["chain"] for r in index.entries.filter("key = 2").collect()) == list(range(14))
    assert [r["key"] for r in index.shared.collect()] == [2] and index.entries.filter("text <> ''").count() == 14
    got = exact_dedup.mark(df, index, key=weak).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == _exact(rows)


def test_rows_find_their_text_through_directory_and_bytes(spark):
    df = spark.createDataFrame([(i, f"t {i % 40}") for i in range(120)], SCHEMA)
    weak = lambda normal: F.xxhash64(F.substring(normal, 2, 1))
    index = exact_dedup.build(df, bucket=2, key=weak)
    gone = index.directory.orderBy("leaf").limit(1)
    held = gone.join(index.entries, ["bucket", "depth"]).agg(F.sum("n")).first()[0]
    without = index._replace(directory=index.directory.join(gone, "leaf", "left_anti"))
    assert 0 < held < 120 and exact_dedup.mark(df, without, key=weak).count() == 120 - held
    blind = index._replace(shared=index.shared.limit(0))
    assert exact_dedup.mark(df, blind, key=weak).count() < 120


def test_the_directory_doubles_as_far_as_keys_ask(spark):
    near = lambda normal: F.substring(normal, 2, 9).cast("long")  # noqa: E731 - keys that differ in their last bits only
    df = spark.createDataFrame([(i, f"t{i}") for i in range(40)], SCHEMA)
    index = exact_dedup.build(df, bucket=4, key=near)
    assert index.bits == 62 and index.directory.count() == 10
    assert index.entries.groupBy("depth", "bucket").count().agg(F.max("count")).first()[0] == 4
    assert exact_dedup.mark(df, index, key=near).filter("kept").count() == 40


def test_buckets_split_until_they_are_small(spark):
    rows = exact_dedup.entries(spark.range(3000).selectExpr("id as doc_id", "concat('t', id) as text"))
    found, bits = exact_dedup.directory(rows, bucket=100)
    joined = exact_dedup._in_buckets(rows, found, bits)
    sizes = {(r["depth"], r["bucket"]): r["count"] for r in joined.groupBy("depth", "bucket").count().collect()}
    assert sum(sizes.values()) == 3000 and max(sizes.values()) <= 100
    leaves = found.join(rows.groupBy(exact_dedup._leading("key", bits).alias("leaf")).count(), "leaf").collect()
    for depth, bucket in sizes:  # it was overfull before its last split
        half = bits - depth + 1
        assert sum(r["count"] for r in leaves if r["leaf"] >> half == bucket >> half) > 100


def test_one_text_is_most_of_the_rows(spark):
    rows = spark.range(9000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot text' else concat('t', id) end as text")
    got = exact_dedup.classes(rows).groupBy("group_size").count().collect()
    assert {r["group_size"]: r["count"] for r in got} == {3000: 3000, 1: 6000}


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.classes(none).count() == 0 and exact_dedup.keep_one(none).count() == 0
    assert near_dedup.classes(none).count() == 0 and near_dedup.keep_one(none).count() == 0


# ------------------------------------------------------------------ near duplicates


def _shingles(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def _near(rows, size):
    sets = [(d, _shingles(t, size)) for d, t in rows]
    up = {d: d for d, _ in sets if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is None or b is None or not x or not y:
                continue
            both = len(x & y)
            if 100 * both >= 80 * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=str)


def _variants(rng, base, n, least, most):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(least, most)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
        out.append(" ".join(words))
    return out


def _corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(80)]
    for _ in range(4):
        base = [word() for _ in range(rng.randint(60, 200))]
        texts += _variants(rng, base, 12, 0, 5)
    base = [word() for _ in range(120)]
    texts += _variants(rng, base, 300, 1, 4)  # a crowd around the threshold: many are linked through others only
    passage = " ".join(word() for _ in range(60))
    texts += [f"{passage} {' '.join(word() for _ in range(rng.randint(5, 60)))}" for _ in range(150)]
    texts += texts[:40] + [t.upper() for t in texts[80:90]]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, size, tile", [(1, 4, 128), (2, 5, 16)])
def test_components_are_those_of_brute_force(spark, monkeypatch, seed, size, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rows = _corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = near_dedup.classes(df, size=size).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str) == _near(rows, size)


@pytest.mark.parametrize("word", ["other72002", "other79974"])
def test_bands_that_agree_in_half_of_their_bits_hide_no_link(spark, word):
    import numpy as np

    words = [f"base{i}" for i in range(8)]
    a, b = near_dedup._series(near_dedup.BANDS * near_dedup.ROWS)
    hashes = np.array([near_dedup.Shingles(1).of(w)[0] for w in [*words, word]])
    every = hashes[:, None] * a + b
    x, y = (near_dedup._signature(h, a, b).reshape(near_dedup.BANDS, -1) for h in (hashes[:-1], hashes))
    shared = (x == y).all(axis=1)
    half = ((x & 0xFFFF) == (y & 0xFFFF)).all(axis=1)
    assert half[0] and not shared[0]
    # each bucket that both are in has a smaller id that is similar to neither
    least = every[:-1].argmin(axis=0).reshape(near_dedup.BANDS, -1)
    rows = [(int(k), " ".join(words[i] for i in sorted(set(least[k])))) for k in np.nonzero(shared)[0]]
    rows += [(100, " ".join(words)), (101, " ".join([*words, word]))]
    got = near_dedup.classes(spark.createDataFrame(rows, SCHEMA), size=1).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str) == _near(rows, 1)
    assert {r["doc_id"]: r["component_id"] for r in got}[101] == 100


def test_pairs_of_tiles_of_a_bucket_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 2)
    monkeypatch.setattr(near_dedup, "SPAN", 3)
    sizes = {1: 1, 2: 5, 3: 40}  # members of a bucket
    rows = [(k, 0, n, t, [k * 100 + t]) for k, n in sizes.items() for t in range(-(-n // 2))]
    packed = spark.createDataFrame(rows, "key long, band int, n long, tile int, members array<long>")
    met = near_dedup._meetings(packed).collect()
    want = {(k, a, b) for k, n in sizes.items() for a in range(-(-n // 2)) for b in range(a, -(-n // 2))}
    assert len(met) == len(want) and {(r["key"], r["ta"], r["tb"]) for r in met} == want
    assert all(list(r["left"]) == [r["key"] * 100 + r["ta"]] and list(r["right"]) == [r["key"] * 100 + r["tb"]] for r in met)
    unit = collections.Counter((r["key"], r["sa"], r["sb"]) for r in met)
    assert max(unit.values()) <= 9 and sum(k == 3 for k, _, _ in unit) == 28


@pytest.mark.parametrize("span", [1, 2])
def test_spans_of_tiles_lose_no_link(spark, monkeypatch, span):
    monkeypatch.setattr(near_dedup, "TILE", 8)
    monkeypatch.setattr(near_dedup, "SPAN", span)
    rows = _corpus(3)
    got = near_dedup.classes(spark.createDataFrame(rows, SCHEMA).repartition(4), size=4).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str) == _near(rows, 4)


def test_near_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (None, "one two"), (None, None),
        (7, long), (8, long + " more"), (9, "É a b c"), (10, "é a b c"), (11, "a b c d"), (12, "twice it is said"), (12, "twice it is said"),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", id int, Component string")
    got = near_dedup.classes(df, size=4).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str) == _near(rows, 4)
    stay = near_dedup.keep_one(df, size=4)
    assert stay.columns == df.columns
    ids = [r["doc_id"] for r in stay.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 7, 9, 10, 11, 12] and ids.count(None) == 2


def test_enough_matches_miss_few():
    import math

    least = near_dedup.least_matches()
    for i, m in enumerate(least):
        n = near_dedup.BATCH * (i + 1)
        missed = sum(math.comb(n, k) * 0.8 ** k * 0.2 ** (n - k) for k in range(m))
        assert missed < 2e-6
    assert least[-1] > 0.55 * near_dedup.HASHES


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]} | {300: 300, 301: 300, 302: 300}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
