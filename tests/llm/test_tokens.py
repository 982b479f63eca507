"""Byte-level BPE and packing against the libraries and brute force."""

import collections
import hashlib
import random
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayloom.llm import bpe, packing

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LETTERS = list("ab  \t\n\r\x0b\x1c\x85  'sStreé9½²٣!?.-_中文字😀éßẞÅΣςİ́̈ `;") + ["'ll", "<|endoftext|>", "the ", "ing"]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tokens():
    return packing.Tokens(WORDS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(LETTERS), max_size=60).map("".join) | st.text(max_size=60))
def test_ids_are_those_of_the_library(library, codec, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 9_000, "é" * 9_000, " " * 20_000, "!?" * 5_000, "中" * 3_000])
def test_long_matches(library, codec, text):
    assert codec.encode(text) == library.encode_ordinary(text)


def _slow(piece, ranks):
    parts = [bytes([b]) for b in piece]
    if piece in ranks:
        return [ranks[piece]]
    while len(parts) > 1:
        pairs = [(ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(pairs)
        if rank == 1 << 60:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_one_tree_and_many_trees_merge_as_brute_force_does(codec):
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"aabbc \xc3\xa9theringon") for _ in range(rng.randint(1, 64))) for _ in range(600)]
    assert all(bpe.merge(p, codec.ranks) == _slow(p, codec.ranks) for p in pieces)
    short = [p for p in pieces if len(p) > 1 and p not in codec.ranks]
    assert bpe.merge_many(short, codec.pairs) == [_slow(p, codec.ranks) for p in short]
    assert bpe.merge_many([], codec.pairs) == []


def test_a_byte_without_token_raises():
    ranks = {b"a": 0, b"b": 1, b"ab": 2}
    with pytest.raises(KeyError):
        bpe.merge(b"ax", ranks)
    with pytest.raises(KeyError):
        bpe.merge_many([b"ax"], bpe.Pairs(ranks))


@pytest.fixture
def edges(spark):
    rows = [(None, "no id"), (1, None), (2, ""), (3, "word " * 9000), (4, "twice"), (4, "twice"), (5, "Ünïcode 中文")]
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, ids string, length int")


def test_round_trip_rows(spark, edges, library):
    rows = bpe.round_trip(edges, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for r in edges.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert bpe.round_trip(edges.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_columns_of_ids_and_bytes(edges):
    coded = bpe.encode(edges, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(coded, RANKS, public_tokenizers.PATTERN).collect()
    assert all(bytes(r["data"]) == (r["text"] or "").encode() for r in back)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(LETTERS), max_size=60).map("".join) | st.text(max_size=60))
def test_word_ids_are_those_of_the_library(tokens, text):
    want = tokens.tokenizer.encode(text, add_special_tokens=False).ids
    assert b"".join(i.to_bytes(4, "little") for i in want) == tokens.batch([text])[0]


@pytest.mark.parametrize("text", [
    "a <|endoftext|> b", "<|startoftext|>", "É<|endoftext|><|startoftext|>ünï Σ", "中<|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "it's<|endoftext|>'s " * 3,
])
def test_added_tokens_in_a_text_are_found_as_the_library_does(tokens, text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    plain, got = tokens.batch(["plain text", text])
    assert got == b"".join(i.to_bytes(4, "little") for i in want)
    assert plain == tokens.batch(["plain text"])[0]


def test_byte_letters_are_those_of_the_library():
    from tokenizers.pre_tokenizers import ByteLevel

    assert sorted(packing.byte_letters()) == sorted(ByteLevel.alphabet())


def _sequences(plan):
    held, used = collections.defaultdict(list), collections.Counter()
    for size, first, rows, copies, sequence, offset in plan:
        assert first == used[size]
        used[size] += rows
        for k in range(rows):
            held[sequence + k // copies].append((offset + k % copies * size, size))
    return held, used


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(0, 30), max_size=25))))
def test_plans_are_gapless_whole_and_within_capacity(case):
    capacity, histogram = case
    held, used = _sequences(packing.arrange(histogram, capacity))
    assert used == collections.Counter({s: n for s, n in histogram.items() if n})
    for items in held.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= capacity
        assert sum(3 * size > capacity for _, size in items) <= 2
    total = sum(s * n for s, n in histogram.items())
    assert len(held) <= 1.34 * -(-total // capacity) + 1 or len(held) <= sum(n for s, n in histogram.items() if 2 * s > capacity) + total // capacity + 1


def test_best_fit_takes_the_tightest_gap():
    held, _ = _sequences(packing.arrange({7: 1, 8: 1, 2: 1, 3: 1}, 10))
    assert sorted(sorted(s for _, s in v) for v in held.values()) == [[2, 8], [3, 7]]


def test_packed_rows(spark, edges, tokens):
    rows = packing.pack(edges, WORDS, capacity=64).collect()
    ids = collections.Counter()
    whole = {}
    for r in edges.collect():
        data = tokens.batch([r["text"]])[0] + (1).to_bytes(4, "little")
        whole[r["doc_id"]] = data
        ids[r["doc_id"]] += -(-len(data) // 256)
    assert collections.Counter(r["doc_id"] for r in rows) == ids
    held = collections.defaultdict(list)
    for r in rows:
        data = whole[r["doc_id"]]
        part = data[4 * r["start"]:4 * (r["start"] + r["length"])]
        assert r["start"] == 64 * r["piece"] and r["ids_crc32"] == zlib.crc32(part)
        assert r["length"] == 64 or 4 * (r["start"] + r["length"]) == len(data)
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in held.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= 64
    assert packing.pack(edges.limit(0), WORDS).count() == 0


def test_many_pieces_of_one_length_use_each_place_once(spark):
    many = spark.range(3000).selectExpr("id as doc_id", "'same text' as text")
    rows = packing.pack(many, WORDS, capacity=10).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3000
    assert len({r["sequence_id"] for r in rows}) == 1000
