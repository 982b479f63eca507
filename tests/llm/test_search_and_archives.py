"""Top-k search, web archives and licence scans against brute force."""

import base64
import collections
import gzip
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from assayloom.llm import licences, topk, warc

FLOATS = "vec_id long, embedding array<float>, label int, score string"


def _whole(rows):
    import numpy as np

    out = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        out.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    return out


def _best(rows, k, every):
    out = []
    vectors = _whole(rows)
    for q, v in vectors:
        if q % every:
            continue
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def _search(spark, rows, k, every):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], FLOATS).repartition(3)
    vectors = topk.whole_vectors(df, "vec_id", "embedding")
    return sorted(map(tuple, topk.search(vectors, vectors.filter(f"id % {every} = 0"), k).collect()))


@pytest.mark.parametrize("seed, scale, block", [(1, 1.0, 2048), (2, 30.0, 7), (3, 0.004, 16)])
def test_best_are_those_of_brute_force(spark, monkeypatch, seed, scale, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-scale, scale) for _ in range(8)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # ties
    assert _search(spark, rows, 5, 10) == _best(rows, 5, 10)


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.25]), (10, [1.0, nan]), (20, None), (None, [1.0, 1.0]), (30, [inf, 0.0]), (40, [0.1, None]), (50, []),
        (1, [0.5, -0.25]), (2, [-1.0, -1.0]), (60, [0.5, 0.5, 0.5]), (70, [0.0, 0.0]), (3, [0.0, 0.0]),
    ]
    assert _search(spark, rows, 5, 10) == _best(rows, 5, 10)  # fewer than five candidates, another dimension, zeros
    assert _search(spark, rows[1:3], 5, 10) == []
    assert _search(spark, [], 5, 10) == []
    assert _search(spark, [(0, [1.0])], 5, 10) == []


def test_repeated_queries_are_answered_each(spark):
    rows = [(0, [1.0]), (0, [1.0]), (1, [2.0])]
    assert _search(spark, rows, 5, 10) == [(0, 1, 1, 256 * 512)] * 2


def test_scores_beyond_doubles_are_exact():
    import numpy as np

    a = np.array([[2 ** 30, 1]], dtype=np.int64)
    assert topk._scores(a, np.array([[2 ** 30, 1]], dtype=np.int64))[0, 0] == 2 ** 60 + 1


def test_large_finite_components_end_no_query(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e38, 0.0]), (2, [3.0, -1.0]), (50, [-1e38, 1e38]), (4, [2.0 ** 21, 0.0]), (10, [2.0 ** 22, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], FLOATS)
    assert [r["id"] for r in topk.too_large(df, "vec_id", "embedding").orderBy("id").collect()] == [1, 10, 50]
    kept = [r for r in rows if r[0] not in (1, 10, 50)]
    assert _search(spark, rows, 5, 10) == _best(kept, 5, 10)
    doubles = spark.createDataFrame([(0, [1e300]), (1, [1.0]), (2, [-1e300]), (10, [2.0])], "id long, v array<double>")
    vectors = topk.whole_vectors(doubles, "id", "v")
    assert topk.search(vectors, vectors.filter("id % 10 = 0"), 5).collect() == [(10, 1, 1, 512 * 256)]


# ------------------------------------------------------------------ archives

PAGES = [
    (1, "http://a.example/x y\r\nWARC-Type: fake", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b.example", "<p>one</p>"),
    (4, "http://c.example/é", ""), (5, "http://d.example", None), (6, "http://e.example", "ünï\r\n\r\nWARC/1.1\r\n" * 20_000), (None, "http://f.example", "<p>one</p>"),
    (None, "http://g.example", "only here"), (7, "http://h.example", "twice"), (7, "http://h.example", "twice"),
]
SCHEMA = "page_id long, url string, html string, digest string, holder int"


def _pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA).repartition(3)


def _records(rows, least=0):
    groups = collections.defaultdict(list)
    for page_id, _, html in rows:
        groups[(html or "").encode()].append(page_id)
    out = []
    for data, ids in groups.items():
        holder = max((i for i in ids if i is not None), default=None)
        for i in ids:
            other = i != holder and holder is not None and len(data) >= least and len(ids) > 1
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            out.append((i, len(data), digest, "revisit" if other else "response", holder if other else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 8])
def test_archives_round_trip(spark, least):
    got = warc.archive(_pages(spark), least).collect()
    rows = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got]
    assert sorted(rows, key=str) == _records(PAGES, least)
    texts = {r[0]: (r[2] or "").encode() for r in PAGES}
    assert all(bytes(r["payload"]) == texts[r["page_id"]] for r in got if r["record_type"] == "response" and r["page_id"] is not None)
    assert all(r["payload"] is None for r in got if r["record_type"] == "revisit")


@pytest.mark.parametrize("url", ["http://a.example/?" + "q" * 200_000, "http://a.example/" + "中" * 200_000])
def test_urls_may_be_long(spark, url):
    from urllib.parse import unquote

    rows = [(1, url, "<p>one</p>"), (2, "http://b.example", "<p>two</p>")]
    got = {r["page_id"]: r for r in warc.archive(_pages(spark, rows)).collect()}
    assert unquote(got[1]["url"]) == url and bytes(got[1]["payload"]) == b"<p>one</p>"
    assert got[2]["url"] == "http://b.example" and bytes(got[2]["payload"]) == b"<p>two</p>"


def test_no_pages(spark):
    assert warc.archive(_pages(spark, [])).count() == 0


def test_each_record_is_a_member_and_archives_are_cut(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 15)
    made = warc.write(warc.plan(_pages(spark)), str(tmp_path)).collect()
    assert len(made) > 3 and sum(r["records"] for r in made) == len(PAGES)
    for r in made:
        data = open(r["path"], "rb").read()
        assert len(data) == r["bytes"] and data.count(b"\x1f\x8b\x08") >= r["records"]
        assert gzip.decompress(data).count(b"WARC-Record-ID: ") == r["records"]


def test_archives_are_dealt_out_to_many_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200)
    rows = [(i, "http://x", f"<p>{i}</p>" * 20) for i in range(200)]
    made = warc.write(warc.plan(_pages(spark, rows)), str(tmp_path))
    assert made.count() > 60
    read = warc.read(made)
    assert read.select(F.spark_partition_id()).distinct().count() > 50
    assert sorted(r["page_id"] for r in read.collect()) == list(range(200))


def _member(change=lambda data: data):
    import zlib

    data = zlib.decompress(warc.record(1, "http://x", b"payload", None, "2020-01-01T00:00:00Z"), 31)
    return change(data)


@pytest.mark.parametrize("change", [
    lambda d: d.replace(b"payload\r\n", b"paxload\r\n"), lambda d: d[:-4], lambda d: d + b"x", lambda d: d.replace(b"WARC/1.1", b"HTTP/1.1", 1),
    lambda d: d.replace(b"\r\n\r\n", b"\r\n"),
])
def test_broken_records_raise(change):
    assert warc.parse(_member())["payload"] == b"payload"
    with pytest.raises((warc.Broken, ValueError, KeyError)):
        warc.parse(_member(change))


def test_members_are_read_piece_by_piece(monkeypatch):
    import io

    monkeypatch.setattr(warc, "READ", 7)
    records = [warc.record(i, None, b"x" * i * 50, None, "2020-01-01T00:00:00Z") for i in range(4)]
    assert [warc.parse(m)["page_id"] for m in warc._members(io.BytesIO(b"".join(records)))] == [0, 1, 2, 3]
    with pytest.raises(warc.Broken):
        list(warc._members(io.BytesIO(b"".join(records)[:-3])))


# ------------------------------------------------------------------ licences

MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.
"""


@pytest.mark.parametrize("text, want", [
    (MIT, ["MIT"]), (GPL, ["GPL-2.0-or-later"]), (MIT + "\n" + GPL, ["GPL-2.0-or-later", "MIT"]),
    ("words and words.\nReleased under the MIT License.", ["MIT"]), ("words without a mark\nReleased under the MIT License.\nmore", ["MIT"]),
    ("Licensed under CC BY-NC 4.0.\nThe end.", ["CC-BY-NC-4.0"]), ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3. Yes.", ["GPL-3.0-only"]),
    ("We talk of the MIT License here, no more.", []), ("", []), (None, []), ("Released under the MIT Licence", ["MIT"]),
])
def test_licences_of_texts(text, want):
    book = licences.Book.of()
    assert sorted({m[0] for m in licences.match(licences.identify(text, book), book)}) == want


def test_each_known_sentence_is_found_alone():
    book = licences.Book.of()
    for name, wordings in licences.SENTENCES.items():
        for wording in wordings:
            assert [f[0] for f in licences.identify(f"some words.\n{wording}.\nother words.", book)] == [name], wording


def test_rules_follow_the_order_and_take_a_sentence_once():
    book = licences.Book.of({"a": ("aa",), "b": ("bb",)}, (("AB", ("a", "b")), ("A", ("a",)), ("B", ("b",))))
    hits = lambda t: [m[0] for m in licences.match(licences.identify(t, book), book)]
    assert hits("aa. bb. xx. bb. aa.") == ["AB", "B", "A"]
    assert hits("aa. zz. bb.") == ["AB"] and hits("bb. aa.") == ["B", "A"]


def _slow_identify(text, book):
    """All joins of neighbouring sentences and all ends of a sentence, each normalised as a whole."""
    spans, found, i = list(licences.sentences(text)), [], 0
    while i < len(spans):
        start, stop = spans[i]
        hits = []
        for j in range(i, len(spans)):
            plain = " ".join(p for s, e in spans[i:j + 1] if (p := licences.normalise(text[s:e])))
            if plain in book.known and licences.normalise(text[start:stop]) and licences.normalise(text[slice(*spans[j])]):
                hits.append((j, (book.known[plain], start, spans[j][1])))
        if hits:
            found.append(hits[-1][1])
            i = hits[-1][0] + 1
            continue
        at = start
        while "\n" in text[start:stop] and at < stop:
            end = text.find("\n", at, stop)
            end = stop if end < 0 else end
            if end < stop and (name := book.known.get(licences.normalise(text[at:stop]))):
                found.append((name, at, stop))
                break
            if name := book.known.get(licences.normalise(text[at:end])):
                found.append((name, at, end))
            at = end + 1
        i += 1
    return found


@pytest.mark.parametrize("seed", range(30))
def test_sentences_are_those_of_brute_force(seed):
    rng = random.Random(seed)
    book = licences.Book.of({"a": ("red, green. Blue",), "b": ("green",), "c": ("blue. Red: green; blue! Red? yellow. Green",), "d": ("red / green",), "e": ("no - no",)}, ())
    words = ["red", "green", "blue", "yellow", "no", "Red:", "green;", "blue.", "Red?", "-", "/", "--", "...", "# red", "* green", "no -"]
    for _ in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "\n", ". ", "\n\n", "   \n \t", "! "]) for _ in range(rng.randint(0, 25)))
        assert licences.identify(text, book) == _slow_identify(text, book), text
    true = licences.Book.of()
    parts = [w for ws in licences.SENTENCES.values() for w in ws] + ["Some words", "Copyright 2020 me"]
    text = "".join(rng.choice(parts) + rng.choice([". ", ".\n", "\n", "\n\n", ": "]) for _ in range(20))
    assert licences.identify(text, true) == _slow_identify(text, true)


def test_white_space_of_any_length_hides_no_licence():
    book = licences.Book.of()
    grant = licences.SENTENCES["mit-grant"][0]
    notice = licences.SENTENCES["mit-notice"][0]
    for gap in (" ", "\n" + " " * 40, "\t" * 300, " \n"):
        text = f"words before.\n\n{gap.join(grant.split())}:\n{gap.join(notice.split())}.\nwords after."
        assert [f[0] for f in licences.identify(text, book)] == ["mit-grant", "mit-notice"], repr(gap)
    long = "lorem ipsum\n" * 100_000 + "MIT License"
    assert [f[0] for f in licences.identify(long, book)] == ["mit-title"]
    assert licences.identify("-----\n" * 100_000, book) == []


def test_scanned_rows(spark):
    rows = [(None, MIT), (1, None), (2, ""), (3, "word " * 40_000 + "\nReleased under the MIT License.\n"), (4, MIT), (4, MIT)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, licences string, matches int")
    got = licences.scan(df).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by[None]["licences"] == by[3]["licences"] == by[4]["licences"] == ["MIT"]
    assert by[1]["licences"] == by[2]["licences"] == [] and by[1]["matches"] == []
    assert by[4]["sentences"] == ["mit-title", "mit-grant", "mit-notice", "as-is-mit", "liability-mit"]
    m = by[4]["matches"][0]
    assert m["start"] == 0 and m["stop"] <= len(MIT) and m["sentences"] == 5
    assert licences.scan(df.limit(0)).count() == 0


def test_planted_licence_lines_are_all_found(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = {r["doc_id"]: r["licences"] for r in licences.scan(docs).collect()}
    lines = {
        "MIT": r"(?m)^Released under the MIT License\.$", "Apache-2.0": r"(?m)^Licensed under the Apache License, Version 2\.0\.$",
        "CC-BY-NC-4.0": r"(?m)^Licensed under CC BY-NC 4\.0\.$", "GPL-3.0-only": r"(?m)^This work is licensed under the GNU General Public License, version 3\.$",
    }
    for r in docs.collect():
        want = sorted(k for k, p in lines.items() if re.search(p, r["text"] or ""))
        assert [x for x in found[r["doc_id"]] if x in lines] == want, r["doc_id"]
