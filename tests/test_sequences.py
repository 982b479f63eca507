import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators import sequences as sq
from tests.conftest import values

KEYS = ["protein_id", "node_id"]


@pytest.fixture
def graph(spark):
    """Graph from {node: letters} and edges; the first node is the start and the last the end."""

    def make(letters, edges, offsets=None):
        names = list(letters)
        kind = lambda n: "start" if n == names[0] else "end" if n == names[-1] else "reference"
        rows = [("p", n, (offsets or {}).get(n, 0), "" if kind(n) in ("start", "end") else s, kind(n)) for n, s in letters.items()]
        nodes = spark.createDataFrame(rows, "protein_id string, node_id string, pos int, seq string, kind string")
        return sq.Graph(nodes, spark.createDataFrame([("p", a, b) for a, b in edges], "protein_id string, src string, dst string"))

    return make


#: Letters by node, edges, and offsets. Own shapes: a run, a choice of three, a bridge over two nodes, and a ladder.
GRAPHS = {
    "line": (dict(zip("012", ["", "MKVLIQW", ""])), ["01", "12"], {"0": 0, "1": 0, "2": 7}),
    "choice": (
        dict(zip("0123456", ["", "TRN", "H", "YY", "P", "SG", ""])), ["01", "12", "13", "14", "25", "35", "45", "56"],
        {"0": 0, "1": 0, "2": 3, "3": 3, "4": 3, "5": 5, "6": 7},
    ),
    "bridge": (dict(zip("012345", ["", "WF", "C", "D", "QQQQ", ""])), ["01", "12", "23", "35", "14", "45"], {"0": 0, "1": 0, "2": 2, "3": 3, "4": 2, "5": 6}),
    "ladder": (
        dict(zip("01234567", ["", "A", "V", "LL", "I", "M", "K", ""])), ["01", "02", "12", "13", "23", "24", "34", "35", "45", "46", "56", "67"],
        {"0": 0, "1": 0, "2": 1, "3": 2, "4": 4, "5": 5, "6": 6, "7": 7},
    ),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_offsets_and_index(graph, spark, name):
    letters, edges, expected = GRAPHS[name]
    made = graph(letters, edges)
    offsets = sq.node_offsets(made)
    assert {r["node_id"]: r["offset"] for r in offsets.collect()} == expected
    index = {}
    for r in sq.position_index(made, offsets).collect():
        index.setdefault(r["position"], set()).add((r["node_id"], r["letter"]))
    want = {}
    for node, text in letters.items():
        for i, letter in enumerate(text):
            want.setdefault(expected[node] + i, set()).add((node, letter))
    assert index == want
    length = max(expected.values())
    good = spark.createDataFrame([("p", length)], "protein_id string, seq_len int")
    assert sq.check_graph(made, offsets, good).count() == 0
    off = spark.createDataFrame([("p", length + 1)], "protein_id string, seq_len int")
    assert "shorter" in sq.check_graph(made, offsets, off).first()["problem"]


def _longest(letters, edges):
    """Offsets by brute force: relax edges until nothing grows."""
    offset = {n: 0 if n == "0" else None for n in letters}
    for _ in letters:
        for a, b in edges:
            if offset[a] is not None:
                offset[b] = max(offset[b] if offset[b] is not None else 0, offset[a] + len(letters[a]))
    return offset


def test_offsets_of_random_graphs(spark):
    rng = random.Random(5)
    nodes, edges, want = [], [], {}
    for p in range(40):
        n = rng.randint(2, 9)
        letters = {str(i): "" if i in (0, n - 1) else rng.choice(["", "A", "KLM", "QRSTV"]) for i in range(n)}
        # some nodes are entered by none, some lie behind those
        joined = [(str(i), str(j)) for j in range(1, n) for i in range(j) if rng.random() < rng.choice([0.1, 0.3, 0.8])]
        nodes += [(f"p{p}", i, 0, t, "start" if i == "0" else "end" if i == str(n - 1) else "reference") for i, t in letters.items()]
        edges += [(f"p{p}", a, b) for a, b in joined]
        want |= {(f"p{p}", i): o for i, o in _longest(letters, joined).items()}
    made = sq.Graph(
        spark.createDataFrame(nodes, "protein_id string, node_id string, pos int, seq string, kind string"),
        spark.createDataFrame(edges, "protein_id string, src string, dst string"),
    )
    assert {(r["protein_id"], r["node_id"]): r["offset"] for r in sq.node_offsets(made).collect()} == want


def test_thousands_of_variants_in_a_row_take_few_rounds(spark, monkeypatch):
    n = 5000
    proteins = spark.createDataFrame([("P", "A" * n, n)], "protein_id string, seq string, seq_len int")
    variants = spark.range(1, n + 1).selectExpr("'P' as protein_id", "cast(id as int) as pos", "cast(id as int) as end_pos", "'A' as ref", "if(id % 3 = 0, 'CC', 'C') as alt", "'x' as note")
    made = sq.variation_graph(proteins, variants)
    cuts = []  # tables written: a round of doubling writes one, each of the two steps three
    monkeypatch.setattr(sq, "written", lambda df, label, real=sq.written: cuts.append(1) or real(df, label))
    found = {r["node_id"]: r["offset"] for r in sq.node_offsets(made).collect()}
    # every third place is two letters long on the longest path
    assert found[sq.END] == n + n // 3 and len(found) == 2 * n + 2
    assert len(cuts) <= 25


def test_unreachable_node(graph, spark):
    made = graph(dict(zip("0123", ["", "AB", "C", ""])), ["01", "13", "23"])
    lengths = spark.createDataFrame([("p", 2)], "protein_id string, seq_len int")
    assert "not visited" in sq.check_graph(made, sq.node_offsets(made), lengths).first()["problem"]


@pytest.mark.parametrize("k", [1, 2, 5, 300, 700])
def test_kmers(spark, k):
    text = "ABCDEGABCDET" * 60
    df = spark.createDataFrame([("p", text), ("q", "XY"), ("r", "")], "protein_id string, seq string")
    found = {(r["protein_id"], r["pos"]): r["kmer"] for r in sq.kmers(df, k).collect()}
    assert found == {(p, i): t[i:i + k] for p, t in (("p", text), ("q", "XY")) for i in range(len(t))}


def test_seeds(spark):
    df = spark.createDataFrame([("p", "ABCDEGABCDET")], "protein_id string, seq string")
    peptides = spark.createDataFrame([("ABCDEGA",), ("BCDET",), ("CDE",), ("DETXXX",), ("ABCDETT",)], "peptide string")
    found = sq.seeds(df, peptides, 5)
    assert sorted((r["peptide"], r["start"]) for r in found.collect()) == [("ABCDEGA", 0), ("ABCDETT", 0), ("BCDET", 7)]
    assert values(sq.without_match(peptides, found), "peptide") == ["CDE", "DETXXX"]


def _matches(graph, spark, name, seeds, allowed=2, change=None):
    letters, edges, offsets = GRAPHS[name]
    offsets = dict(offsets)
    made = graph({**letters, **(change or {})}, edges, offsets)
    found = spark.createDataFrame([(p, "p", s) for p, s in seeds], "peptide string, protein_id string, start int")
    rows = sq.match_on_graph(found, made, allowed).collect()
    return {(r["peptide"], r["start"]): ({n["node_id"]: (n["first"], n["last"]) for n in r["path"]}, r["mismatches"]) for r in rows}


def test_matches(graph, spark):
    assert _matches(graph, spark, "line", [("MKV", 0), ("IQW", 4)]) == {("MKV", 0): ({"1": (0, 2)}, 0), ("IQW", 4): ({"1": (4, 6)}, 0)}
    two = _matches(graph, spark, "choice", [("TR", 0), ("TR", 5)], change={"5": "TR"})
    assert two == {("TR", 0): ({"1": (0, 1)}, 0), ("TR", 5): ({"5": (0, 1)}, 0)}
    through = _matches(graph, spark, "choice", [("TRNYYS", 0)])
    assert through == {("TRNYYS", 0): ({"1": (0, 2), "3": (0, 1), "5": (0, 0)}, 0)}
    assert _matches(graph, spark, "line", [("MKXXI", 0)], allowed=2)[("MKXXI", 0)][1] == 2
    assert _matches(graph, spark, "line", [("MKXXI", 0)], allowed=1) == {}


def _hits(spark, rows):
    return spark.createDataFrame([("p", n, a, b, x) for n, a, b, x in rows], "protein_id string, node_id string, first int, last int, peptide string")


def test_contigs(spark):
    hits = _hits(spark, [("1", 0, 3, "ABCD"), ("1", 7, 10, "ABCD"), ("1", 5, 7, "EFA"), ("4", 12, 15, "ABCD"), ("4", 19, 22, "ABCD"), ("4", 17, 19, "EFA")])
    merged = sq.contigs(hits, KEYS)
    spans = sorted((r["node_id"], r["first"], r["last"]) for r in merged.collect())
    assert spans == [("1", 0, 3), ("1", 5, 10), ("4", 12, 15), ("4", 17, 22)]
    members = {}
    for r in sq.contig_peptides(hits, merged, KEYS).collect():
        members.setdefault((r["node_id"], r["first"]), set()).add(r["peptide"])
    assert members == {("1", 0): {"ABCD"}, ("1", 5): {"ABCD", "EFA"}, ("4", 12): {"ABCD"}, ("4", 17): {"ABCD", "EFA"}}


def test_a_nested_hit_does_not_shrink_a_contig(spark):
    merged = sq.contigs(_hits(spark, [("1", 0, 9, "a"), ("1", 2, 3, "b"), ("1", 8, 12, "c"), ("1", 14, 15, "d")]), KEYS)
    assert sorted((r["first"], r["last"]) for r in merged.collect()) == [(0, 12), (14, 15)]


@pytest.mark.parametrize("spans, pieces", [
    ([("1", 0, 1)], [("MK", True), ("VLIQW", False)]), ([("1", 5, 6)], [("MKVLI", False), ("QW", True)]), ([("1", 0, 6)], [("MKVLIQW", True)]),
    ([("1", 2, 2), ("1", 4, 5)], [("MK", False), ("V", True), ("L", False), ("IQ", True), ("W", False)]),
])
def test_split_nodes(graph, spark, spans, pieces):
    letters, edges, offsets = GRAPHS["line"]
    merged = spark.createDataFrame([("p", n, a, b) for n, a, b in spans], "protein_id string, node_id string, first int, last int")
    split = sq.split_nodes(graph(letters, edges, offsets), merged)
    nodes = [r for r in split.nodes.orderBy("pos", "node_id").collect() if r["kind"] == "reference"]
    assert [(r["seq"], r["match"]) for r in nodes] == pieces
    chain = ["0", *[r["node_id"] for r in nodes], "2"]
    assert {(r["src"], r["dst"]) for r in split.edges.collect()} == set(zip(chain, chain[1:]))


def test_split_nodes_keeps_branches(graph, spark):
    letters, edges, offsets = GRAPHS["choice"]
    merged = spark.createDataFrame([("p", "1", 1, 2), ("p", "3", 1, 1), ("p", "5", 0, 0)], "protein_id string, node_id string, first int, last int")
    split = sq.split_nodes(graph(letters, edges, offsets), merged)
    assert {(r["src"], r["dst"]) for r in split.edges.collect()} == {
        ("0", "1.0"), ("1.0", "1.1"), ("1.1", "2.0"), ("1.1", "3.0"), ("1.1", "4.0"), ("3.0", "3.1"), ("2.0", "5.0"), ("3.1", "5.0"), ("4.0", "5.0"), ("5.0", "5.1"), ("5.1", "6"),
    }


@pytest.fixture
def proteins(spark):
    return spark.createDataFrame([("p", "ABCDEGABCDET", 12)], "protein_id string, seq string, seq_len int")


def _variants(spark, rows):
    return spark.createDataFrame([("p", a, b, r, x) for a, b, r, x in rows], "protein_id string, pos int, end_pos int, ref string, alt string")


def test_variation_graph(spark, proteins):
    made = sq.variation_graph(proteins, _variants(spark, [(4, 4, "D", "V")]))
    seqs = {r["node_id"]: (r["seq"], r["pos"]) for r in made.nodes.collect()}
    assert sorted(seqs.values()) == [("", 0), ("", 12), ("ABC", 0), ("D", 3), ("EGABCDET", 4), ("V", 3)]
    named = {(seqs[r["src"]][0] or r["src"], seqs[r["dst"]][0] or r["dst"]) for r in made.edges.collect()}
    assert named == {(sq.START, "ABC"), ("ABC", "D"), ("ABC", "V"), ("D", "EGABCDET"), ("V", "EGABCDET"), ("EGABCDET", sq.END)}
    offsets = {r["node_id"]: r["offset"] for r in sq.node_offsets(made).collect()}
    assert offsets == {n: pos for n, (_, pos) in seqs.items()}  # the closed form is the longest path


def test_peptides_through_variants_and_deletions(spark, proteins):
    peptides = spark.createDataFrame([("ABC",), ("DETYYY",), ("DET",), ("ABCVEG",), ("ABCGAB",)], "peptide string")
    found = sq.match_peptides(proteins, _variants(spark, [(4, 4, "D", "V"), (4, 5, None, "")]), peptides, k=3, allowed_mismatches=0)
    got = {(r["peptide"], r["start"]): [(n["node_id"], n["first"], n["last"]) for n in r["path"]] for r in found.matches.collect()}
    assert set(got) == {("ABC", 0), ("ABC", 6), ("DET", 9), ("ABCVEG", 0), ("ABCGAB", 0)}
    assert got["ABCVEG", 0][1][0].startswith("v3_4_V")
    assert values(found.unmatched, "peptide") == ["DETYYY"]
    counts = sq.peptides_per_contig(found.peptides, KEYS)
    assert sq.peptide_range(counts).first()["max_peptides"] >= 3
    assert sq.coverage(sq.contigs(_hits(spark, [("p", 0, 2, "x"), ("p", 2, 5, "y")]), ["protein_id"]), proteins).first()["coverage"] == 0.5


def test_deletions_in_a_repeat_do_not_multiply_walks(spark):
    proteins = spark.createDataFrame([("P", "A" * 40 + "CDE", 43)], "protein_id string, seq string, seq_len int")
    gone = spark.createDataFrame([("P", i, i, "A", "", "gone") for i in range(4, 34)], "protein_id string, pos int, end_pos int, ref string, alt string, note string")
    graph = sq.variation_graph(proteins, gone)
    seeds = spark.createDataFrame([("A" * 10 + "CDE", "P", 0)], "peptide string, protein_id string, start int")
    found = sq.match_on_graph(seeds, graph, 0).collect()
    assert [(r["start"], r["mismatches"]) for r in found] == [(0, 0)]


def test_a_cycle_is_found(spark):
    nodes = spark.createDataFrame([("P", "s", 0, None, "start"), ("P", "a", 0, "AB", "reference"), ("P", "b", 2, "C", "reference")], "protein_id string, node_id string, pos int, seq string, kind string")
    edges = spark.createDataFrame([("P", "s", "a"), ("P", "a", "b"), ("P", "b", "a")], "protein_id string, src string, dst string")
    with pytest.raises(ValueError, match="cycle"):
        sq.node_offsets(sq.Graph(nodes, edges))


def test_graphs_of_seeded_proteins_give_the_same_matches(spark):
    docs = spark.createDataFrame([("a", "MKTAYIAK", 8), ("b", "GGMKSAYI", 8), ("c", "QQQQQQ", 6)], "protein_id string, seq string, seq_len int")
    found = spark.createDataFrame([("a", 3, 3, "T", "S", "x"), ("c", 1, 1, "Q", "M", "x")], "protein_id string, pos int, end_pos int, ref string, alt string, note string")
    peptides = spark.createDataFrame([("MKSAY",), ("MKTAY",), ("WWWW",)], "peptide string")
    whole = sq.match_on_graph(sq.seeds(docs, peptides, 2), sq.variation_graph(docs, found), 1)
    got = sq.match_sequences(docs, found, peptides, 2, 1)
    rows = lambda df: sorted((r["peptide"], r["protein_id"], r["start"], r["mismatches"]) for r in df.collect())
    assert rows(got) == rows(whole) == [("MKSAY", "a", 0, 0), ("MKSAY", "b", 2, 0), ("MKTAY", "a", 0, 0), ("MKTAY", "b", 2, 1)]


@pytest.mark.parametrize("at_once", [0, 500_000])
def test_offsets_take_whole_proteins_unless_too_large(spark, monkeypatch, at_once):
    monkeypatch.setattr(sq, "GRAPH_AT_ONCE", at_once)
    cuts = []
    monkeypatch.setattr(sq, "written", lambda df, label, real=sq.written: cuts.append(label) or real(df, label))
    test_offsets_of_random_graphs(spark)
    # one table for all proteins, unless some are too large for a task
    assert cuts == ["offsets"] if at_once else len(cuts) > 5


def test_offsets_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(sq, "node_offsets", sq._offsets_in_rounds)
    test_offsets_of_random_graphs(spark)
    test_thousands_of_variants_in_a_row_take_few_rounds(spark, monkeypatch)
    test_a_cycle_is_found(spark)


def test_offsets_of_repeated_and_unnamed_nodes(spark):
    nodes = [("p", "s", 0, "", "start"), ("p", "a", 0, "AB", "reference"), ("p", "a", 0, "AB", "reference"), ("p", "e", 2, "", "end"), (None, "s", 0, "", "start")]
    made = sq.Graph(
        spark.createDataFrame(nodes, "protein_id string, node_id string, pos int, seq string, kind string"),
        spark.createDataFrame([("p", "s", "a"), ("p", "s", "a"), ("p", "a", "e"), ("p", "lost", "e"), ("p", "a", "lost"), (None, "s", "e")], "protein_id string, src string, dst string"),
    )
    found = sorted((r["protein_id"] or "", r["node_id"], r["offset"]) for r in sq.node_offsets(made).collect())
    assert found == [("", "s", None), ("p", "a", 0), ("p", "a", 0), ("p", "e", 2), ("p", "s", 0)]


@pytest.mark.parametrize("k", [1, 3, 30])
def test_kmers_asked_for_are_all_found(spark, monkeypatch, k):
    monkeypatch.setattr(sq, "PART", 16)
    monkeypatch.setattr(sq, "LETTERS_AT_ONCE", 50)
    rng = random.Random(k)
    rows = [(f"p{i % 9}" if i else None, "".join(rng.choice("ABé\U0001F600\0") for _ in range(rng.randint(0, 60))) + ("\U0010FFFF" if i % 5 == 0 else "")) for i in range(20)]
    docs = spark.createDataFrame(rows, "protein_id string, seq string")
    every = sq.kmers(docs, k)
    asked = [r[0] for r in every.select("kmer").distinct().collect()][::7]
    want = sorted(map(str, every.filter(every.kmer.isin(asked)).collect()))
    table = spark.createDataFrame([(x,) for x in [*asked, None]], "kmer string")
    for among in (asked, table):
        found = sq.kmers(docs, k, among=among)
        assert sorted(map(str, found.filter(found.kmer.isin(asked)).collect())) == want
    assert sq.kmers(docs, 30, among=["never" * 6]).count() == 0


@pytest.mark.parametrize("k", [1, 5, 40])
def test_merged_kmers_are_those_of_all_rows(spark, monkeypatch, k):
    monkeypatch.setattr(sq, "PART", 16)
    monkeypatch.setattr(sq, "LETTERS_AT_ONCE", 20)
    rng = random.Random(k)
    rows = [(f"p{i % 7}" if i > 2 else None, "".join(rng.choice("ABé") for _ in range(rng.randint(0, 70))) + "\0\U0010FFFF"[: i % 3]) for i in range(24)]
    docs = spark.createDataFrame(rows, "protein_id string, seq string")
    want = sq.kmers(docs, k).groupBy("kmer").agg(F.count("*"), F.count_distinct("protein_id"), F.min("pos"))
    made = sq.kmers(docs, k, merged=True)
    found = made.groupBy("kmer").agg(F.sum("n"), F.sum("keys"), F.min("first"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_codes_are_sorted_with_their_places():
    rng = np.random.default_rng(3)
    for most in (5, 1 << 40, (1 << 62) - 1):  # the largest don't fit one number with their places
        codes = rng.integers(0, most, 3000)
        codes[:10] = most - 1
        found, order = sq._sorted(codes)
        assert np.array_equal(order, np.argsort(codes, kind="stable")) and np.array_equal(found, np.sort(codes))
    assert [len(x) for x in sq._sorted(np.zeros(0, dtype=np.int64))] == [0, 0]


def test_kmers_are_merged_by_all_tasks_of_a_shuffle(spark):
    docs = spark.createDataFrame([(f"p{i}", "ABC" * i) for i in range(30)], "protein_id string, seq string")
    made = sq.kmers(docs, 5, merged=True)
    assert {r["kmer"] for r in made.collect()} == {"ABCAB", "BCABC", "CABCA", "CABC", "ABC", "BC", "C"}
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()


def test_letters_are_looked_up_a_cache_full_at_a_time():
    parts = ["A" * n for n in (5, 16000, 0, 1) * 300]
    ranges = list(sq._batched(parts))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(len(parts)))
    assert max(sum(map(len, parts[a:b])) for a, b in ranges) < (1 << 17) + 16000


def test_graphs_of_sequences_that_share_a_name(spark):
    docs = spark.createDataFrame([("P", "AB,C", 4), ("P", "AB,C", 4), ("P", "A,", 2), (None, "A,", 2)], "protein_id string, seq string, seq_len int")
    gone = spark.createDataFrame([("P", 3, 3, ",", ";", "x"), ("P", 3, 3, ",", ";", "y"), ("Q", 1, 1, ",", ";", "x"), (None, 2, 2, ",", ";", "x")], "protein_id string, pos int, end_pos int, ref string, alt string, note string")
    made = sq.variation_graph(docs, gone)
    nodes = sorted((r["protein_id"] or "", r["node_id"], r["seq"]) for r in made.nodes.collect())
    both = [("P", sq.END, "")] * 3 + [("P", sq.START, "")] * 3
    runs = [("P", "r0", "A,")] + [("P", "r0", "AB")] * 2 + [("P", "r2", "")] + [("P", "r2", ",")] * 2 + [("P", "r3", "")] + [("P", "r3", "C")] * 2
    assert nodes == sorted([("", sq.END, ""), ("", sq.START, ""), *both, *runs, ("P", "v2_3_;", ";")])
    edges = {}
    for r in made.edges.collect():
        edges[r["src"], r["dst"]] = edges.get((r["src"], r["dst"]), 0) + 1
    assert edges == {(sq.START, "r0"): 9, ("r0", "r2"): 9, ("r0", "v2_3_;"): 3, ("r0", sq.END): 3, ("r2", "r3"): 9, ("v2_3_;", "r3"): 3, ("r3", sq.END): 6}


def test_edges_of_pieces_do_not_read_the_graph_again(spark, graph):
    merged = spark.createDataFrame([("p", "1", 1, 2)], "protein_id string, node_id string, first int, last int")
    made = graph({"0": "", "1": "ABCDE", "2": ""}, [("0", "1"), ("1", "2")])
    split = sq.split_nodes(made, merged)
    reads = split.edges.inputFiles()
    assert sorted((r["src"], r["dst"]) for r in split.edges.collect()) == [("0", "1.0"), ("1.0", "1.1"), ("1.1", "1.3"), ("1.3", "2")]
    assert reads and all("pieces-" in x for x in reads)


def test_long_nodes_are_cut_into_bins_and_edges_wait_for_walks(spark, monkeypatch):
    monkeypatch.setattr(sq, "BIN", 8)
    rng = random.Random(3)
    texts = {p: "".join(rng.choice("ABÑ😀") for _ in range(n)) for p, n in (("a", 200), ("b", 37), ("c", 8), ("d", 3))}
    docs = spark.createDataFrame([(p, s, len(s)) for p, s in texts.items()], "protein_id string, seq string, seq_len int")
    peptides = sorted({s[i:i + n] for s in texts.values() for i in (0, 1, 7, 30) for n in (2, 5, 23) if len(s) >= i + n})
    none = spark.createDataFrame([], "protein_id string, pos int, end_pos int, ref string, alt string, note string")
    found = sq.seeds(docs, spark.createDataFrame([(p,) for p in peptides], "peptide string"), 2)
    made = sq.variation_graph(docs, none)
    # no walk leaves its node, so nothing asks for an edge
    unread = made.edges.withColumn("dst", F.raise_error(F.lit("edges were read")).cast("string"))
    got = sq.match_on_graph(found, sq.Graph(made.nodes, unread), 1)
    want = [
        (x, p, i, m) for p, s in texts.items() for x in peptides for i in range(len(s) - len(x) + 1)
        if s[i:i + 2] == x[:2] and (m := sum(a != b for a, b in zip(x, s[i:]))) <= 1
    ]
    assert sorted((r["peptide"], r["protein_id"], r["start"], r["mismatches"]) for r in got.collect()) == sorted(want)
    assert all(r["path"][0].asDict() == {"node_id": "r0", "first": r["start"], "last": r["start"] + len(r["peptide"]) - 1} for r in got.collect())
    there = sq._starts(found, made.nodes.withColumnRenamed("pos", "offset"), 23).select("peptide", "there").collect()
    assert there and all(len(r["there"]) <= len(r["peptide"]) for r in there)


def test_a_graph_of_some_proteins_is_built_of_them_alone(spark):
    docs = spark.createDataFrame([("P", "AB,C", 4), ("P", "A,", 2), ("Q", "D,E", 3), (None, "F", 1)], "protein_id string, seq string, seq_len int")
    gone = spark.createDataFrame([("P", 3, 3, ",", ";", "x"), ("Q", 2, 2, ",", "", "y")], "protein_id string, pos int, end_pos int, ref string, alt string, note string")
    made = sq.variation_graph(docs, gone)
    names = spark.createDataFrame([("P",), ("R",), (None,)], "protein_id string")
    part = made.of(names)
    rows = lambda df: sorted(map(tuple, df.filter("protein_id = 'P'").collect()))
    assert rows(part.nodes) == rows(made.nodes) and rows(part.edges) == rows(made.edges)
    assert part.nodes.filter("protein_id <=> 'P'").count() == part.nodes.count() and part.edges.filter("protein_id <=> 'P'").count() == part.edges.count()
    plan = part.nodes._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Generate") < plan.index("LeftSemi")
