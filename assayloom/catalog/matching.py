"""Sequences and peptides: documents are the sequences, benchmark passages the peptides."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.catalog import views as v
from assayloom.catalog.registry import query
from assayloom.operators import sequences
from assayloom.plans.storage import cut, scratch_path

KEYS = ["protein_id", "node_id"]


def _sequences(spark, folder, dealt_out=True):
    docs = v.table(spark, folder, "documents").select("doc_id", "text").filter("text <> ''")
    if dealt_out:  # every letter becomes a k-mer: texts are dealt out to all tasks of a shuffle, however few files they come in
        docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return docs.select(F.col("doc_id").cast("string").alias("protein_id"), F.col("text").alias("seq"), F.length("text").alias("seq_len"))


def _passages(spark, folder):
    return v.table(spark, folder, "benchmark").select(F.col("text").alias("peptide")).distinct()


def _sentences(spark, folder):
    parts = v.table(spark, folder, "benchmark").select(F.explode(F.split("text", r"\. ")).alias("peptide"))
    return parts.distinct()


def _commas(spark, folder):
    """Every comma of every document may also be a semicolon."""
    found = sequences.kmers(_sequences(spark, folder), 1, among=[","]).filter("kmer = ','")
    pos = (F.col("pos") + 1).cast("int")
    return found.select(
        "protein_id", pos.alias("pos"), pos.alias("end_pos"), F.lit(",").alias("ref"), F.lit(";").alias("alt"), F.lit(", -> ;").alias("note")
    )


def _no_variants(spark, folder):
    return _commas(spark, folder).filter("alt is null")


# ---------------------------------------------------------------- flat files

_LETTERS = """d as (select doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') q from documents)"""


def _entries(spark, folder):
    """Documents written as UniProt text entries, and read back."""
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    docs = v.table(spark, folder, "documents").select("doc_id", letters.alias("q"))
    number = F.col("doc_id").cast("string")
    note = (
        F.when(F.col("doc_id") % 5 == 0, "Missing (in a strain)").when(F.col("doc_id") % 5 == 1, "A -> KV (in a strain)")
        .when(F.col("doc_id") % 5 == 2, "odd text").otherwise("AB -> K (in a strain)")
    )
    wrapped = F.regexp_replace(F.regexp_replace("q", "(.{10})", "$1 "), "(.{66})", "$1\n     ")
    text = F.concat(
        F.lit("ID   X_"), number, F.lit("\nAC   D"), number, F.lit("; Z9;\nFT   CHAIN           1..9\nFT   VARIANT         3..4\nFT                   /note=\""), note,
        F.lit("\"\nSQ   SEQUENCE   "), F.length("q").cast("string"), F.lit(" AA;  1 MW;  X CRC64;\n     "), wrapped, F.lit("\n//"),
    )
    path = scratch_path(spark, "entries")
    docs.select(text.alias("value")).write.text(path)
    return sequences.read_flat_files(spark, path)


@query("seq1_sequences", f"with {_LETTERS} select 'D' || doc_id as protein_id, md5(q) as seq, length(q) as seq_len from d where q <> ''")
def seq1(spark, folder):
    return sequences.proteins(_entries(spark, folder)).withColumn("seq", F.md5("seq"))


@query("seq1_incomplete_entries", f"with {_LETTERS} select 'D' || doc_id as protein_id, 'no sequence' as reason from d where q = ''")
def seq1_incomplete(spark, folder):
    return sequences.incomplete_entries(_entries(spark, folder))


@query("seq2_kept_variants", """select 'D' || doc_id as protein_id, 3 as pos, 4 as end_pos, case when doc_id % 5 > 2 then 'AB' end as ref,
   case when doc_id % 5 = 0 then '' when doc_id % 5 > 2 then 'K' end as alt from documents where doc_id % 5 <> 1""")
def seq2(spark, folder):
    return sequences.split_variants(sequences.variants(_entries(spark, folder)))[0].drop("note")


@query("seq2_dropped_variants", "select 'D' || doc_id as protein_id, 'A' as ref, 'KV' as alt from documents where doc_id % 5 = 1")
def seq2_dropped(spark, folder):
    return sequences.split_variants(sequences.variants(_entries(spark, folder)))[1].select("protein_id", "ref", "alt")


# --------------------------------------------------------------------- seeds


def _kmers_sql(k: int) -> str:
    return f"km as (select cast(doc_id as varchar) d, unnest(range(length(text))) i, text from documents where text <> ''), ki as (select d, i, substr(text, i + 1, {k}) s, length(text) n from km)"


@query("seq3_kmer_index", f"with {_kmers_sql(5)} select s as kmer, count(*) as n, count(distinct d) as proteins, min(i) as first from ki group by 1")
def seq3(spark, folder):
    found = sequences.kmers(_sequences(spark, folder), 5, merged=True)
    return found.groupBy("kmer").agg(F.sum("n").alias("n"), F.sum("keys").alias("proteins"), F.min("first").alias("first"))


_SEEDS = _kmers_sql(30) + """, pp as (select distinct text p from benchmark),
 sd as (select p, d, i from pp join ki on substr(p, 1, 30) = s where i + length(p) <= n)"""


@query("seq4_seeds", f"with {_SEEDS} select p as peptide, d as protein_id, i as start from sd")
def seq4(spark, folder):
    found = sequences.seeds(_sequences(spark, folder), _passages(spark, folder), 30)
    return found.select("peptide", "protein_id", F.col("start").cast("long").alias("start"))


@query("seq4_without_seed", f"with {_SEEDS} select p as peptide from pp where p not in (select p from sd)")
def seq4_none(spark, folder):
    passages = _passages(spark, folder)
    return sequences.without_match(passages, sequences.seeds(_sequences(spark, folder), passages, 30))


# --------------------------------------------------------------------- graph

_BORDERS = """cm as (select cast(doc_id as varchar) d, length(text) n, list_filter(range(length(text)), lambda i: substr(text, i + 1, 1) = ',') c from documents where text <> ''),
 bb as (select d, n, c, list_distinct(list_concat([0, n], c, list_transform(c, lambda i: i + 1))) b from cm)"""


@query("seq5_graph_sizes", f"""with {_BORDERS} select d as protein_id, len(b) - 1 as runs, len(c) as variants, cast(list_sum(list_transform(b, lambda z:
   case when z = 0 then 1 + list_contains(c, 0)::int when z = n then 1 + list_contains(c, n - 1)::int
        else (1 + list_contains(c, z - 1)::int) * (1 + list_contains(c, z)::int) end)) as bigint) as edges from bb""")
def seq5(spark, folder):
    graph = sequences.variation_graph(_sequences(spark, folder), _commas(spark, folder))
    nodes = graph.nodes.groupBy("protein_id").agg(
        F.count_if(F.col("kind") == "reference").alias("runs"), F.count_if(F.col("kind") == "variant").alias("variants")
    )
    return nodes.join(graph.edges.groupBy("protein_id").agg(F.count("*").alias("edges")), "protein_id")


@query("seq6_position_index", """select cast(doc_id as varchar) as protein_id, length(text) + length(text) - length(replace(text, ',', '')) as letters,
   length(text) - length(replace(text, ',', '')) as alternatives from documents where text <> ''""")
def seq6(spark, folder):
    graph = sequences.variation_graph(_sequences(spark, folder), _commas(spark, folder))
    return sequences.position_index(graph).groupBy("protein_id").agg(
        F.count("*").alias("letters"), F.count_if(F.col("letter") == ";").alias("alternatives")
    )


@query("seq7_matches_with_variants", f"""with {_SEEDS}, t as (select p, d, i, text from sd join documents on cast(doc_id as varchar) = d),
 h as (select p, d, i, len(list_filter(range(1, length(p) + 1), lambda j: substr(p, j, 1) <> substr(text, i + j, 1)
   and not (substr(p, j, 1) = ';' and substr(text, i + j, 1) = ','))) m from t)
 select p as peptide, d as protein_id, i as start, m as mismatches from h where m <= 2""")
def seq7(spark, folder):
    docs = _sequences(spark, folder)
    found = sequences.match_sequences(docs, _commas(spark, folder), _passages(spark, folder), 30, 2)
    return found.select("peptide", "protein_id", F.col("start").cast("long").alias("start"), F.col("mismatches").cast("long").alias("mismatches"))


def _first_comma(spark, folder):
    """The first comma of every document may also be missing."""
    at = F.instr("seq", ",").cast("int")
    return _sequences(spark, folder).select(
        "protein_id", at.alias("pos"), at.alias("end_pos"), F.lit(",").alias("ref"), F.lit("").alias("alt"), F.lit("gone").alias("note")
    ).filter("pos > 0")


@query("seq6_node_offsets", """with f as (select cast(doc_id as varchar) d, text, length(text) n from documents where text <> ''),
 q as (select d, n, unnest(list_filter(range(1, n + 1), lambda i: substr(text, i, 1) = ',')) as c, text from f),
 b as (select d, c - 1 as o from q union all select d, c - 1 from q union all select d, c from q where c < n and substr(text, c + 1, 1) <> ','
  union all select d, 0 from f where substr(text, 1, 1) <> ',' union all select d, 0 from f union all select d, n from f)
 select d as protein_id, o as "offset", count(*) as nodes from b group by 1, 2""")
def seq6_offsets(spark, folder):
    """Every comma of every document has an alternative: paths of thousands of nodes."""
    graph = sequences.variation_graph(_sequences(spark, folder), _commas(spark, folder))
    found = sequences.node_offsets(graph).groupBy("protein_id", "offset").agg(F.count("*").alias("nodes"))
    return found.select("protein_id", F.col("offset").cast("long").alias("offset"), "nodes")


@query("seq6_check_graph", """select cast(doc_id as varchar) as protein_id, case when doc_id % 3 = 0 then 'the longest path is shorter than the sequence'
   else 'the longest path is longer than the sequence' end as problem from documents where text <> '' and doc_id % 3 < 2""")
def seq6_check(spark, folder):
    docs = _sequences(spark, folder)
    graph = sequences.variation_graph(docs, _first_comma(spark, folder))
    number = F.col("protein_id").cast("long") % 3
    claimed = F.when(number == 0, F.col("seq_len") + 1).when(number == 1, F.col("seq_len") - 1).otherwise(F.col("seq_len"))
    return sequences.check_graph(graph, sequences.node_offsets(graph), docs.withColumn("seq_len", claimed))


# ------------------------------------------------------------------- contigs

_HITS = """sn as (select distinct p from (select unnest(string_split(text, '. ')) p from benchmark)),
 """ + _kmers_sql(8) + """, hi as (select d, i f, i + length(p) - 1 l, p from sn join ki on substr(p, 1, 8) = s join documents on cast(doc_id as varchar) = d
   where i + length(p) <= n and substr(text, i + 1, length(p)) = p),
 g0 as (select *, max(l) over (partition by d order by f, l rows between unbounded preceding and 1 preceding) pm from hi),
 g1 as (select *, sum(case when pm is null or f > pm then 1 else 0 end) over (partition by d order by f, l rows unbounded preceding) c from g0),
 ct as (select d, c, min(f) f, max(l) l, count(distinct p) k from g1 group by 1, 2)"""


def _sentence_hits(spark, folder):
    # a graph's texts are joined by name anyway: they need no shuffle of their own before
    graph = sequences.variation_graph(_sequences(spark, folder, dealt_out=False), _no_variants(spark, folder))
    matches = sequences.match_on_graph(sequences.seeds(_sequences(spark, folder), _sentences(spark, folder), 8), graph, 0)
    return graph, cut(sequences.node_hits(matches))


@query("seq8_contigs", f"with {_HITS} select d as protein_id, f as first, l as last from ct")
def seq8(spark, folder):
    _, hits = _sentence_hits(spark, folder)
    found = sequences.contigs(hits, KEYS)
    return found.select("protein_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query("seq9_split_nodes", f"""with {_HITS}, z as (select d, count(*) n, sum(l - f + 1) m, max(case when f = 0 then 1 else 0 end) a, max(l) e from ct group by d)
 select cast(doc_id as varchar) as protein_id, coalesce(2 * z.n + 1 - a - case when e = length(text) - 1 then 1 else 0 end, 1) as pieces, cast(coalesce(m, 0) as bigint) as matched_letters,
   coalesce(2 * z.n + 1 - a - case when e = length(text) - 1 then 1 else 0 end, 1) + 1 as edges
 from documents left join z on z.d = cast(doc_id as varchar) where text <> ''""")
def seq9(spark, folder):
    graph, hits = _sentence_hits(spark, folder)
    split = sequences.split_nodes(graph, sequences.contigs(hits, KEYS))
    pieces = split.nodes.filter("kind = 'reference'").groupBy("protein_id").agg(
        F.count("*").alias("pieces"), F.sum(F.when(F.col("match"), F.length("seq")).otherwise(0)).alias("matched_letters")
    )
    return pieces.join(split.edges.groupBy("protein_id").agg(F.count("*").alias("edges")), "protein_id")


@query("seq10_peptides_per_contig", f"with {_HITS} select d as protein_id, f as first, l as last, k as peptides from ct")
def seq10(spark, folder):
    _, hits = _sentence_hits(spark, folder)
    members = sequences.contig_peptides(hits, sequences.contigs(hits, KEYS), KEYS)
    counts = sequences.peptides_per_contig(members, KEYS)
    return counts.select("protein_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "peptides")


@query("seq10_peptide_range", f"with {_HITS} select d as protein_id, min(k) as min_peptides, max(k) as max_peptides from ct group by 1")
def seq10_range(spark, folder):
    _, hits = _sentence_hits(spark, folder)
    members = sequences.contig_peptides(hits, sequences.contigs(hits, KEYS), KEYS)
    return sequences.peptide_range(sequences.peptides_per_contig(members, KEYS))


@query("seq10_coverage", f"""with {_HITS}, z as (select d, sum(l - f + 1) m from ct group by d) select cast(doc_id as varchar) as protein_id, length(text) as length,
   cast(coalesce(m, 0) as bigint) as covered, round(coalesce(m, 0)::double / length(text), 9) as coverage from documents left join z on z.d = cast(doc_id as varchar) where text <> ''""")
def seq10_coverage(spark, folder):
    _, hits = _sentence_hits(spark, folder)
    found = sequences.coverage(sequences.contigs(hits, KEYS), _sequences(spark, folder))
    return found.withColumn("coverage", F.round("coverage", 9))
