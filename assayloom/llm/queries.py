"""One query per operator over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm import bpe, collocations, exact_dedup, language, licences, near_dedup, packing, quality, secrets, topk, toxicity, variants, warc
from assayloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BYTE_RANKS, WORD_MODEL = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


@query("op1_quality")
def op1(spark, folder):
    documents = table(spark, folder, "documents")
    return quality.score(documents, quality.train(documents, table(spark, folder, "labels")))


@query("op2_byte_bpe")
def op2(spark, folder):
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


@query("op3_licences")
def op3(spark, folder):
    return licences.scan(table(spark, folder, "documents"))


@query("op4_warc", r"""
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
 d as (select page_id, octet_length(payload) as bytes, sha1(payload) as hex from p),
 b as (select *, cast(unhex(hex) as bit)::varchar as bits, max(page_id) over (partition by hex) as holder from d)
select page_id, bytes as payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(list_sum(
  list_transform(range(5), lambda j: cast(substr(bits, cast(5 * i + j + 1 as bigint), 1) as integer) << cast(4 - j as integer))) as bigint), 1)), '') as payload_digest,
 case when page_id = holder then 'response' else 'revisit' end as record_type,
 case when page_id <> holder then holder end as refers_to
from b""")
def op4(spark, folder):
    return warc.archive(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# crc32 of the id as text: eight steps a byte
_CRC = """xor(list_reduce(list_prepend(4294967295::ubigint, flatten(list_transform(string_split(cast(doc_id as varchar), ''),
   lambda c: list_prepend(ascii(c)::ubigint, list_value(0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint))))),
   lambda c, o: case when xor(c, o) & 1 = 1 then xor(xor(c, o) >> 1, 3988292384::ubigint) else xor(c, o) >> 1 end), 4294967295::ubigint)"""


@query("op5_language", rf"""
with d as (select doc_id, lang, {_CRC} % 4 = 2 as held_out, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', chr(1), 'g') as s from documents),
 l as (select doc_id, lang, held_out, string_split(chr(1) || trim(s, chr(1)) || chr(1), '') as l from d where regexp_matches(s, '\p{{L}}')),
 g as (select doc_id, lang, held_out, unnest(list_concat(list_filter(l, lambda x: x <> chr(1)), list_transform(range(1, len(l)), lambda i: l[i] || l[i + 1]),
   list_transform(list_filter(range(1, len(l) - 1), lambda i: l[i + 1] <> chr(1)), lambda i: l[i] || l[i + 1] || l[i + 2]))) as g from l),
 p as (select lang, g, row_number() over (partition by lang order by count(*) desc, length(g), g) - 1 as r from g where not held_out and lang is not null group by lang, g qualify r < 400),
 q as (select doc_id, g, row_number() over (partition by doc_id order by count(*) desc, length(g), g) - 1 as r from g group by doc_id, g qualify r < 400),
 o as (select q.doc_id, n.lang, sum(coalesce(abs(q.r - p.r), 400)) as away, count(*) as n from q cross join (select distinct lang from p) n left join p on p.lang = n.lang and p.g = q.g group by all),
 b as (select doc_id, arg_min(lang, (away, lang)) as lang, min(away) as away, any_value(n) as n from o group by doc_id)
select d.doc_id, held_out, coalesce(b.lang, 'und') as lang_pred, coalesce(1 - b.away::double / (400 * b.n), 0) as score from d left join b using (doc_id)""")
def op5(spark, folder):
    documents = table(spark, folder, "documents")
    return language.predict(documents, language.train(documents))


@query("op6_toxicity")
def op6(spark, folder):
    documents = table(spark, folder, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, folder, "labels")))


@query("op7_packing")
def op7(spark, folder):
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(WORD_MODEL))


@query("op8_topk", """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
 r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5""")
def op8(spark, folder):
    vectors = topk.whole_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return topk.search(vectors, vectors.filter(F.col("id") % 50 == 0), 5)


@query("op9_exact_dedup", r"""
with d as (select doc_id, length(coalesce(text, '')) as points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as sha from documents),
 g as (select *, first_value(doc_id) over (partition by sha order by points desc, doc_id) as keep_id, count(*) over (partition by sha) as group_size from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha as text_sha256 from g""")
def op9(spark, folder):
    return exact_dedup.classes(table(spark, folder, "documents"))


@query("op10_near_dedup", r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
 s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) end) as s from w),
 n as (select doc_id, len(s) as n from s),
 u as (select doc_id, unnest(s) as x from s),
 c as (select a.doc_id as a, b.doc_id as b, count(*) as hits from u a join u b on a.x = b.x and a.doc_id <> b.doc_id group by all),
 l as (select a, b from c join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * hits >= 80 * (na.n + nb.n - hits)),
 r as (select doc_id, doc_id as reach from n union select r.doc_id, l.b from r join l on r.reach = l.a),
 k as (select doc_id, min(reach) as component_id from r group by doc_id)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from n join k using (doc_id)""")
def op10(spark, folder):
    return near_dedup.classes(table(spark, folder, "documents"), size=4)


@query("op11_collocations", r"""
with d as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[.,;:!?\x0A-\x0D]')) as piece from documents),
 p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from d),
 t as (select lang, sum(len(w)) as n from p group by lang),
 g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from p, range(1, 6) r(k) where len(w) >= k),
 f as materialized (select lang, k, phrase, count(*) as f from g group by all having count(*) >= 100),
 c as (select f.lang, f.k, f.phrase, f.f as a, cast(n as hugeint) as n, string_split(f.phrase, ' ') as w from f join t using (lang) where k >= 2),
 s as (select c.*, j, l.f as l, r.f as r, 1000 * a * n // (cast(l.f as hugeint) * r.f) as score from c, range(1, 5) x(j)
  join f l on l.lang = c.lang and l.phrase = array_to_string(w[1:j], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(w[j + 1:], ' ') where j < c.k),
 b as (select lang, phrase, any_value(k) as k, any_value(a) as a, any_value(n) as n, arg_min(l, (score, j)) as l, arg_min(r, (score, j)) as r, min(score) as score from s group by lang, phrase),
 i as (select distinct c.lang, array_to_string(c.w[x.i:x.j], ' ') as phrase, c.a from c, (select a.i, b.j from range(1, 6) a(i), range(1, 6) b(j)) x
  where x.j > x.i and x.j <= c.k and x.j - x.i + 1 < c.k),
 m as (select lang, phrase, max(a) as most from i group by all),
 o as (select b.* from b left join m using (lang, phrase) where m.most is null or 100 * m.most < 100 * b.a),
 q as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from o)
select * from q where rank <= 2000""")
def op11(spark, folder):
    return collocations.collocations(collocations.frequent_phrases(table(spark, folder, "documents")))


def _places(kind: str, pattern: str, part: int, kept: str) -> str:
    """SQL for (doc, kind, start, end, secret part) of all matches: texts between matches tell where they lie."""
    return rf"""select doc, doc_id, owner, '{kind}' as kind, b as "start", b + length(m) as "end", regexp_extract(m, $${pattern}$$, {part}) as part from (
   select doc, doc_id, owner, unnest(hits) as m, unnest(list_transform(range(1, len(hits) + 1), lambda i:
    cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as bigint))) as b
   from (select doc, doc_id, owner, regexp_extract_all(text, $${pattern}$$) as hits, string_split_regex(text, $${pattern}$$) as gaps from d) where len(hits) > 0) where {kept}"""


_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@query("op12_secrets", rf"""
with d as materialized (select row_number() over () as doc, doc_id, source as owner, coalesce(text, '') as text from documents),
 sure as materialized ({_places("assign", _ASSIGN, 2, f"length(regexp_extract(m, $${_ASSIGN}$$, 2)) >= 8")}
  union all {_places("access", "AKIA[A-Z0-9]+", 0, "length(m) >= 16")} union all {_places("hex", "[0-9a-f]{32,}", 0, "true")}),
 open as ({_places("token", "[A-Za-z0-9+/_=-]{24,}", 0, "regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]') and len(list_distinct(string_split(m, ''))) >= 12")}
  union all {_places("key", "-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=" + chr(92) + "x20" + chr(92) + "x09-" + chr(92) + "x0D]+-----END [A-Z ]*PRIVATE KEY-----", 0, "true")}),
 a as materialized (select * from sure union all select * from open o where not exists (select 1 from sure s where s.doc = o.doc and s."start" < o."end" and s."end" > o."start")),
 h as (select part, count(distinct coalesce(owner, chr(0))) <= 1 and count(distinct (coalesce(owner, chr(0)), coalesce(doc_id, -1))) <= 3 as live from a group by part),
 j as (select *, list_position(['assign', 'access', 'hex', 'token', 'key'], kind) as k, kind || ':' || "start" || ':' || "end" as span from a join h using (part)),
 g as (select doc, count(*) filter (k = 1) as n_assign, count(*) filter (k = 2) as n_access, count(*) filter (k = 3) as n_hex,
   string_agg(span, ',' order by "start", k) filter (k <= 3) as base, string_agg(span, ',' order by "start", k) filter (k <= 3 or live) as spans,
   count(*) filter (k > 3 and live) as n_open, count(*) filter (live) as n_live from j group by doc)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
 coalesce(spans, '') as spans, coalesce(n_open, 0) as n_open, coalesce(n_live, 0) as n_live from d left join g using (doc)""")
def op12(spark, folder):
    return secrets.digests(secrets.judged(table(spark, folder, "documents")))


# crc32 of a text of ASCII and U+00C0 to U+00FF, from its bytes
_CRC_WORD = """xor(list_reduce(list_prepend(4294967295::ubigint, flatten(list_transform(string_split(s, ''), lambda c: case when unicode(c) < 128
   then [unicode(c)::ubigint, 0, 0, 0, 0, 0, 0, 0] else [195::ubigint, 0, 0, 0, 0, 0, 0, 0, unicode(c)::ubigint - 64, 0, 0, 0, 0, 0, 0, 0] end))),
   lambda c, o: case when xor(c, o) & 1 = 1 then xor(xor(c, o) >> 1, 3988292384::ubigint) else xor(c, o) >> 1 end), 4294967295::ubigint)"""


@query("op13_variants", rf"""
with recursive r as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) as run from documents),
 c as (select coalesce(cast(doc_id as varchar), '') || ':' || run as s, run, count(*) as k from r where length(run) >= 7 group by all),
 h as (select run, k, {_CRC_WORD} as h from c),
 w as (select case when h % 31 = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word, k from h),
 v as materialized (select word, cast(sum(k) as bigint) as n from w where length(word) >= 7 group by word having sum(k) >= 2),
 x as materialized (select word, n, unnest(range(1, length(word) + 1)) as i, length(word) as size from v),
 e as materialized (select word, n, i, size, substr(word, 1, i - 1) || substr(word, i + 1) as rest from x),
 p as (select distinct a.word, b.word as near, b.n as near_n from e a join e b on a.rest = b.rest and a.i = b.i and a.size = b.size and a.word <> b.word
  union select e.word, v.word, v.n from e join v on e.rest = v.word union select v.word, e.word, e.n from e join v on e.rest = v.word),
 b as (select word, count(*) as n_near, arg_min(near, (-near_n, near)) as best, max(near_n) as best_n from p group by word),
 f as materialized (select v.word, v.n, coalesce(n_near, 0) as n_near, case when best_n >= 10 * v.n then best end as form, case when best_n >= 10 * v.n then best_n end as form_n from v left join b using (word)),
 o as (select word, word as root, form as next from f union all select o.word, f.word, f.form from o join f on o.next = f.word)
select f.word, f.form, o.root, f.n, f.n_near, f.form_n from f join o on o.word = f.word and o.next is null""")
def op13(spark, folder):
    return variants.variants(table(spark, folder, "documents"))


@query("pipeline")
def pipeline(spark, folder):
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
