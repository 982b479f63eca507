"""The pipeline against its stages done one by one by brute force, and odd documents through every stage."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayloom.llm import packing, quality, toxicity
from tests.llm.test_dedup import _near, _normal

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_stages_follow_the_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "exact_dedup", "near_dedup", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_the_result_is_that_of_the_stages_by_brute_force(spark, tables):
    documents, labels = tables
    good = quality.Scorer(quality.train(documents, labels))
    model = toxicity.train(documents, labels)
    toxic = toxicity.Scorer(toxicity.evidence(model), model.bias)
    rows = [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").collect()]
    rows = [r for r in rows if good.score(r[1]) >= 0.3]
    rows = [r for r in rows if toxic.score(r[1]) < 0.5]
    groups = collections.defaultdict(list)
    for r in rows:
        groups[_normal(r[1])].append(r)
    rows = sorted(min(g, key=lambda r: (-len(r[1] or ""), r[0])) for g in groups.values())
    kept = {d for d, _, _, k in _near(rows, 5) if k}
    tokens = packing.Tokens(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    want = {(d, i): min(4096, n - 4096 * i) for d, t in rows if d in kept for n in [len(tokens.batch([t])[0]) // 4 + 1] for i in range(-(-n // 4096))}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {(r["doc_id"], r["piece"]): r["length"] for r in got} == want and len(got) == len(want)
    used = collections.Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 4096 and len(used) <= -(-sum(want.values()) // 4096) + 1


def test_odd_documents_pass_every_stage(spark, tables):
    documents, _ = tables
    some = documents.filter(F.length("text") > 300).limit(5)
    odd = spark.createDataFrame(
        [(None, None), (90001, None), (90002, ""), (90003, "word " * 30_000), (None, "only words without an id")], "doc_id long, text string"
    ).selectExpr("doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "cast(null as long) n_chars")
    given = some.unionByName(some).unionByName(odd.select([F.col(c).cast(t) for c, t in some.dtypes]))
    for name in ("key", "sha", "turn", "pin", "points", "good_score", "Toxic_Score", "keep_id", "component_id", "length", "a.b", "tick`s"):
        given = given.withColumn(name, F.lit("extra"))
    docs = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.saved(stage(spark, docs, FOLDER), name)
        assert docs.columns == given.columns and docs.count() <= before
    ids = [r["doc_id"] for r in docs.filter("doc_id < 90000").collect()]
    assert len(ids) == len(set(ids))  # repeated rows are gone
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.filter("piece = 0").count() == docs.count()


def test_no_documents_pass_every_stage(spark, tables):
    docs = tables[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
