"""Quality, toxicity and language: accuracy on held-out rows, and the defined edge cases."""

import zlib

import pytest
from pyspark.sql import functions as F

from assayloom.llm import language, quality, toxicity
from assayloom.llm.common import fold, labelled_sample, newton

FOLDER = "/root/testdata/sf0.1"
EDGES = [(None, "plain words"), (1, None), (2, ""), (3, "x " * 30_000), (4, "12 !!"), (4, "12 !!")]
SCHEMA = "doc_id long, text string"


@pytest.fixture
def edges(spark):
    """Rows with nulls, empty, long and repeated texts, beside columns named like the results."""
    rows = [(*r, "a", 0.5, None) for r in EDGES]
    return spark.createDataFrame(rows, SCHEMA + ", score string, predicted double, held_out int")


def _tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_fold_is_crc32_of_the_id_as_text(spark):
    rows = spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


def test_sample_leaves_out_held_out_contradicting_and_unlabelled_rows(spark):
    documents = spark.createDataFrame([(i, f"t{i}") for i in range(40)] + [(None, "n"), (50, None)], SCHEMA)
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(30)] + [(0, 1), (None, 1), (35, None), (50, 1)], "doc_id long, quality int"
    )
    got = {r["text"]: r["label"] for r in labelled_sample(documents, labels, "quality", 100, 100, 5).collect()}
    want = {f"t{i}": i % 2 for i in range(1, 30) if zlib.crc32(str(i).encode()) % 5}
    want.pop("t0", None)
    assert got == want
    assert labelled_sample(documents, labels, "quality", 3, 100, 5).count() <= 6


def test_curve_finds_the_slope():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    slope, intercept = newton(x, y, np.ones_like(x))
    assert abs(slope - 2) < 0.15 and abs(intercept + 1) < 0.1


def _accuracy(scored, labels, label):
    joined = scored.join(labels, "doc_id").filter("held_out")
    return joined.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]


def test_quality_on_held_out_documents(spark):
    documents, labels = _tables(spark)
    model = quality.train(documents, labels)
    scored = quality.score(documents, model)
    assert scored.count() == documents.count()
    assert _accuracy(scored, labels, "quality") > 0.94
    good = scored.join(labels.filter("quality = 1"), "doc_id")
    assert good.filter("predicted = 1").count() > 0.98 * good.count()  # clean documents stay
    kept = quality.keep_good(documents, model)
    assert kept.columns == documents.columns
    assert kept.count() == scored.filter("predicted = 1").count()


def test_quality_edges(spark, edges):
    model = quality.fit(["some good words here"] * 4, ["!!! ??? ###"] * 4, 4, 4)
    rows = quality.score(edges, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[None][0]["held_out"] is None and by[1][0]["score"] == by[2][0]["score"] and by[4][0] == by[4][1]
    assert quality.score(edges.limit(0), model).count() == 0
    kept = quality.keep_good(edges, model)
    assert kept.columns == edges.columns


def test_quality_without_one_class_scores_the_share():
    model = quality.fit(["a"] * 9, [], 9, 0)
    assert quality.Scorer(model).score("anything") == pytest.approx(10 / 11)


def test_quality_sees_the_whole_of_a_long_text():
    model = quality.fit([f"the calm river flows past house {i}" for i in range(200)], [f"BUY!! NOW!! {i}" for i in range(200)], 1, 1)
    scorer = quality.Scorer(model)
    good = "the calm river flows past house 7 " * 300
    assert scorer.difference(good) > scorer.difference(good + "BUY!! NOW!! 7 " * 3000)


def test_toxicity_on_held_out_documents(spark):
    documents, labels = _tables(spark)
    scored = toxicity.score(documents, toxicity.train(documents, labels))
    assert scored.count() == documents.count()
    assert _accuracy(scored, labels, "toxic") > 0.93
    clean = scored.join(labels.filter("toxic = 0"), "doc_id")
    assert clean.filter("predicted = 0").count() > 0.98 * clean.count()


@pytest.fixture(scope="module")
def rude():
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(300)]

    def text(bad):
        found = [rng.choice(words) for _ in range(60)]
        if bad:
            found[rng.randrange(60)] = "grumblefuz" + rng.choice(["", "s", "z", "er", "ing", "y"])
        return " ".join(found)

    labels = [i % 2 for i in range(240)]
    return toxicity.fit([text(x) for x in labels], labels), text


def test_toxicity_knows_unseen_spellings(rude):
    model, text = rude
    scorer = toxicity.Scorer(toxicity.evidence(model), model.bias)
    assert scorer.score(text(0).replace(" ", " grumblefuzzyness ", 1)) > 0.5
    assert sum(scorer.score(text(0)) < 0.5 for _ in range(40)) >= 39


def test_one_insult_in_a_long_text_is_found(rude):
    model, text = rude
    scorer = toxicity.Scorer(toxicity.evidence(model), model.bias)
    calm = " ".join(text(0) for _ in range(300))
    assert scorer.score(calm) < 0.5 < scorer.score(calm + " grumblefuz " + calm)


def test_toxicity_edges(spark, edges, rude):
    model, _ = rude
    rows = toxicity.score(edges, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[None]["held_out"] is None and by[1]["score"] == by[2]["score"] == by[4]["score"]
    kept = toxicity.keep_clean(edges, model)
    assert kept.columns == edges.columns and kept.count() == sum(r["predicted"] == 0 for r in rows)
    assert toxicity.score(edges.limit(0), model).count() == 0


def test_toxicity_of_one_class():
    model = toxicity.fit(["a b c"] * 4, [0] * 4)
    assert toxicity.Scorer(toxicity.evidence(model), model.bias).score("a b") < 0.01
    assert toxicity.Scorer(toxicity.evidence(toxicity.fit([], [])), -20.0).score("") < 0.01


def test_language_on_held_out_documents(spark):
    documents, _ = _tables(spark)
    found = language.predict(documents, language.train(documents))
    assert found.count() == documents.count()
    joined = found.filter("held_out").join(documents.select("doc_id", "lang"), "doc_id")
    assert joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_gram_counts_are_those_of_brute_force(spark):
    from collections import Counter

    rows = [("xx", "Ab ba! Ünu"), ("xx", "ab 7ab"), ("yy", "a"), (None, "zz"), ("yy", None)]
    got = {(r["lang"], r["code"]): r["n"] for r in language.gram_counts(spark.createDataFrame(rows, "lang string, text string")).collect()}
    want = Counter()
    for lang, words in (("xx", ["ab", "ba", "ünu", "ab", "ab"]), ("yy", ["a"])):
        for i, w in enumerate(words):
            marked = f"\1{w}\1"
            for n in (1, 2, 3):
                for j in range(len(marked) - n + 1):
                    gram = marked[j:j + n]
                    if gram != "\1":
                        code = 0
                        for c in gram:
                            code = code << 21 | ord(c)
                        want[lang, code] += 1
    assert got == dict(want)


def test_out_of_place_distance_is_that_of_brute_force():
    table = language.letters()
    texts = {"aa": "anna and ann banana band", "bb": "otto root tool odor"}
    profiles = {k: language.profile(v, table).tolist() for k, v in texts.items()}
    judge = language.Judge(profiles)
    mine = language.profile("band and tool", table).tolist()

    def distance(p):
        return sum(abs(i - p.index(c)) if c in p else language.PROFILE for i, c in enumerate(mine))

    best = min(sorted(profiles), key=lambda k: distance(profiles[k]))
    name, score = judge.judge("band and tool")
    assert name == best and score == pytest.approx(1 - distance(profiles[best]) / (language.PROFILE * len(mine)))


def test_language_edges(spark, edges):
    profiles = {"aa": language.profile("plain words", language.letters()).tolist()}
    rows = language.predict(edges, profiles).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(EDGES) and by[None]["lang_pred"] == "aa" and by[None]["held_out"] is None
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 4))
    assert {r["lang_pred"] for r in language.predict(edges, {}).collect()} == {"und"}
    none = spark.createDataFrame([], SCHEMA + ", lang string")
    assert language.train(none) == {} and language.predict(none, {}).count() == 0


TEXTS = [
    None, "", "12 !!", "ok", "Two words", "You are a WORTHLESS idiot, go away", "the quiet river runs past the mill " * 40,
    "naïve straße ÀÉ ﬁnd", "x" * 1000, "a b c d e f g", "idiot", "fine, fine; idi0t fine_idiot",
]


def _train_texts():
    nice = [f"the quiet river {i} runs past the old mill and the garden" for i in range(30)]
    rude = [f"you worthless idiot {i} shut up and get lost" for i in range(30)]
    return nice, rude


def test_toxicity_scores_equal_the_definition(spark):
    """Mean of subword vectors per word, mean of neighbouring words, softmax of the worst window: written out plainly."""
    import math
    import re

    import numpy as np

    nice, rude = _train_texts()
    model = toxicity.fit(nice + rude, [0] * 30 + [1] * 30)
    vectors = np.frombuffer(model.vectors, dtype=np.float32).reshape(-1, toxicity.WIDTH).astype(float)

    def word(w):
        marked = "<" + w + ">"
        parts = {marked} | {marked[i:j] for i in range(len(marked)) for j in range(i + 3, min(i + 5, len(marked)) + 1)}
        return np.mean([vectors[zlib.crc32(p.encode()) % toxicity.BUCKETS] for p in parts], axis=0)

    def plain(text):
        found = []
        for run in re.findall(r"[^\W\d_]+", (text or "").lower()):
            found += [run[i:i + toxicity.PART] for i in range(0, len(run), toxicity.PART)]
        means = [np.mean([word(w) for w in found[i:i + toxicity.WINDOW]], axis=0) for i in range(len(found))]
        logits = [float(m @ np.array(model.weights)) for m in means] or [0.0]
        return 1 / (1 + math.exp(-(max(logits) + model.bias)))

    documents = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(documents, model).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        assert got[i] == pytest.approx(plain(text), abs=1e-4), text
    assert plain(TEXTS[5]) > 0.5 > plain(TEXTS[6])


def test_quality_scores_equal_the_definition(spark):
    """Sizes of all chunks under either dictionary, their normalised difference through the curve: written out plainly."""
    import math

    import zstandard

    nice, rude = _train_texts()
    model = quality.fit(nice, rude, 30, 30)

    def size(data, dictionary):
        plain = zstandard.ZstdCompressor(
            level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False
        )
        return len(plain.compress(data))

    def plain(text):
        data, good, bad = (text or "").encode(), 0, 0
        for start in range(0, len(data), quality.CHUNK):
            good += size(data[start:start + quality.CHUNK], model.good)
            bad += size(data[start:start + quality.CHUNK], model.bad)
        z = model.slope * ((bad - good) / (bad + good) if data else 0.0) + model.intercept
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))

    documents = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)
    got = {r["doc_id"]: r["score"] for r in quality.score(documents, model).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == pytest.approx(plain(text), abs=1e-9), text
    assert got[6] > 0.5 > got[5]
