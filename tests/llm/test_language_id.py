import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import language_id as L
from tests.llm.helpers import DE, EN, FR, no_docs, odd_docs, odd_rows, prose


def test_codewords_differ():
    for n in (2, 3, 4, 6, 7, 9, 25, 300):
        code = L.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) == {-1.0, 1.0}
        assert (np.abs(code.sum(0)) < n).all()
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert apart >= 10 * int(np.ceil(np.log2(n))) / 4


def slow_grams(text):
    """Buckets of the byte n-grams of a text, one by one."""
    data, out = f" {text.lower()} ".encode(), []
    for n in L.GRAMS:
        for i in range(len(data) - n + 1):
            key = 0
            for b in data[i : i + n]:
                key = (key * 256 + b) % 2**32
            mixed = (key + 97 * n) * 2654435761 % 2**32
            out.append((mixed ^ (mixed >> 15)) % L.BUCKETS)
    return out


@pytest.mark.parametrize("part,block", [(1 << 15, 1 << 18), (37, 100), (5, 1)])
def test_grams_are_those_of_the_bytes(monkeypatch, part, block):
    monkeypatch.setattr(L, "PART", part)
    texts = [prose(random.Random(1), EN + DE, 60) + " 日本語", "", "a", "İé", prose(random.Random(2), FR, 200)]
    got = [[] for _ in texts]
    for g in L.gram_blocks(texts, block):
        for i, t in enumerate(g.text.tolist()):
            got[t] += g.ids[g.start[i] : g.start[i + 1]].tolist()
    assert [sorted(x) for x in got] == [sorted(slow_grams(t)) for t in texts]


def test_model_and_decoding_against_plain_python(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, (EN, DE, FR)[i % 3], rng.randint(5, 20)), ("en", "de", "fr")[i % 3]) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = L.learn(docs, ~L.held_out())
    tests = {r.text for r in L._sample(docs, ~L.held_out(), L.TRAIN_DOCS).filter("measures").collect()}
    usable = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    counts = {x: np.zeros(L.BUCKETS) for x in ("de", "en", "fr")}
    for _, text, lang in usable:
        if text not in tests:
            for g in slow_grams(text):
                counts[lang][g] += 1
    assert 0 < len(tests) < len(usable) and model.languages == ("de", "en", "fr")
    rates = np.array([(c + L.SMOOTHING) / (c.sum() + L.SMOOTHING * L.BUCKETS) for c in counts.values()])
    for bit in range(model.code.shape[1]):
        side = model.code[:, bit] > 0
        assert np.allclose(model.weights[:, bit], np.log(rates[side].mean(0)) - np.log(rates[~side].mean(0)))
    own = {t: np.mean([model.weights[g] for g in slow_grams(t)], axis=0) for _, t, _ in rows}
    right, sizes = np.zeros((3, model.code.shape[1], 2)), []
    for _, text, lang in usable:
        if text in tests:
            k = model.languages.index(lang)
            right[k, :, 0] += np.sign(own[text]) == model.code[k]
            right[k, :, 1] += 1
            sizes.append(np.abs(own[text]))
    trust = (right[..., 0] + 1) / (right[..., 1] + 2)
    assert np.allclose(model.scale, np.mean(sizes, axis=0)) and np.allclose(model.trust, trust / trust.sum(1, keepdims=True))
    for r in L.predict(docs, model).collect():
        found = own[rows[r.doc_id][1]]
        losses = [sum(t * np.exp(-c * max(-3, min(3, m / s))) for t, c, m, s in zip(model.trust[k], model.code[k], found, model.scale)) for k in range(3)]
        best = sorted(range(3), key=lambda k: losses[k])
        likely = [np.exp(-4 * (x - min(losses))) for x in losses]
        assert r.lang_pred == model.languages[best[0]] and r.score == pytest.approx(1 / sum(likely))
        assert r.ambiguous == (losses[best[1]] - losses[best[0]] < L.LEAD)


def test_many_languages_are_all_learned(spark):
    rng = random.Random(9)
    words = {f"l{k:04d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(300)}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(40)), lang) for i, lang in enumerate(x for x in words for _ in range(12))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = L.learn(docs, ~L.held_out())
    assert len(model.languages) == 300 and model.weights.shape == (L.BUCKETS, model.code.shape[1])
    told = {r.doc_id: r.lang_pred for r in L.predict(docs, model).collect()}
    unseen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(told[r[0]] == r[2] for r in unseen) / len(unseen) > 0.95


def test_held_out_accuracy(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, (EN, DE, FR)[i % 3], rng.randint(8, 60)), ("en", "de", "fr")[i % 3]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # labels of the held-out fold are never read: wrong ones change nothing
    docs = docs.withColumn("lang", F.when(L.held_out(), "xx").otherwise(F.col("lang")))
    model = L.learn(docs, ~L.held_out())
    assert model.languages == ("de", "en", "fr")
    told = {r.doc_id: r for r in L.predict(docs, model).collect()}
    unseen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(unseen) > 50
    assert sum(told[r[0]].lang_pred == r[2] for r in unseen) / len(unseen) > 0.97
    assert all(0 <= r.score <= 1 for r in told.values())
    even = L.decode((model.code[0] + model.code[1]) / 2 * model.scale, model)
    assert even[2] or even[1] < 0.7  # halfway between two codewords


def test_a_very_long_text(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, (EN, DE)[i % 2], 30), ("en", "de")[i % 2]) for i in range(60)] + [(100, (prose(rng, DE, 5000) + " ") * 160, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(rows[-1][1]) > 4_000_000
    told = {r.doc_id: r.lang_pred for r in L.predict(docs, L.learn(docs, ~L.held_out())).collect()}
    assert told[100] == "de"


def test_odd_rows(spark):
    docs = odd_docs(spark)
    model = L.learn(docs, ~L.held_out())
    told = L.predict(docs, model).collect()
    assert len(told) == len(odd_rows())
    for r in told:
        if r.doc_id in (220, 221, 222, 223):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not {220, 221, 222, 223} & ids and len(set(range(120)) & ids) > 100


def test_nothing_to_learn(spark):
    assert L.learn(no_docs(spark), ~L.held_out()) is None
    assert L.predict(no_docs(spark), None).count() == 0
    docs = odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert L.learn(docs, ~L.held_out()) is None
    assert {r.lang_pred for r in L.predict(docs, None).collect()} == {"und"}
    assert L.keep_identified(no_docs(spark)).count() == 0


def test_one_language(spark):
    docs = spark.createDataFrame([(i, "some words of it", "en") for i in range(9)] + [(50, "123", "en")], "doc_id long, text string, lang string")
    told = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs, L.learn(docs, ~L.held_out())).collect()}
    assert told[50] == ("und", 0.0) and told[0] == ("en", 1.0)


def test_languages_with_one_row_are_all_learned(spark):
    rows = [(i, f"l{i:02d}", f"{chr(97 + i % 26)}{chr(98 + i // 3)} " * 30 + f"word{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    usable = {r.lang for r in docs.filter(~L.held_out()).collect()}
    model = L.learn(docs, ~L.held_out())
    assert set(model.languages) == usable and len(usable) > 25
    told = {r.doc_id: r.lang_pred for r in L.predict(docs, model).collect()}
    assert sum(told[i] == lang for i, lang, _ in rows if lang in usable) > 0.9 * len(usable)
    many = spark.createDataFrame([(i, "one" if i % 50 else f"x{i}", f"text {i}") for i in range(1, 400)], "doc_id long, lang string, text string")
    assert set(L.learn(many, ~L.held_out(), per_language=20).languages) == {r.lang for r in many.filter(~L.held_out()).collect()}
