import math
import random

import numpy as np

from weftlink.llm.language_id import PieceModel, identify_language, keep_identified, letter_words, public_pieces, train_on_folds

MADE = {"en": "th er on an in ing and the ed of", "de": "sch ein ich und die der ung ge", "fr": "le eau ment ou é ai de la"}


def corpus(spark, n=150):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(MADE))
        rows.append((i, " ".join("".join(rng.choice(MADE[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))), lang))
    return spark.createDataFrame([*rows, (900, None, "en"), (901, "", "de"), (902, "123 !!", "fr"), (903, "x" * 5000, "en"), (None, "the and", None)], "doc_id long, text string, lang string"), dict((r[0], r[2]) for r in rows)


def segmentations(word, chance):
    """Sum over all ways to cut the word into pieces, by recursion."""
    if not word:
        return 1.0
    return sum(chance[word[:k]] * segmentations(word[k:], chance) for k in range(1, len(word) + 1) if word[:k] in chance)


def test_forward_sums_all_segmentations():
    pieces = sorted(["▁", "▁a", "a", "b", "ab", "▁ab", "ba"])
    rng = np.random.default_rng(1)
    table = rng.random((len(pieces) + 1, 2))
    table /= table.sum(axis=0)
    model = PieceModel(pieces, ["x", "y"], table)
    words = ["ab", "ba", "abab", "aab", "bbbb", "ab" * 30]
    got = model.log_chances(words)
    for k in range(2):
        chance = dict(zip(pieces, table[:-1, k], strict=True))
        for i, w in enumerate(words[:-1]):
            assert math.isclose(got[i, k], math.log(segmentations("▁" + w, chance)), rel_tol=1e-9)
    counts = np.ones((len(words) - 1, 2))
    expected = model.expected_counts(words[:-1], counts)
    sizes = np.array([len(p) for p in pieces] + [1])
    assert np.allclose((expected * sizes[:, None]).sum(axis=0), sum(len(w) + 1 for w in words[:-1]))


def test_rounds_raise_the_likelihood():
    model = PieceModel(public_pieces(), ["x"])
    words, counts = ["the", "then", "other", "there"], np.array([[5.0], [2.0], [3.0], [1.0]])
    before = (model.log_chances(words) * counts).sum()
    better = model.updated(model.expected_counts(words, counts))
    assert (better.log_chances(words) * counts).sum() > before


def test_held_out_accuracy_and_odd_texts(spark):
    docs, truth = corpus(spark)
    model = train_on_folds(docs)
    out = {r["doc_id"]: r for r in identify_language(docs, model).collect()}
    assert sum(out[i]["lang_pred"] == lang for i, lang in truth.items()) / len(truth) > 0.95
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert out[903]["lang_pred"] in MADE and all(0 <= r["score"] <= 1 for r in out.values())
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3


def test_nothing_learned(docs, rows, empty):
    model = train_on_folds(empty)
    assert {r["lang_pred"] for r in identify_language(docs, model).collect()} == {"und"}
    assert identify_language(empty, model).count() == 0


def test_signs_of_numbers_are_no_letters(spark):
    assert letter_words("½ ② x²y Ⅷ 3a_b é") == ["x", "y", "a", "b", "é"] and letter_words("½ ²") == letter_words("") == []
    docs, _ = corpus(spark)
    odd = spark.createDataFrame([(1, "½ ²"), (2, "① ②"), (3, "² x")], "doc_id long, text string")
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify_language(odd, train_on_folds(docs)).collect()}
    assert out[1] == out[2] == ("und", 0.0) and out[3][0] in MADE


def test_words_of_any_length_are_learned_from():
    """Expected uses cover every letter of a long word, also where one language is far less likely than the other."""
    pieces = sorted(["▁", "a", "b", "ab", "ba", "aab"])
    table = np.array([[0.1, 0.1], [0.5, 0.001], [0.1, 0.3], [0.1, 0.3], [0.1, 0.2], [0.05, 0.05], [0.05, 0.049]])
    model = PieceModel(pieces, ["x", "y"], table)
    words = ["ab" * 24, "aab" * 700, "b" * 49]
    expected = model.expected_counts(words, np.ones((3, 2)))
    sizes = np.array([len(p) for p in pieces] + [1])
    assert np.isfinite(expected).all() and np.allclose((expected * sizes[:, None]).sum(axis=0), sum(len(w) + 1 for w in words))


def test_bound_on_languages(spark):
    docs, _ = corpus(spark)
    from weftlink.llm.language_id import train_language_model
    from pyspark.sql import functions as F

    labelled = docs.where("text is not null").select("doc_id", "lang", F.col("text").alias("body"))
    every = labelled.unionByName(labelled.limit(9).withColumn("lang", F.lit("und")))
    assert train_language_model(every).languages == sorted(r["lang"] for r in labelled.select("lang").where("lang is not null").distinct().collect())


def test_every_label_is_a_language(spark):
    """250 labels, each with words of its own; the rarest has one document and is predicted and kept."""
    import random

    from weftlink.llm.language_id import identify_language, keep_identified, train_language_model

    rng = random.Random(5)
    rows, probes = [], []
    for k in range(250):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)]
        rows += [(k * 10 + j, f"l{k:03}", " ".join(rng.choices(words, k=20))) for j in range(1 if k == 249 else 2)]
        probes.append((k, " ".join(words * 2)))
    model = train_language_model(spark.createDataFrame(rows, "doc_id long, lang string, body string"))
    assert len(model.languages) == 250
    docs = spark.createDataFrame(probes, "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in identify_language(docs, model).collect()}
    assert got[249] == "l249" and sum(got[k] == f"l{k:03}" for k in got) >= 245
    assert keep_identified(docs, model).count() == 250


def test_long_words_and_small_tables(monkeypatch):
    from weftlink.llm import language_id as L

    model = L.PieceModel(["▁", "a", "b", "ab", "▁a", "ba", "bab"], ["x", "y"])
    model = model.updated(model.expected_counts(["abab", "bba", "aab"], np.array([[3.0, 0], [0, 2.0], [1.0, 1.0]])))
    words = ["ab" * 30, "a" * 45, "abba", "bab" * 21, "éa" * 20]
    whole = model.log_chances(words)
    monkeypatch.setattr(L, "RUN", 17)
    assert np.allclose(model.log_chances(words), whole)
    held = L._Words(model)
    held.room = 2
    assert np.allclose(held.total(words * 3, False), whole.sum(axis=0) * 3 + model.prior)
