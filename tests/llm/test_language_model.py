import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from weftlink.llm.language_id import id_fold
from weftlink.llm.language_model import BUCKETS, language_model, learn_weights, score_documents


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def trained(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2


@pytest.fixture(scope="module")
def scored(docs):
    return score_documents(docs, id_fold(docs["doc_id"], 7) != 2).collect()


def test_counts_and_base(scored, rows):
    counts = Counter(t for r in rows if trained(r[0]) for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        own = tokens(r[1])
        want.append((str(r[0]), len(own), sum(counts[t] > 0 for t in own), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), 6)))
    got = [(str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in scored]
    assert sorted(got) == sorted(want)


def test_scores_by_brute_force(docs, rows):
    """Each text's score is the mixture of its estimates from plain counts of triples, pairs and words, with the learned weights."""
    scored, weights = language_model(docs, id_fold(docs["doc_id"], 7) != 2)
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all()
    counts, texts = [Counter() for _ in range(4)], 0
    for r in rows:
        if trained(r[0]):
            own, texts = ["<", "<", *tokens(r[1])], texts + 1
            for n in (1, 2, 3):
                counts[n].update(tuple(own[i - n + 1 : i + 1]) for i in range(2, len(own)))
    n, v = sum(counts[1].values()), len(counts[1])
    step = lambda x: min(int(math.floor(math.log2(x))) + 1, BUCKETS - 1)
    want = []
    for r in rows:
        own, score = ["<", "<", *tokens(r[1])], 0.0
        for i in range(2, len(own)):
            last = texts if own[i - 1] == "<" else counts[1][(own[i - 1],)]
            two = texts if own[i - 1] == "<" else counts[2][(own[i - 2], own[i - 1])]
            w = weights[BUCKETS + step(two) if two else step(last) if last else 0]
            shares = [counts[3][tuple(own[i - 2 : i + 1])] / max(two, 1), counts[2][(own[i - 1], own[i])] / max(last, 1), counts[1][(own[i],)] / n, 1 / (v + 1)]
            score += math.log10(sum(a * b for a, b in zip(w, shares, strict=True)))
        want.append((str(r[0]), round(score, 6)))
    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in scored.collect()) == sorted(want)


def test_better_than_the_base(scored, rows):
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in scored)
    assert sum(r["score"] for r in scored) > sum(r["base_score"] for r in scored)


def test_weights_follow_the_held_out_counts():
    cells = pd.DataFrame({"bucket": [BUCKETS + 1, BUCKETS + 1, BUCKETS + 3, 2], "n": [5, 2, 9, 4], "triple": [1.0, 0.0, 8.0, 0.0], "pair": [2.0, 0.0, 1.0, 3.0], "word": [0.1, 0.2, 0.3, 0.1]})
    weights = learn_weights(cells, 1e-4)
    assert np.allclose(weights.sum(axis=1), 1) and (weights[BUCKETS:] > 0).all()
    assert (weights[:BUCKETS, 0] == 0).all() and weights[0, 1] == 0 and weights[BUCKETS + 3, 0] > weights[BUCKETS + 1, 0] and weights[2, 1] > 0.5


def test_empty(empty):
    assert score_documents(empty, id_fold(empty["doc_id"], 7) != 2).count() == 0


def test_nothing_to_learn(docs, rows):
    from pyspark.sql import functions as F

    out = score_documents(docs, F.lit(False)).collect()
    assert len(out) == len(rows) and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in out)


def test_long_regular_words_are_told_apart(spark):
    from pyspark.sql import functions as F

    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word, True), (2, word.translate(str.maketrans("ab", "ba")), False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, trained boolean")
    out = {r["doc_id"]: (r["n_tokens"], r["n_known"], r["train_tokens"]) for r in score_documents(docs, F.col("trained")).collect()}
    assert out == {1: (2, 2, 2), 2: (2, 1, 2)}


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(docs, parts):
    from pyspark.sql import functions as F

    def made(d):
        out, weights = language_model(d, id_fold(F.col("doc_id"), 7) != 2)
        return weights, sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in out.collect())

    (w1, s1), (w2, s2) = made(docs), made(docs.repartition(parts, "text"))
    assert np.allclose(w1, w2, rtol=1e-9) and s1 == s2


def test_weights_come_from_the_fold(docs, rows):
    """Cells of the held-out fold, from plain counts of the other training texts, give the same weights."""
    from pyspark.sql import functions as F

    from weftlink.llm.language_model import FOLDS, cells_of

    folds = dict(docs.select(F.coalesce("text", F.lit("")), F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)) == 0).distinct().collect())
    learned = [r[1] or "" for r in rows if trained(r[0])]
    counts, texts = [Counter() for _ in range(4)], 0
    for t in learned:
        if not folds[t]:
            own, texts = ["<", "<", *tokens(t)], texts + 1
            for n in (1, 2, 3):
                counts[n].update(tuple(own[i - n + 1 : i + 1]) for i in range(2, len(own)))
    found = []
    for t in learned:
        if folds[t]:
            own = ["<", "<", *tokens(t)]
            for i in range(2, len(own)):
                last = texts if own[i - 1] == "<" else counts[1][(own[i - 1],)]
                two = texts if own[i - 1] == "<" else counts[2][(own[i - 2], own[i - 1])]
                found.append((counts[1][(own[i],)], last, counts[2][(own[i - 1], own[i])], two, counts[3][tuple(own[i - 2 : i + 1])]))
    assert len(found) > 100
    vocabulary = len({t for x in learned for t in tokens(x)})
    want = learn_weights(cells_of(tuple(np.array(x) for x in zip(*found, strict=True)), sum(counts[1].values())), 1 / (vocabulary + 1))
    assert np.allclose(language_model(docs, id_fold(docs["doc_id"], 7) != 2)[1], want, rtol=1e-6)
