import random
import re
from collections import Counter

import numpy as np
import pytest

from weftlink.llm.collocations import collocations, counted, pack, pieces, radix_order, unpack

SMALL = {"least": 3, "range_keys": 40, "fan": 3}


def brute(rows, least=30, covered=80, top=2000):
    """The contract, in plain Python; rows: (lang, text)."""
    totals, found = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        plain = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    found[lang, tuple(words[i : i + size])] += 1
    good = {k: a for k, a in found.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, ws), a in good.items():
        longer = [b for (other, vs), b in good.items() if other == lang and len(vs) > len(ws) and any(vs[i : i + len(ws)] == ws for i in range(len(vs) - len(ws) + 1))]
        if any(100 * b >= covered * a for b in longer):
            continue
        cut = min((2_000_000 * a // (found[lang, ws[:k]] + found[lang, ws[k:]]), k) for k in range(1, len(ws)))
        out.setdefault(lang, []).append((-cut[0], -a, " ".join(ws).encode(), found[lang, ws[: cut[1]]], found[lang, ws[cut[1] :]], cut[1]))
    return sorted((lang, rank, p.decode(), -a, left, right, totals[lang], -s, k) for lang, of in out.items() for rank, (s, a, p, left, right, k) in enumerate(sorted(of)[:top], 1))


def shown(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut").collect())


def talk(seed, n, hot=False):
    rng = random.Random(seed)
    words = ["The", "of", "a", "b\x01", "a\x01", "é", "Éa", "New", "York", "City", "Hall", "x-y", "don't"]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 40)):
            text += rng.choice(words[:5] if rng.random() < 0.6 else [*words, f"rare{rng.random()}", "in New York City"]) + rng.choice([" ", "  ", "\t", " ", " ", ". ", "\n", ","])
        if hot:
            text += " it is " + rng.choice(words) + " " + rng.choice(words)
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    return rows


@pytest.mark.parametrize("hot", [False, True])
def test_matches_brute_force(spark, hot):
    rows = [*talk(5, 150, hot), ("en", None), ("en", ""), (None, " . ,"), ("fr", "only once here"), ("en", "word " * 30_000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert shown(collocations(df, **SMALL)) == brute(rows, 3)
    assert shown(collocations(df)) == brute(rows)


def test_partitions_and_ranges_do_not_matter(spark):
    df = spark.createDataFrame(talk(8, 120, True), "lang string, text string")
    first = shown(collocations(df.repartition(1), least=3))
    assert first and shown(collocations(df.repartition(7), **SMALL)) == first
    assert shown(collocations(df, least=3, range_keys=7, fan=2)) == first


def test_repeats_and_top(spark):
    rows = talk(11, 40) * 3
    df = spark.createDataFrame(rows, "lang string, text string")
    assert shown(collocations(df, least=6, top=5)) == brute(rows, 6, top=5)


def test_names_and_empty_tables(spark, empty):
    assert collocations(empty).count() == 0
    rows = talk(13, 30)
    names = ["lang", "text", "meta.k", "a`b", "a b", "chunk", "uid", "body", "key", "word", "n"]
    df = spark.createDataFrame([(*r, *names[2:]) for r in rows], names)
    assert shown(collocations(df, least=2)) == brute(rows, 2)


def test_radix_sort_is_a_sort():
    rng = np.random.default_rng(2)
    high, low = rng.integers(0, 1 << 62, 5000).astype(np.uint64) % np.uint64(97) << np.uint64(40), rng.integers(0, 1 << 62, 5000).astype(np.uint64)
    order = radix_order(high, low)
    assert order.tolist() == np.lexsort((low, high)).tolist()
    h, w, n = counted(high % np.uint64(1 << 41), low % np.uint64(3), np.ones(5000, dtype=np.int64))
    assert n.sum() == 5000 and len({*zip(h.tolist(), w.tolist(), strict=True)}) == len(h)
    for numbers in (n, n + 70_000):
        for x, y in zip(unpack(pack(h, w, numbers)), (h, w, numbers), strict=True):
            assert x.tolist() == y.tolist()


def test_slices_keep_words_whole():
    text = ("abc def.ghi\t" * 300_000).encode()
    assert [w for words in pieces(text) for w in words] == text.replace(b".", b" . ").split()
    assert [len(w) for words in pieces(b"x" * 3_000_000) for w in words] == [3_000_000]
