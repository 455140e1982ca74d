import random
import re
from collections import Counter

import pytest

from weftlink.llm.decontamination import benchmark_matches, contamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10, slack=1):
    """Per document (id, text): words, hits, sorted ids of items, ids of items in proximity; and all matches."""
    counts = Counter(w for _, t in docs for w in words(t))
    rows, matches = [], []
    for doc_id, text in docs:
        ws, hit, named, near = words(text), set(), set(), set()
        places = {}
        for p, w in enumerate(ws):
            places.setdefault(w, set()).add(p)
        for item, said in items:
            vs, item = words(said), "" if item is None else str(item)
            m = min(window, len(vs))
            for s in range(len(vs) - m + 1) if m else ():
                i = min(range(s, s + m), key=lambda j: (counts[vs[j]], j))
                for p in places.get(vs[i], ()):
                    if all(any(p + j - i + e in places.get(vs[j], ()) for e in range(-slack, slack + 1)) for j in range(s, s + m)):
                        near.add(item)
                        start = p + s - i
                        exact = start >= 0 and ws[start : start + m] == vs[s : s + m]
                        if exact:
                            hit |= set(range(start, start + m))
                            named.add(item)
                        matches.append((doc_id, item, s, start, m, exact))
        rows.append((doc_id, len(ws), len(hit), len(named), sorted(named), bool(hit), len(near)))
    return rows, matches


def data(seed=4):
    rng = random.Random(seed)
    known = ["".join(rng.choice("abcdefghéß7") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(known) for _ in range(n))
    items = [(k, say(rng.randint(1, 30))) for k in range(25)] + [(100, None), (101, ""), (102, " .. "), (None, say(14)), (103, "aa bb"), (104, "the " * 12), (105, "only here nowhere else")]
    items += [(106, items[3][1].upper()), items[5], (5, say(12))]
    docs = []
    for d in range(120):
        text = say(rng.randint(0, 40))
        if d % 3 == 0:
            part = (rng.choice(items)[1] or "").split()
            if d % 2 and len(part) > 6:
                part.insert(5, "zz") if d % 4 == 1 else part.pop(4)
            text += "; " + ", ".join(part).upper() + " " + say(5)
        docs.append((d, text))
    docs += [(None, None), (None, items[0][1]), (500, ""), (501, "--"), (502, "the " * 400), (503, items[2][1] * 50), (7, docs[9][1]), docs[12], docs[12]]
    return docs, items


def shown(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated", "n_near").collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    docs, items = data()
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("window,slack", [(10, 1), (3, 0), (4, 2)])
def test_matches_brute_force(tables, window, slack):
    rows, _ = brute(*data(), window, slack)
    assert sum(r[5] for r in rows) > 5 and any(r[6] > r[3] for r in rows) == (slack > 0)
    assert shown(contamination(*tables, window=window, slack=slack)) == sorted(rows, key=repr)


def test_spans(tables):
    found = benchmark_matches(*tables, window=5, slack=1)
    rows = [tuple(r) for r in found.select("doc_id", "item", "item_start", "doc_start", "size", "exact").distinct().collect()]
    assert sorted(map(repr, rows)) == sorted({repr(r) for r in brute(*data(), 5, 1)[1]})


def test_without_broadcasts_and_other_partitions(tables, monkeypatch):
    monkeypatch.setattr("weftlink.llm.decontamination.BROADCAST_ROWS", 0)
    assert shown(contamination(tables[0].repartition(7), tables[1])) == sorted(brute(*data())[0], key=repr)


def test_plans_run_no_python(tables):
    plan = contamination(*tables)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_names_and_empty_tables(spark, tables):
    names = ["meta.k", "a`b", "a b", "uid", "tid", "pos", "term", "words", "c0", "n"]
    docs, items = data()
    wide = spark.createDataFrame([(*r, *names) for r in docs], "doc_id long, text string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names))
    other = spark.createDataFrame([(*r, *names) for r in items], "item_id long, text string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names))
    assert shown(contamination(wide, other)) == sorted(brute(docs, items)[0], key=repr)
    assert contamination(tables[0].limit(0), tables[1]).count() == 0
    clean = contamination(tables[0], tables[1].limit(0)).collect()
    assert len(clean) == len(docs) and not any(r["contaminated"] or r["n_near"] for r in clean)
