import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from weftlink.llm.components import connected
from weftlink.llm.common import Workspace
from weftlink.llm.near_dedup import _candidates, apart_pairs, drop_near_duplicates, may_link, near_duplicates, possible_pairs, region_pairs, sketch, wide_hubs


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def test_matches_brute_force(docs, rows):
    sets, groups = components(rows)
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if groups[j] == groups[i]]
        known = [x for x in ids if x is not None]
        want.append((r[0], len(sets[i]), min(known) if known else None))
    out = near_duplicates(docs)
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in out.collect())
    assert out.where("kept").count() == len(set(groups))


def test_star_of_many_near_copies(spark):
    """Copies link to their centre and not to one another; every one must reach it."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        own = base[:]
        for _ in range(10):
            own[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(100))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, groups = components(rows)
    want = {}
    for (i, _), g in zip(rows, groups, strict=True):
        want.setdefault(g, []).append(i)
    out = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    assert out == {i: min(ids) for ids in want.values() for i in ids}


def test_candidates_are_linear():
    rest = np.sort(np.random.default_rng(1).integers(0, 3, (4000, 8)), axis=0)
    assert len(region_pairs(rest, np.arange(4000))) < 4000 * 12


def test_drop_keeps_columns(docs, rows):
    _, groups = components(rows)
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns and out.count() == len(set(groups))


def test_empty(empty):
    assert near_duplicates(empty).count() == 0
    assert drop_near_duplicates(empty).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    labels = connected(edges, Workspace(spark, "t"), "t")
    assert labels.count() == 200 and labels.select("label").distinct().collect()[0][0] == 1


def test_sketches_lose_no_link():
    rng = np.random.default_rng(8)
    for n in (1, 4, 120, 3000, 20_000):
        for _ in range(20):
            every = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = every[: n + rng.integers(0, n)], every[rng.integers(0, n) :]
            both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            kept = may_link(sketch(a)[None], np.array([len(a)]), sketch(b)[None], np.array([len(b)]), 75)[0]
            assert kept or 100 * both < 75 * either


def family(texts, words, changed, seed):
    """Variants of an ancestor that is not among them, ``changed`` of their words each; links are few and in dense regions."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    rows = []
    for i in range(texts):
        own = base[:]
        for k in rng.sample(range(words), changed):
            own[k] = f"x{rng.randrange(3)}"
        rows.append((i, " ".join(own)))
    return rows


def test_dense_family_with_few_links(spark):
    rows = family(400, 120, 3, 4)
    _, groups = components(rows)
    want = {}
    for (i, _), g in zip(rows, groups, strict=True):
        want.setdefault(g, []).append(i)
    out = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: min(ids) for ids in want.values() for i in ids}


def test_pair_of_one_tree_is_confirmed(spark):
    """A real link that one tree proposes counts; only what can't be linked goes."""
    sets = {1: np.arange(4, dtype=np.uint64), 2: np.arange(3, dtype=np.uint64), 3: np.arange(50, 54, dtype=np.uint64)}
    known = spark.createDataFrame([(u, len(x), sketch(x).tobytes()) for u, x in sets.items()], "uid long, n_shingles long, sketch binary")
    pairs = spark.createDataFrame([(1, 2, 1), (1, 3, 1), (2, 3, 9)], "a long, b long, votes long")
    labels = spark.createDataFrame([(3, 3)], "node long, label long")
    assert [tuple(r) for r in possible_pairs(apart_pairs(pairs, labels), known, 75).collect()] == [(1, 2)]


def test_hub_of_a_region_of_many_stretches(spark):
    """However rows come in batches, each is held once and one hub meets all rows of the region."""
    rng = np.random.default_rng(6)
    rest = rng.integers(0, 9, (600, 8))
    rest[rng.random(rest.shape) < 0.4] = 4
    rest[300] = 4
    order = np.lexsort(rest.T[::-1])
    rest, uid = rest[order], np.arange(600)
    for size in (40, 170):
        batches = [pa.RecordBatch.from_arrays([pa.array(np.full(len(x), 7)), pa.array([y.tobytes() for y in rest[x].astype(">u2")], pa.binary()), pa.array(uid[x])], ["region", "rest", "uid"]) for x in np.split(np.arange(600), range(size, 600, size))]
        found = pd.concat([x.to_pandas() for x in _candidates(iter(batches), 50)])
        members = found[found.votes == 0]
        assert sorted(members.b) == uid.tolist()
        hubs = wide_hubs(spark.createDataFrame([(int(a), int(b), bytes(r)) for a, b, r in zip(members.a, members.b, members.rest, strict=True)], "region long, uid long, rest binary"), 50).distinct().collect()
        pairs = {(a, b) for a, b, v in zip(found.a, found.b, found.votes, strict=True) if v} | {tuple(r) for r in hubs}
        met = np.bincount(np.array(sorted(pairs)).ravel(), minlength=600)
        assert met.max() == 599
        near = {(int(x), int(x) + k) for k in (1, 2, 3) for x in uid[: 600 - k]}
        assert near <= pairs


def test_kept_of_the_query_is_by_id(spark, tmp_path):
    """Repeated ids: all rows of the component's smallest id are kept there; one row is marked in another column."""
    from weftlink.llm.queries import op1_minhash_forest

    text = "a b c d e f g"
    docs = spark.createDataFrame([(1, text, "en", "s", 3), (1, text, "en", "s", 3), (2, text, "en", "s", 3), (None, "q r s", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = sorted(map(str, op1_minhash_forest(spark, str(tmp_path)).select("doc_id", "component_id", "kept").collect()))
    assert out == sorted(map(str, spark.createDataFrame([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)], "doc_id long, component_id long, kept boolean").collect()))
    assert op1_minhash_forest(spark, str(tmp_path)).where("kept_row").count() == 2


def test_long_regular_words_are_told_apart(spark):
    """Words whose polynomial hashes agree modulo a power of two: their sets are not equal."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word} one two three four five"), (2, f"{other} one two three four five"), (3, word), (4, other)]
    out = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: 1, 2: 2, 3: 3, 4: 4}
