import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftlink.llm.exact_dedup import drop_exact_duplicates, exact_duplicates, golomb_decode, golomb_encode


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, (1 << 40) - 1), max_size=300))
def test_golomb_round_trip(values):
    given_ = np.array(sorted(values), dtype=np.uint64)
    assert golomb_decode(golomb_encode(given_, 40)).tolist() == given_.tolist()


def test_golomb_is_small():
    prints = np.unique(np.random.default_rng(1).integers(0, 1 << 24, 1 << 14).astype(np.uint64))
    assert len(golomb_encode(prints, 24)) * 8 / len(prints) < 13


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_matches_brute_force(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    out = exact_duplicates(docs).collect()
    assert len(out) == len(rows)
    kept = defaultdict(int)
    for r in out:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = groups[text]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == (min(known) if known else None)
        assert r["doc_id"] == r["keep_id"] or not r["kept"]
        kept[text] += r["kept"]
    assert set(kept.values()) == {1} and set(kept) == set(groups)


def test_drop_keeps_one_row_of_each_text(docs, rows):
    out = drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(normal(r["text"]) for r in out.collect()) == sorted({normal(r[1]) for r in rows})


def test_empty(empty):
    assert exact_duplicates(empty).count() == 0
    assert drop_exact_duplicates(empty).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(docs, parts):
    shown = lambda d: sorted(map(str, exact_duplicates(d).drop("uid", "kept").collect()))
    assert shown(docs.repartition(parts)) == shown(docs)


def test_names_of_the_inside(spark):
    names = ["_sha", "_id", "_keep", "_sha2", "row", "id", "sha", "print", "uid", "n", "body", "first", "c0", "d_id"]
    docs = spark.createDataFrame([(i, "a b", *names) for i in (3, 1, 1)], ["doc_id", "text", *names])
    out = drop_exact_duplicates(docs)
    assert out.columns == docs.columns and [(r["doc_id"], [r[c] for c in names]) for r in out.collect()] == [(1, names)]
