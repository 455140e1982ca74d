import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftlink.llm.sharding import SlotMap, shard_documents


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=16, max_size=64), st.integers(2, 5))
def test_rebalancing_narrows_the_gap(weights, shards):
    weight = np.array(weights, dtype=np.float64)
    first = SlotMap.initial(len(weights), shards)
    load = lambda m: np.bincount(m.owner, weights=weight, minlength=m.shards)
    after = first.rebalanced(weight)
    assert np.ptp(load(after)) <= np.ptp(load(first)) and after.version == 1
    assert set(after.moved) == {s for s in range(len(weights)) if after.owner[s] != first.owner[s]}


def test_growing_moves_only_into_the_new_shard():
    weight = np.random.default_rng(1).integers(1, 100, 4096).astype(float)
    old = SlotMap.initial(4096, 16).rebalanced(weight)
    new = old.grown(weight)
    assert new.shards == 17 and all(new.owner[s] == 16 for s in new.moved)
    load = np.bincount(new.owner, weights=weight)
    assert abs(load[16] - load.sum() / 17) < 200


def test_shards(docs, rows):
    versions = []
    out = shard_documents(docs, shards=4, slots=1024, versions=versions).toPandas()
    assert len(out) == len(rows) and [m.version for m in versions] == [0, 1]
    sizes = out.groupby("shard")["size"].sum()
    assert out["size"].sum() == sum(len((r[1] or "").encode()) + 1 for r in rows)
    assert sizes.max() - sizes.min() <= out["size"].max()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_copies_spread(spark):
    same = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    out = shard_documents(same, shards=8, slots=1024).groupBy("shard").count().toPandas()
    assert out["count"].max() - out["count"].min() <= 2


def test_empty(empty):
    assert shard_documents(empty).count() == 0


def test_every_row_by_brute_force(docs, rows):
    """Sizes and checksums of each row, gapless places, and shards nearly as equal as whole rows allow."""
    out = shard_documents(docs, shards=5, slots=512).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), r[2], r[3]) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["lang"], r["source"]) for r in out) == want
    for shard in range(5):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))
    loads = Counter()
    for r in out:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) <= max(r["size"] for r in out)


def test_repeated_rows_are_dealt_apart(spark):
    """The law holds where half of all rows are equal in id and text."""
    rng = random.Random(1)
    rows = [(7, "one and the same " * 3)] * 3000 + [(100 + i, "x" * rng.randint(1, 90)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = shard_documents(docs, shards=16, slots=8192).groupBy("shard").agg(F.sum("size").alias("bytes")).toPandas()
    assert len(out) == 16 and out["bytes"].max() - out["bytes"].min() <= 2


def test_names_of_results_and_of_the_inside(spark):
    names = ["_id", "_size", "_crc", "_rank", "_shard", "_start", "_version", "h", "n", "id", "body", "row", "crc", "start", "rank", "version", "c0", "size"]
    docs = spark.createDataFrame([(1, "a b", *names), (2, None, *names)], ["doc_id", "text", *names])
    out = shard_documents(docs, shards=2, slots=8)
    assert out.columns[: len(names) + 1] == ["doc_id", "text", *names[:-1]] and "size" in out.columns
    assert all([r[c] for c in names[:-1]] == names[:-1] for r in out.collect())
