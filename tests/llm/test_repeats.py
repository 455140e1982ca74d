import hashlib
import re

import numpy as np
import pytest

from weftlink.llm.repeats import anchors_of, equal_classes, remove_repeats, shared_windows, suffix_order


def brute(rows, length):
    """Rows in order of id (nulls last), then as given; every window looked up in a dictionary."""
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (r[1] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((str(r[0]), len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def shown(out):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect())


def test_matches_brute_force(docs, rows):
    assert shown(remove_repeats(docs)) == brute(rows, 100)


@pytest.mark.parametrize("parts", [1, 9])
def test_partitions_do_not_matter(docs, rows, parts):
    known = [r for r in rows if r[0] is not None]
    assert shown(remove_repeats(docs.where("doc_id is not null").repartition(parts), 60)) == brute(known, 60)


def test_periodic_and_overlapping(spark):
    rows = [(1, "ab" * 400), (2, "a" * 99), (3, "a" * 100), (4, "a" * 350), (5, "xyz" + "ab" * 60 + "q"), (6, "é" * 120), (7, "é" * 50 + "e" + "é" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert shown(remove_repeats(docs)) == brute(rows, 100)


def test_long_text_crosses_blocks(spark):
    rng = np.random.default_rng(4)
    long = "".join(rng.choice(list("abcdefgh "), 2_300_000))
    rows = [(1, long), (2, "start " + long[1_048_000:1_049_200] + " end"), (3, long[2_097_000:2_098_000])]
    out = {r["doc_id"]: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["n_removed"] == 0 and out[3]["n_removed"] == 1000 and 1200 <= out[2]["n_removed"] <= 1202


def test_kept_bytes(docs, rows):
    out = remove_repeats(docs, with_bytes=True).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in out)


def test_interval_expansion():
    rng = np.random.default_rng(8)
    text = np.append(rng.integers(1, 4, 4000), 0)
    text[700:900] = text[100:300]
    order, differs = equal_classes(text, 12)
    assert sorted(order.tolist()) == list(range(len(text))) == sorted(suffix_order(text, 12).tolist())
    padded = np.append(text, np.zeros(12, dtype=np.int64))
    for row in range(1, len(order)):
        a, b = padded[order[row - 1] : order[row - 1] + 12], padded[order[row] : order[row] + 12]
        if 0 not in a and 0 not in b:
            assert differs[row] == (a.tolist() != b.tolist())


def test_empty(empty):
    assert remove_repeats(empty).count() == 0


def test_owners_share_the_anchors():
    """Anchors are minima, yet no owner of a range of hashes gets much more than its share."""
    data = np.random.default_rng(3).integers(97, 123, 400_000).astype(np.uint8)
    hashes = np.concatenate([anchors_of(data[a : a + 200_000], np.array([0, 200_000]), 100)[0] for a in (0, 200_000)])
    owners = np.bincount((hashes >> np.uint64(60)).astype(np.int64), minlength=16)
    assert owners.min() > 0.8 * owners.mean() and owners.max() < 1.2 * owners.mean()


def test_contexts_of_one_hash_need_equal_bytes(monkeypatch, spark):
    """With a context hash that says nothing, only equal bytes are taken as equal."""
    import pyarrow as pa

    import weftlink.llm.repeats as repeats

    kept = repeats._part_anchors
    monkeypatch.setattr(repeats, "_part_anchors", lambda bodies, length: [x if k != 1 else x * np.uint64(0) for k, x in enumerate(kept(bodies, length))])
    rng = np.random.default_rng(5)
    gram = bytes(rng.integers(97, 100, 140).astype(np.uint8))
    texts = [gram, gram[:120] + b"q" * 20, gram, gram[:139] + b"x"]
    rows = pa.table({"chunk": pa.array([0] * 4, pa.int64()), "uid": pa.array(range(4), pa.int64()), "ord": pa.array(range(4), pa.int64()), "body": pa.array(texts, pa.binary())})
    sent = pa.Table.from_batches(list(repeats._send(100, 2)(iter(rows.to_batches()))))
    answers = pa.concat_tables([repeats._answer(sent.filter(pa.array(sent.column("owner").to_numpy() == k))) for k in set(sent.column("owner").to_pylist())])
    found = repeats._contexts(100, 2, 2)(rows, answers)
    covered = [repeats._unblob(b.as_py(), np.int64, np.int64, np.int64) for o, b in zip(found.column("owner").to_pylist(), found.column("blob"), strict=True) if o < 0]
    assert covered and all(set(x[0].tolist()) <= {1, 2, 3} for x in covered)
    for row, low, high in zip(*(np.concatenate(x) for x in zip(*covered, strict=True)), strict=True):
        assert any(texts[row][low:high] == t[low:high] for t in texts[:row])


def test_only_contexts_of_shared_windows_go_on():
    rng = np.random.default_rng(9)
    words = [bytes(rng.integers(97, 123, 120).astype(np.uint8)) for _ in range(6)]
    bodies = [words[0], words[1], words[0][1:] + b"z", words[2]]
    assert shared_windows(bodies, np.zeros(4, dtype=np.uint64), np.full(4, 21), 100).tolist() == [True, False, True, False]
    assert not shared_windows(bodies, np.arange(4).astype(np.uint64) << np.uint64(40), np.full(4, 21), 100).any()
