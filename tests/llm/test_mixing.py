import math
import re
from collections import Counter, defaultdict

import pytest

from weftlink.llm.mixing import apply_mix, mix_sources

WEIGHTS = (5, 2, 1)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Shares by weight with what is above three times a source dealt again, one round after another."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, target, full = sum(sizes.values()), dict.fromkeys(names, 0.0), set()
    left = float(total)
    while left > 1e-6 and len(full) < len(names):
        open_ = [s for s in names if s not in full]
        unit, left = left / sum(weight[s] for s in open_), 0.0
        for s in open_:
            target[s] += unit * weight[s]
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3 * sizes[s]
                full.add(s)
    return target


def check(rows, out):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want, taken = targets(sizes), Counter()
    assert len(out) == len(rows)
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], size(r[1])) for r in rows)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    return want, taken


def test_targets_and_copies(docs, rows):
    want, taken = check(rows, mix_sources(docs).collect())
    biggest = defaultdict(int)
    for r in rows:
        biggest[r[3]] = max(biggest[r[3]], size(r[1]))
    for s, t in want.items():
        assert abs(taken[s] - t) <= biggest[s]


def test_full_source_is_taken_three_times(spark):
    rows = [(i, "one two three", None, "big") for i in range(200)] + [(1000 + i, "a b", None, "a-small") for i in range(4)]
    docs = spark.createDataFrame([r[:2] + r[3:] for r in rows], "doc_id long, text string, source string")
    want, taken = check(rows, mix_sources(docs).collect())
    assert want["a-small"] == 24 and taken["a-small"] == 24
    assert abs(taken["big"] - want["big"]) <= 3


def test_many_bins(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 37)), None, f"s{i % 5}") for i in range(3000)]
    docs = spark.createDataFrame([r[:2] + r[3:] for r in rows], "doc_id long, text string, source string")
    out = mix_sources(docs, bin_rows=200).collect()
    want, taken = check(rows, out)
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in want.items())


def test_reruns_agree(docs):
    shown = lambda d: sorted(str((r["doc_id"], r["size"], r["taken"])) for r in mix_sources(d).collect())
    assert shown(docs) == shown(docs.repartition(7))


def test_apply(docs):
    out = apply_mix(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in mix_sources(docs).collect():
        want[(r["doc_id"], r["size"])] += r["copies"]
    got = Counter((r["doc_id"], size(r["text"])) for r in out.collect())
    assert got == +want


@pytest.mark.parametrize("text", [None, ""])
def test_no_words_at_all(spark, text):
    docs = spark.createDataFrame([(1, text, "a"), (2, text, None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mix_sources(docs).collect()] == [(0.0, 0)] * 2


def test_empty(empty):
    assert mix_sources(empty).count() == 0
    assert apply_mix(empty).count() == 0


def test_rates_are_the_exponential_tilt(spark):
    """In each source log(rate) is in proportion to the size, up to the ceiling, and expected words are the target."""
    rows = [(i, " ".join(["w"] * (1 + i * i % 91)), f"s{i % 4}") for i in range(2000)] + [(5000 + i, " ".join(["w"] * (5 + i)), "z") for i in range(20)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    slopes, expected, target = defaultdict(list), Counter(), {}
    for r in out:
        assert math.floor(r["rate"] + 1e-6) <= r["copies"] <= math.ceil(r["rate"] - 1e-6)
        expected[r["source"]] += r["rate"] * r["size"]
        target[r["source"]] = r["target"]
        if r["rate"] < 3 - 1e-9:
            slopes[r["source"]].append(math.log(r["rate"]) / r["size"])
    assert all(abs(expected[s] - t) <= 1e-5 * t for s, t in target.items())
    assert all(max(x) - min(x) < 1e-9 for x in slopes.values()) and len(slopes) >= 3


def test_chance_of_one_more_copy_is_the_part(spark):
    """Of documents of one size the share with one more copy is the rest of the rate, within sampling error."""
    rows = [(i, " ".join(["w"] * (10, 40)[i % 2]), "ab"[i % 3 == 0]) for i in range(6000)]
    groups = defaultdict(list)
    for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        groups[r["source"], r["size"], round(r["rate"], 9)].append(r["copies"])
    assert len(groups) == 4 and all(abs(sum(x) / len(x) - rate) < 0.06 for (_, _, rate), x in groups.items())


def test_names_of_the_inside(spark):
    names = ["_sum", "_rows", "_size", "_n", "_copy", "_id", "_source", "_words", "row", "uid", "copies", "id", "size", "bin", "key", "c0", "rate"]
    docs = spark.createDataFrame([(i, "a b", "s", *names) for i in range(3)], ["doc_id", "text", "source", *names])
    out = apply_mix(docs)
    assert out.columns == docs.columns and out.count() == 3 and all([r[c] for c in names] == names for r in out.collect())
