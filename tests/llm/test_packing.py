import bisect
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftlink.llm.packing import WordTokens, best_fit_decreasing, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def sequential(sizes, capacity):
    bins = []
    for size in sorted(sizes, reverse=True):
        k = bisect.bisect_left(bins, size)
        room = bins.pop(k) if k < len(bins) else capacity
        bisect.insort(bins, room - size)
    return len(bins)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_plan_is_best_fit_decreasing(sizes):
    counts = np.bincount(sizes, minlength=51) if sizes else np.zeros(51, dtype=np.int64)
    plan, bins = best_fit_decreasing(counts, 50)
    assert bins == sequential(sizes, 50)
    held = {}
    for size, rank, n, first, each, offset in plan.tolist():
        for j in range(n):
            held.setdefault(first + j // each, []).append((offset + j % each * size, size))
    assert Counter(s for x in held.values() for _, s in x) == Counter(sizes)
    for x in held.values():
        at = 0
        for offset, size in sorted(x):
            assert offset == at
            at += size
        assert at <= 50


TRICKY = ["don't STOP 'streets' we'LL", "a\x1cb c", "x y z", "été É ÉTÉ", "été", "İstanbul ΣΑΣ straße ﬁ", "12,345.67 ½ x²", "<|endoftext|> a<|startoftext|>b <|x|>", "日本語 テキスト", "🙂🙂 ok", "", "  \n\t ", "᠎ ﻿", "a" * 3000]


def test_words_tokenise_as_whole_texts():
    whole = Tokenizer.from_file(PATH)
    ours = [np.frombuffer(x, "<u4").tolist() for x in WordTokens(PATH).encode(pa.array(TRICKY))]
    assert ours == [whole.encode(x, add_special_tokens=False).ids for x in TRICKY]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text_tokenises_alike(texts):
    whole = Tokenizer.from_file(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in WordTokens(PATH, limit=3).encode(pa.array(texts, pa.string()))] == [whole.encode(x, add_special_tokens=False).ids for x in texts]


def test_pieces(docs, rows):
    whole, want, sizes = Tokenizer.from_file(PATH), Counter(), []
    for r in rows:
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for j, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            sizes.append(len(part))
            want[(r[0], j, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    out = pack_documents(docs, with_ids=True).toPandas()
    got = Counter((None if i != i else int(i), p, s, n, c) for i, p, s, n, c in zip(out.doc_id, out.piece, out.start, out.length, out.ids_crc32, strict=True))
    assert got == want
    assert all(zlib.crc32(x) == c for x, c in zip(out.ids, out.ids_crc32, strict=True))
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= 2048
    assert out.sequence_id.nunique() == sequential(sizes, 2048) >= math.ceil(sum(sizes) / 2048)


def test_empty(empty):
    assert pack_documents(empty).count() == 0


def regular_words(power):
    """A Thue-Morse word of 2**power letters and its complement: polynomial hashes modulo a power of two are equal on them."""
    word = "a"
    for _ in range(power):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("power", [10, 11, 12])
def test_long_regular_words_are_told_apart(spark, power):
    tokenizer = Tokenizer.from_file(PATH)
    rows = list(enumerate(regular_words(power)))
    out = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).orderBy("doc_id", "piece").collect()
    for k, text in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        want = [zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()) for a in range(0, len(ids), 2048)]
        assert [r["ids_crc32"] for r in out if r["doc_id"] == k] == want


def test_kept_ids_need_equal_bytes(monkeypatch):
    """With a hash that is the same for every word, ids still are those of the words."""
    import weftlink.llm.packing as packing
    from weftlink.llm.grams import block_words

    def weak(data, breaks):
        start, end, hashes = block_words(data, breaks)
        return start, end, hashes * np.uint64(0)

    texts = ["one two Three", "three two four", "", "one  ONE six"]
    plain = [WordTokens(PATH).whole(t).tobytes() for t in texts]
    monkeypatch.setattr(packing, "block_words", weak)
    tokens = WordTokens(PATH)
    assert list(tokens.encode(pa.array(texts))) == plain == list(tokens.encode(pa.array(texts)))
