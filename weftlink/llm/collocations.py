"""Phrase collocations of each language, counted by a range-partitioned radix sort of packed id n-grams.

1. The corpus is written in chunks; each sends the counts of its distinct words. Words of a language that come ``least`` times
   get dense ids of 32 bits, other words break pieces: no phrase that has one can come ``least`` times.
2. Each chunk gets the ids of its own words by a join, so no task holds the dictionary, and writes one run: for every place
   the ids of the next ``WORDS`` words, zeros behind the end of the piece, as one key of 16 bytes; sorted by radix, equal keys as
   one with a number. Ids tell languages apart, so keys do.
3. Bounds of ranges come from a sample of the keys; they decide where a key is counted and not what is counted. Runs are cut at them, a
   range's blocks sorted by radix again, and the run lengths of the first 2, 3 and 4 ids are the counts of the phrases.
   A phrase may lie across bounds, however common its first words are: the ends of a range are given in any case, and sums
   put them together. Where ranges are many, blocks go to groups of ranges first, so that messages grow with the corpus alone.
4. Scores, phrases inside longer ones and ranks are joins and aggregations of the phrases that are left.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import parts_of, write_chunks
from .common import Workspace, picked, text_of

#: Words of the longest phrase, and bytes of an id.
WORDS, ID = 4, 4
#: Keys of a range, about; sampled keys a range; ranges that blocks are dealt to at once; keys merged before they are cut.
RANGE_KEYS, SAMPLES, FAN, MERGE_KEYS = 2 << 20, 16, 1024, 4 << 20
#: Bytes of text that are split into words at once, about.
SLICE = 1 << 20

# Fixed values of the contract: bytes that end a piece, and that part words. All ends become a full stop, which no word has.
_ENDS, _GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_PLAIN = bytes(46 if b in _ENDS else 32 if b in _GAPS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in bounded lists; a full stop stands where a piece ends."""
    plain, at = text.translate(_PLAIN), 0
    while at < len(plain):
        end = at + SLICE
        if end < len(plain):
            stops = [x for x in (plain.find(b" ", end), plain.find(b".", end)) if x >= 0]
            end = min(stops, default=len(plain))
        yield plain[at:end].replace(b".", b" . ").split()
        at = end


def _texts(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[str, bytes]]:
    for lang, body in zip(rows.column("lang"), rows.column("body"), strict=True):
        yield lang.as_py(), body.as_buffer().to_pybytes()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, _, _, rows in parts_of(batch):
            counts: dict[str, Counter] = {}
            for lang, body in _texts(rows):
                own = counts.setdefault(lang, Counter())
                for words in pieces(body):
                    own.update(words)
            for lang, own in counts.items():
                own.pop(b".", None)
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array([lang] * n, pa.string()), pa.array(list(own.keys()), pa.binary()), pa.array(list(own.values()), pa.int64())], ["chunk", "lang", "word", "n"])


def radix_order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The order of keys of two 64-bit halves: stable counting sorts of 16-bit digits, the last digit first; digits that are all equal are passed over."""
    order = np.arange(len(high))
    for half in (low, high):
        for shift in (0, 16, 32, 48):
            digit = (half >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def counted(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their numbers."""
    if not len(high):
        return high, low, n
    order = radix_order(high, low)
    high, low, n = high[order], low[order], n[order]
    heads = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
    return high[heads], low[heads], np.add.reduceat(n, heads)


def keys_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each place that begins a phrase of two words or more: its id and the next ones, up to a zero."""
    after = np.zeros((WORDS, len(ids)), dtype=np.uint64)
    after[0] = ids
    for k in range(1, WORDS):
        after[k, : len(ids) - k] = np.where(after[k - 1, : len(ids) - k] > 0, ids[k:], 0)
    some = after[:, after[1] > 0]
    return some[0] << np.uint64(32) | some[1], some[2] << np.uint64(32) | some[3]


def pack(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> bytes:
    """Keys and numbers as planes of 16-bit digits, compressed; numbers above 16 bits as 64 bits."""
    wide = len(n) > 0 and int(n.max()) >> 16 > 0
    planes = [((half >> np.uint64(s)).astype("<u2")).tobytes() for half in (high, low) for s in (48, 32, 16, 0)]
    raw = b"".join([*planes, n.astype("<u8" if wide else "<u2").tobytes()])
    return len(high).to_bytes(8, "little") + bytes([wide]) + pa.Codec("zstd").compress(raw, asbytes=True)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size, wide = int.from_bytes(data[:8], "little"), data[8]
    raw = pa.Codec("zstd").decompress(data[9:], decompressed_size=size * (16 + (8 if wide else 2)), asbytes=True)
    planes = np.frombuffer(raw, "<u2", 8 * size).reshape(8, size).astype(np.uint64)
    halves = [planes[k] << np.uint64(48) | planes[k + 1] << np.uint64(32) | planes[k + 2] << np.uint64(16) | planes[k + 3] for k in (0, 4)]
    return halves[0], halves[1], np.frombuffer(raw, "<u8" if wide else "<u2", size, 16 * size).astype(np.int64)


def _join(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate(x) for x in zip(*map(unpack, blocks), strict=True))


def _run(stride: int):
    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        """The sorted run of a chunk, and every ``stride``-th key of it."""
        ids: dict[str, dict[bytes, int]] = {}
        for lang, word, number in zip(found.column("lang").to_pylist(), found.column("word").to_pylist(), found.column("id").to_pylist(), strict=True):
            ids.setdefault(lang, {})[word] = number
        places = [np.zeros(1, dtype=np.uint64)]
        for lang, body in _texts(rows):
            known = ids.get(lang, {})
            places += [np.fromiter((known.get(w, 0) for w in words), np.uint64, len(words)) for words in pieces(body)]
            places.append(np.zeros(1, dtype=np.uint64))
        high, low, n = counted(*(keys := keys_of(np.concatenate(places))), np.ones(len(keys[0]), dtype=np.int64))
        if not len(high):
            return pa.table({"run": pa.array([], pa.binary()), "sample": pa.array([], pa.binary())})
        first = int(rows.column("chunk")[0].as_py()) * 0x9E3779B1 % stride
        some = np.column_stack([high[first::stride], low[first::stride]]).astype(">u8").tobytes()
        return pa.table({"run": pa.array([pack(high, low, n)], pa.binary()), "sample": pa.array([some], pa.binary())})

    return run


def _cut(bounds: np.ndarray):
    """Blocks of a partition, merged some at a time and cut at the bounds: range and block."""

    def emit(blocks: list[bytes]) -> pa.RecordBatch:
        high, low, n = _join(blocks)
        if len(blocks) > 1:
            high, low, n = counted(high, low, n)
        packed = np.column_stack([high, low]).astype(">u8").view("S16").ravel() if len(high) else np.zeros(0, "S16")
        cuts = [0, *np.searchsorted(packed, bounds).tolist(), len(high)]
        full = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in full], pa.int64()), pa.array([pack(high[a:b], low[a:b], n[a:b]) for _, a, b in full], pa.binary())], ["range", "run"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in batch.column("run"):
                held.append(block := x.as_py())
                size += int.from_bytes(block[:8], "little")
                if size >= MERGE_KEYS:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    return cut


def phrases_of(high: np.ndarray, low: np.ndarray, n: np.ndarray, least: int) -> pa.Table:
    """Phrases of 2 to 4 ids as prefixes of sorted keys, with run lengths; of runs that don't touch an end only those of ``least``."""
    keys, numbers = [], []
    data = np.column_stack([high, low]).astype(">u8").view(np.uint8).reshape(len(high), 16)
    fields = (high >> np.uint64(32), high & np.uint64(0xFFFFFFFF), low >> np.uint64(32), low & np.uint64(0xFFFFFFFF))
    differ = np.append(True, high[1:] != high[:-1])
    for size in range(2, WORDS + 1):
        if size > 2:
            differ = differ | np.append(True, fields[size - 1][1:] != fields[size - 1][:-1])
        heads = np.flatnonzero(differ)
        sums = np.add.reduceat(n, heads)
        wanted = sums >= least
        wanted[[0, -1]] = True
        wanted &= fields[size - 1][heads] > 0
        keys += [bytes(x) for x in data[heads[wanted], : ID * size]]
        numbers.append(sums[wanted])
    return pa.table({"key": pa.array(keys, pa.binary()), "n": np.concatenate(numbers).astype(np.int64)})


def _count(least: int):
    return lambda rows: phrases_of(*counted(*_join(rows.column("run").to_pylist())), least)


def number_words(frequent: DataFrame, work: Workspace) -> DataFrame:
    """``lang, word, n, id`` with dense ids from 1 on: the row's number in its partition behind the rows of partitions before."""
    placed = work.put(frequent.withColumn("at", F.monotonically_increasing_id()), "frequent")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    sizes = placed.groupBy("part").agg(F.count("*").alias("rows"))  # a row a partition
    starts = F.broadcast(sizes.select("part", (F.expr("sum(rows) over (order by part)") - F.col("rows")).alias("before")))
    row = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return work.put(placed.join(starts, "part").select("lang", "word", "n", (F.col("before") + row + 1).alias("id")), "dictionary")


def count_phrases(corpus: DataFrame, size: int, work: Workspace, least: int, range_keys: int = RANGE_KEYS, fan: int = FAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of chunks (chunk, lang, body): the dictionary, words of each language, and phrases (key, n) that come ``least`` times."""
    words = work.put(corpus.select("chunk", "uid", "lang", "body").mapInArrow(_words, "chunk long, lang string, word binary, n long"), "words", "zstd")
    totals = work.put(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    dictionary = number_words(words.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), work)
    if (top := dictionary.agg(F.max("id")).first()[0] or 0) >> 32:
        raise ValueError(f"{top} frequent words don't fit ids of 32 bits")
    tokens = totals.agg(F.sum("total")).first()[0] or 0
    ranges = max(1, -(-tokens // range_keys))
    stride = max(1, tokens // (SAMPLES * ranges))

    known = words.select("chunk", "lang", "word").join(dictionary.select("lang", "word", "id"), ["lang", "word"])
    runs = corpus.select("chunk", "lang", "body").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_run(stride), "run binary, sample binary")
    runs = work.put(runs, "runs", "uncompressed")
    sample = np.sort(np.frombuffer(b"".join(x["sample"] for x in runs.select("sample").toLocalIterator()), "S16"))  # some for each range
    bounds = np.unique(sample[np.linspace(0, len(sample), ranges + 1).astype(int)[1:-1]]) if len(sample) else sample
    blocks, schema = runs.select("run"), "range long, run binary"
    if len(bounds) > fan:
        blocks = blocks.mapInArrow(_cut(bounds[:: -(-len(bounds) // fan)]), schema).repartition("range").sortWithinPartitions("range").select("run")
    found = blocks.mapInArrow(_cut(bounds), schema).groupBy("range").applyInArrow(_count(least), "key binary, n long")
    grams = work.put(found.groupBy("key").agg(F.sum("n").alias("a")).where(F.col("a") >= least), "grams", "zstd")
    return dictionary, totals, grams


def collocations(docs: DataFrame, least: int = 30, covered: int = 80, top: int = 2000, text_column: str = "text", lang_column: str = "lang", range_keys: int = RANGE_KEYS, fan: int = FAN) -> DataFrame:
    """``lang, rank, phrase, cut, a, l, r, n, score``: the ``top`` phrases of each language.

    Words and pieces of the text with A-Z as a-z; null texts are empty, null languages are ``und`` (as is a language of that name). Phrases are
    of 2 to 4 words and come ``least`` times. ``score``: floor(2000000 a / (l + r)) at the cut where it is least, the first of such cuts; l
    and r count the two sides. A phrase inside a longer one that has ``covered`` percent of its occurrences is left out. Order: score,
    number, phrase. Repeated rows count as often as they come; no text, or none with a frequent phrase, gives no row; other columns
    are not read. Counts are exact, products are decimals.
    """
    with Workspace(docs.sparkSession, "collocations") as work:
        own = picked(docs, lang=lang_column, body=text_column)
        plain = own.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of(own, "body").alias("body"))
        corpus, size = write_chunks(plain, F.col("body"), work)
        dictionary, totals, grams = count_phrases(corpus, size, work, least, range_keys, fan)
        work.drop("corpus", "words", "runs")

        word_key = F.unhex(F.lpad(F.hex("id"), 2 * ID, "0"))
        sides = dictionary.select(word_key.alias("key"), F.col("n").alias("a")).unionByName(grams)
        length = F.octet_length("key")
        cuts = grams.withColumn("k", F.explode(F.sequence(F.lit(1), (length / ID - 1).cast("int"))))
        cuts = cuts.select("key", "a", "k", F.expr(f"substring(key, 1, {ID} * k)").alias("first"), F.expr(f"substring(key, {ID} * k + 1)").alias("rest"))
        cuts = cuts.join(sides.toDF("first", "l"), "first").join(sides.toDF("rest", "r"), "rest")
        cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(19, 0)) * 2000000) div (cast(l as decimal(19, 0)) + r)"))
        best = cuts.groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

        # what a phrase of n + 2 words covers, one of n + 1 words between them covers too
        inside = grams.where(length > 2 * ID).select(F.explode(F.array(F.expr(f"substring(key, 1, octet_length(key) - {ID})"), F.expr(f"substring(key, {ID} + 1)"))).alias("key"), F.col("a").alias("longer"))
        best = best.join(inside.groupBy("key").agg(F.max("longer").alias("longer")), "key", "left")
        wide = lambda c: F.col(c).cast("decimal(19, 0)")
        kept = work.put(best.where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * covered)).select("key", "a", "best.*"), "kept")

        spelled = kept.select("key", F.posexplode(F.sequence(F.lit(0), (length / ID - 1).cast("int"))).alias("at", "i")).select("key", "at", F.expr(f"substring(key, {ID} * i + 1, {ID})").alias("word_key"))
        spelled = spelled.join(dictionary.select(word_key.alias("word_key"), "lang", "word"), "word_key").groupBy("key").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
        phrase = F.array_join(F.transform("words", lambda x: x["word"].cast("string")), " ")
        named = kept.join(spelled.select("key", "lang", phrase.alias("phrase")), "key").join(totals, "lang")

        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
        part = F.pmod(F.xxhash64("key"), F.lit(16))
        some = named.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        out = work.put(ranked.select("lang", "rank", "phrase", F.col("k").alias("cut"), "a", "l", "r", F.col("total").alias("n"), "score"), "ranked")
        work.clear("ranked")
        return out
