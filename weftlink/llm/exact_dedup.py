"""Exact deduplication by a Golomb-coded exchange of fingerprints.

1. One pass over the texts writes a ledger: row number, id, SHA-256 of the normalised text.
2. Blocks of at most 2**20 ledger rows send the owners of fingerprint ranges their distinct
   fingerprints, sorted and Golomb-Rice coded. A fingerprint has ``log2(rows) + 10`` bits, so about
   12 bits travel for a distinct text, and a block names a fingerprint once however many copies it has.
3. Owners answer each block with a bitmap of the fingerprints that some other block named as well.
4. Only texts with such a fingerprint, or one that repeats inside its block, are suspects. They alone
   are shuffled whole, to be compared byte by byte; map-side aggregation leaves one row a task of
   a text, so a text that a third of all rows share is no hot key.
5. The verified groups go back to the ledger by a join that adaptive execution may split.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Workspace, carried, text_of, unpacked

#: Ledger rows of a block, as a power of two; fingerprints that an owner should get, about.
BLOCK_BITS, OWNER_ROWS, SPARE_BITS = 20, 1 << 20, 10
#: Suspect fingerprints are broadcast up to so many (16 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 1 << 20


def golomb_encode(values: np.ndarray, width: int) -> bytes:
    """Sorted distinct unsigned values below 2**width, as Golomb-Rice coded gaps.

    Layout: count (4 bytes), Rice parameter (1), bytes of the unary part (4), unary part, remainders.
    """
    n = len(values)
    if not n:
        return (0).to_bytes(4, "little") + bytes(5)
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, width - max(1, math.ceil(math.log2(n + 1))))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, dtype=np.uint8)
    unary[ends] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8)
    first = np.packbits(unary).tobytes()
    return n.to_bytes(4, "little") + bytes([k]) + len(first).to_bytes(4, "little") + first + np.packbits(rest.ravel()).tobytes()


def golomb_decode(data: bytes) -> np.ndarray:
    n, k, size = int.from_bytes(data[:4], "little"), data[4], int.from_bytes(data[5:9], "little")
    if not n:
        return np.zeros(0, dtype=np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, 9)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        rest = np.unpackbits(np.frombuffer(data, np.uint8, offset=9 + size), count=n * k).reshape(n, k)
        for bit in range(k):
            gaps |= rest[:, bit].astype(np.uint64) << np.uint64(bit)
    return np.cumsum(gaps, dtype=np.uint64)


def _owner_of(prints: np.ndarray, width: int, owner_bits: int) -> np.ndarray:
    return (prints >> np.uint64(width - owner_bits)).astype(np.int64)


def _send(width: int, owner_bits: int):
    def send(block: pd.DataFrame) -> pd.DataFrame:
        prints = np.unique(block["print"].to_numpy().astype(np.uint64))
        owners = _owner_of(prints, width, owner_bits)
        cuts = np.flatnonzero(np.diff(owners, prepend=-1))
        low = np.uint64((1 << (width - owner_bits)) - 1)
        return pd.DataFrame({
            "owner": owners[cuts],
            "block": block["block"].iloc[0],
            "coded": [golomb_encode(x & low, width - owner_bits) for x in np.split(prints, cuts[1:])],
        })

    return send


def _answer(batch: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps, one for each block that wrote to it."""
    lists = [golomb_decode(x) for x in batch["coded"]]
    every = np.sort(np.concatenate(lists))
    repeated = np.unique(every[1:][every[1:] == every[:-1]])
    return pd.DataFrame({"block": batch["block"], "owner": batch["owner"], "bits": [np.packbits(np.isin(x, repeated, assume_unique=True)).tobytes() for x in lists]})


def _suspects(width: int, owner_bits: int):
    def suspects(ledger: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        prints, counts = np.unique(ledger["print"].to_numpy().astype(np.uint64), return_counts=True)
        owners = _owner_of(prints, width, owner_bits)
        marked = counts > 1
        for owner, bits in zip(answers["owner"], answers["bits"], strict=True):
            low, high = np.searchsorted(owners, [owner, owner + 1])
            marked[low:high] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=high - low).astype(bool)
        return pd.DataFrame({"print": prints[marked].astype(np.int64)})

    return suspects


def suspect_prints(ledger: DataFrame, width: int, owner_bits: int) -> DataFrame:
    """Distinct fingerprints that more than one row of ``ledger`` (block, print) may share."""
    sent = ledger.groupBy("block").applyInPandas(_send(width, owner_bits), "owner long, block long, coded binary")
    answers = sent.groupBy("owner").applyInPandas(_answer, "block long, owner long, bits binary")
    found = ledger.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_suspects(width, owner_bits), "print long")
    return found.distinct()


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Texts are equal when they are identical after each run of ASCII white space becomes one space;
    null counts as empty. The row with the smallest id stays (null ids come last); of repeated rows with
    that id just one stays. An empty table gives an empty result. Other columns are not read, so
    their names cannot clash. Every row, whole texts: nothing is sampled or capped.
    """
    work = Workspace(docs.sparkSession, "exact-dedup")
    normal = F.regexp_replace(text_of(docs, text_column), WHITE, " ")
    base = docs.select(docs[id_column].alias("doc_id"), normal.alias("body")).withColumn("sha", F.unhex(F.sha2("body", 256)))
    first64 = F.conv(F.substring(F.hex("sha"), 1, 15), 16, 10).cast("long")  # 60 bits
    ledger = work.put(
        base.select("doc_id", "sha").withColumn("uid", F.monotonically_increasing_id()).withColumn("first", first64),
        "ledger",
    )
    rows = ledger.count()
    width = min(60, max(12, math.ceil(math.log2(rows + 1)) + SPARE_BITS))
    owner_bits = min(width - 1, max(3, math.ceil(math.log2(rows / OWNER_ROWS + 1))))
    shrink = F.shiftrightunsigned("first", 60 - width)
    prints = ledger.select(F.shiftright("uid", BLOCK_BITS).alias("block"), shrink.alias("print"))
    suspects = work.put(suspect_prints(prints, width, owner_bits), "suspects")

    few = suspects.count() <= BROADCAST_ROWS
    whole = base.withColumn("first", first64).withColumn("print", shrink)
    whole = whole.join(F.broadcast(suspects) if few else suspects, "print", "left_semi")
    groups = whole.groupBy("print", "body").agg(F.count("*").alias("n"), F.min("doc_id").alias("keep_id"))
    groups = work.put(groups.where("n > 1").select(F.unhex(F.sha2("body", 256)).alias("sha"), "n", "keep_id"), "groups")

    first = ledger.join(groups, "sha").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    first = work.put(first.groupBy("sha").agg(F.min("uid").alias("keep_uid"), F.first("n").alias("n"), F.first("keep_id").alias("keep_id")), "first")
    work.clear("ledger", "first")
    out = ledger.join(first, "sha", "left")
    return out.select(
        ledger["doc_id"],
        F.when(F.col("n").isNull(), ledger["doc_id"]).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "uid",
    )


def drop_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, of any names, whose text no row with a smaller id has.

    Null texts are empty and one group; null ids come last. Of repeated rows (same id, equal text) one stays, whichever: its
    other columns may differ. An empty table gives an empty one.
    """
    marked = exact_duplicates(docs, id_column, text_column)
    dropped = marked.where("not kept").select(F.col("doc_id").alias("d_id"), F.col("keep_id").alias("d_keep"), F.col("text_sha256").alias("d_sha"))
    rows = carried(docs, id=id_column, body=text_column)
    left = rows.select("row", "id", F.sha2(F.regexp_replace(text_of(rows, "body"), WHITE, " "), 256).alias("sha"))
    if not dropped.where(F.col("d_id").eqNullSafe(F.col("d_keep"))).isEmpty():  # repeated rows, seldom
        left = left.dropDuplicates(["id", "sha"])
    others = dropped.where(~F.col("d_id").eqNullSafe(F.col("d_keep")))
    kept = left.join(others, left["id"].eqNullSafe(others["d_id"]) & (left["sha"] == others["d_sha"]), "left_anti")
    return kept.select(*unpacked(docs.columns))
