"""Chunks of a corpus that ask owners of key ranges about their keys, and get the answers back.

The corpus is written once with a row number and a chunk of bounded bytes (one longer text is a chunk alone). A *part* is a run of one chunk's
rows inside one Arrow batch; its distinct keys go to their owners, sorted and as byte planes of their gaps, and an
answer of one number a key comes back for the same keys in the same order. Whoever reads the chunk again cuts it
into the same parts by row numbers, so keys never travel back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Workspace, partitions

#: Bytes of text of a chunk, about; least number of chunks of a small corpus; keys an owner should get, about.
CHUNK_BYTES, LEAST_CHUNKS, OWNER_KEYS = 8 << 20, 24, 2 << 20


def _deal(each: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds ``chunk``, the first row number of a run of rows that begin within the same ``each`` bytes of a partition."""
        before, block, first = 0, -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            uid, size = np.asarray(batch.column("uid")), np.asarray(batch.column("bytes"))
            begin = before + np.cumsum(size) - size
            blocks = begin // each
            heads = np.flatnonzero(np.diff(blocks, prepend=block))
            chunk = np.full(len(uid), first)
            if len(heads):
                chunk[heads[0] :] = np.repeat(uid[heads], np.diff(heads, append=len(uid)))
            before, block, first = int(begin[-1] + size[-1]), int(blocks[-1]), int(chunk[-1])
            names = [n for n in batch.schema.names if n != "bytes"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(chunk, pa.int64())], [*names, "chunk"])

    return deal


def write_chunks(rows: DataFrame, body: Column, work: Workspace, name: str = "corpus", derived: bool = False) -> tuple[DataFrame, int]:
    """``rows`` with ``body``, ``uid`` and ``chunk``, written; and the bytes of all bodies.

    The table is bucketed by chunk, so reading it grouped by chunk, however often, moves no text. With ``derived``, the body
    is not stored but made of stored columns whenever it is read. Chunks are cut by bytes, so a run of long texts makes
    more of them and not larger ones.
    """
    sized = rows.withColumn("body", body)
    n, size = sized.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    each = max(1, min(CHUNK_BYTES, -(-(size + n) // LEAST_CHUNKS)))
    numbered = sized.withColumn("uid", F.monotonically_increasing_id()).withColumn("bytes", (F.octet_length("body") + 1).cast("long"))
    numbered = numbered.drop("body") if derived else numbered
    kinds = StructType([f for f in numbered.schema if f.name != "bytes"]).add("chunk", "long")
    buckets = min(50_000, max(partitions(rows.sparkSession), int(size / (4 * CHUNK_BYTES))))
    stored = work.put_bucketed(numbered.mapInArrow(_deal(each), kinds), name, "chunk", buckets, "uid")
    return stored.withColumn("body", body) if derived else stored, size


def owner_bits(keys: float) -> int:
    return max(2, int(np.ceil(np.log2(max(keys, 1) / OWNER_KEYS + 1))))


def parts_of(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, int, int, pa.RecordBatch | pa.Table]]:
    """(chunk, first uid, last uid, rows) of each run of one chunk."""
    chunk, uid = np.asarray(batch.column("chunk")), np.asarray(batch.column("uid"))
    cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(chunk[a]), int(uid[a]), int(uid[b - 1]), batch.slice(a, b - a)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct unsigned 64-bit keys: the number of byte planes, then the planes of the gaps."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    full = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    full[:, :width] = planes.T
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64)


def pack_numbers(values: np.ndarray) -> bytes:
    top = int(values.max()) if len(values) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack_numbers(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    full = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    full[:, :width] = planes.T
    return full.view("<u8").ravel().astype(np.int64)


def by_owner(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners of sorted keys, and where each one's keys begin (with the end)."""
    owners = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(owners, prepend=-1))
    return owners[cuts], np.append(cuts, len(keys))
