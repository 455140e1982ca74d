"""Best-fit-decreasing packing of tokenised documents into sequences.

Sizes are whole numbers up to the sequence length, so best-fit decreasing depends only on how many
pieces there are of each size. The driver packs that histogram (one number a size) with a segment
tree over remaining capacities, which gives the tightest open bin in logarithmic time; equal bins
are kept as runs, so its work is bounded by the sequence length and not by the number of documents.
Each piece then finds its bin by its rank among the pieces of its size. The result is that of one
sequential best-fit-decreasing pass over all pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, text_of
from .grams import LOWER, block_words, slices, text_buffers


class WordTokens:
    """Token ids of texts by a tokenizer that never joins what white space parts and ignores the case of A-Z.

    A block's words are found, hashed and made distinct as arrays; each distinct word is encoded once and its ids kept,
    until ``limit`` words are held; then the store starts anew, so memory is bounded. Kept ids are only used for a word
    of the same bytes: a hash finds them, the bytes decide.
    """

    def __init__(self, path: str, limit: int = 800_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.plain = regex.compile(r"[\p{L}\x21-\x7e]+")
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[int, int] = {}
        none = np.zeros(0, dtype=np.int64)
        self.first, self.sizes, self.store, self.filled = none, none, np.zeros(1 << 16, dtype="<u4"), 0
        self.begin, self.width, self.letters = none, none, np.zeros(0, dtype=np.uint8)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _encoded(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Numbers of some words, their ids one after another, and how many each has. A word of letters and ASCII marks has as many
        word-end tokens as the pattern finds parts in it, so many are encoded as one text; others go alone."""
        easy = [k for k, w in enumerate(words) if w.isascii() and w.isprintable() or self.plain.fullmatch(w) and "İ" not in w]
        alone = sorted(set(range(len(words))).difference(easy))
        for at in range(0, len(easy), 512):
            some = easy[at : at + 512]
            ids = self.whole(" ".join([words[k] for k in some]))
            parts = np.cumsum([1 if words[k].isalpha() else len(self.parts.findall(words[k].lower())) for k in some])
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == parts[-1] and stops[-1] == len(ids):
                yield some, ids, np.diff(stops[parts - 1], prepend=0)
            else:
                alone += some
        for k in alone:
            ids = self.whole(words[k])
            yield [k], ids, np.array([len(ids)])

    def _learn(self, keys: list[int], words: list[bytes]) -> np.ndarray:
        """The rows that ``words`` get; those of ``keys``, one for each word or none, can be found again."""
        order, ids, sizes = zip(*self._encoded([w.decode() for w in words]), strict=True)
        order, ids, sizes = [k for x in order for k in x], np.concatenate(ids), np.concatenate(sizes)
        widths = np.array([len(words[k]) for k in order], dtype=np.int64)
        need = self.filled + len(ids)
        if need > len(self.store):
            self.store = np.concatenate([self.store[: self.filled], np.zeros(max(need, len(self.store)), dtype="<u4")])
        self.store[self.filled : need] = ids
        known = len(self.sizes)
        if keys:
            self.rows.update(zip([keys[k] for k in order], range(known, known + len(order)), strict=True))
        self.first = np.append(self.first, self.filled + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.begin = np.append(self.begin, len(self.letters) + np.cumsum(widths) - widths)
        self.width = np.append(self.width, widths)
        self.letters = np.append(self.letters, LOWER[np.frombuffer(b"".join([words[k] for k in order]), np.uint8)])
        self.filled = need
        rows = np.empty(len(order), dtype=np.int64)
        rows[order] = known + np.arange(len(order))
        return rows

    def _others(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Words of the block whose bytes are not those of their row."""
        kind = np.int32 if max(len(data), len(self.letters)) < 1 << 31 else np.int64
        wide = end - start
        other = self.width[row] != wide
        same = np.flatnonzero(~other)
        size = wide[same]
        place = np.arange(int(size.sum()), dtype=kind)
        before = np.cumsum(size) - size
        here = place + np.repeat((start[same] - before).astype(kind), size)
        there = place + np.repeat((self.begin[row[same]] - before).astype(kind), size)
        differ = np.flatnonzero(LOWER[data[here]] != self.letters[there])
        other[same[np.searchsorted(before, differ, side="right") - 1]] = True
        return np.flatnonzero(other)

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        start, end, hashes = block_words(data, offsets)
        keys, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.sizes) > self.limit:
            self._forget()
        listed = keys.tolist()
        row = np.fromiter(map(self.rows.get, listed, repeat(-1)), np.int64, len(listed))
        new = np.flatnonzero(row < 0)
        raw = data.tobytes()

        def said(which: np.ndarray) -> list[bytes]:
            return [raw[a:b] for a, b in zip(start[which].tolist(), end[which].tolist(), strict=True)]

        if len(new):
            row[new] = self._learn(keys[new].tolist(), said(sample[new]))
        row = row[inverse]
        others = self._others(data, start, end, row) if len(row) else row
        if len(others):
            row[others] = self._learn([], said(others))
        sizes, first = self.sizes[row], self.first[row]
        stops = np.cumsum(sizes)
        ids = self.store[np.repeat(first - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)]
        cuts = np.concatenate([[0], stops])[np.searchsorted(start, offsets)].tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield ids[a:b].tobytes()

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text of an Arrow column."""
        data, offsets = text_buffers(texts)
        for a, b in slices(offsets):
            block = data[offsets[a] : offsets[b]]
            own = offsets[a : b + 1] - offsets[a]
            raw = block.tobytes() if (block == 124).any() else b""
            marked = b"<|" in raw  # may be a token of its own, whose case counts
            for k, ids in enumerate(self._block(block, own)):
                text = raw[own[k] : own[k + 1]] if marked else b""
                yield self.whole(text.decode()).tobytes() if b"<|" in text else ids


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """The words that this Python worker has learned, which its later tasks go on with; bounded by their ``limit``."""
    return WordTokens(path)


class OpenBins:
    """Segment tree over remaining capacities: which of them some open bin has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _mark(self, capacity: int) -> None:
        at = self.leaves + capacity
        self.any[at] = bool(self.runs[capacity])
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def push(self, capacity: int, first: int, count: int) -> None:
        if capacity and count:
            self.runs[capacity].append((first, count))
            self._mark(capacity)

    def pop(self, capacity: int) -> tuple[int, int]:
        run = self.runs[capacity].pop()
        self._mark(capacity)
        return run

    def tightest(self, size: int) -> int | None:
        """The smallest capacity of at least ``size`` that an open bin has."""
        at = self.leaves + size
        if self.any[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at + (not self.any[2 * at])
                return at - self.leaves
            at //= 2
        return None


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Where the pieces of each size go, and the number of bins. ``counts[s]``: pieces of size s.

    Rows of the plan: size, first rank, pieces, first bin, pieces a bin, offset. The j-th piece of a row goes
    to bin ``first + j // per_bin`` at ``offset + (j % per_bin) * size``.
    """
    plan, bins, tree = [], 0, OpenBins(capacity)
    for size in range(capacity, 0, -1):
        rank, left = 0, int(counts[size])
        while left:
            room = tree.tightest(size)
            if room is None:
                room, each = capacity, capacity // size
                first, count = bins, -(-left // each)
                bins += count
            else:
                first, count = tree.pop(room)
                each = room // size
            n = min(left, count * each)
            full, part = divmod(n, each)
            plan.append((size, rank, n, first, each, capacity - room))
            tree.push(room - each * size, first, full)
            tree.push(room - part * size, first + full, 1 if part else 0)
            tree.push(room, first + full + bool(part), count - full - bool(part))
            rank, left = rank + n, left - n
    return np.array(plan, dtype=np.int64).reshape(-1, 6), bins


def _pieces(tokenizer_path: str | None, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        tokens = word_tokens(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))
        chunk, end, step = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes(), 4 * capacity
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            source, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
            for k, body in enumerate(tokens.encode(batch.column(1))):
                body += end
                for j, at in enumerate(range(0, len(body), step)):
                    part = body[at : at + step]
                    n = len(part) // 4
                    source.append(k)
                    piece.append(j)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    rank.append(seen[n])
                    seen[n] += 1
                    if with_ids:
                        ids.append(part)
            columns = [batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(x, k) for x, k in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), (rank, pa.int64())))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            columns.append(pa.array(np.full(len(source), chunk), pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, [*names, "chunk"])

    return run


def pack_documents(
    docs: DataFrame, capacity: int = 2048, tokenizer_path: str | None = None, end_id: int = 0, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset``.

    A document is its token ids and ``end_id``; null text is empty, so it is ``end_id`` alone. Only documents of
    more than ``capacity`` ids are cut. ``ids`` (with_ids) are little-endian unsigned 32-bit ids. Repeated rows are
    packed as often as they come; null ids are kept; an empty table gives no rows; other columns are not read.
    """
    with Workspace(docs.sparkSession, "packing") as work:
        plain = docs.select(docs[id_column].alias("doc_id"), text_of(docs, text_column).alias("body"))
        kind = plain.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, rank long, {'ids binary, ' * with_ids}chunk int"
        pieces = work.put(plain.mapInArrow(_pieces(tokenizer_path, capacity, end_id, with_ids), schema), "pieces")

        by_chunk = work.put(pieces.groupBy("length", "chunk").agg(F.count("*").alias("n")), "counts")
        counts = np.zeros(capacity + 1, dtype=np.int64)
        for row in by_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
            counts[row["length"]] = row["n"]
        plan, _ = best_fit_decreasing(counts, capacity)
        shift = np.int64(48)
        keys = (plan[:, 0] << shift) + plan[:, 1]
        order = np.argsort(keys)
        keys, plan = keys[order], plan[order]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
                row = plan[np.searchsorted(keys, (length << shift) + rank, side="right") - 1]
                j = rank - row[:, 1]
                kept = {n: batch.column(n) for n in batch.schema.names if n != "rank"}
                yield pa.RecordBatch.from_pydict(kept | {"sequence_id": pa.array(row[:, 3] + j // row[:, 4]), "offset": pa.array(row[:, 5] + j % row[:, 4] * length)})

        before = F.expr("sum(n) over (partition by length order by chunk) - n")
        ranked = pieces.join(by_chunk.select("length", "chunk", before.alias("before")), ["length", "chunk"])
        ids = ["ids"] if with_ids else []
        ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *ids, (F.col("rank") + F.col("before")).alias("rank"))
        out = ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, {'ids binary, ' * with_ids}sequence_id long, offset long")
        out = work.put(out, "packed")
        work.clear("packed")
        return out
