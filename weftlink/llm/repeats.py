"""Removal of repeated byte strings by threshold-bounded interval expansion.

A string of ``length`` bytes is repeated when it also starts earlier. Such strings are brought together by anchors:
each window of ``length`` bytes has one, the leftmost smallest hash among the 50-byte strings inside it, so equal
windows have equal anchors at equal places. About one position in 26 is an anchor.

1. Parts of chunks send their distinct anchor hashes to owners of hash ranges, which answer with a bitmap of
   those that some other part has too.
2. For anchors that come more than once, a part finds equal contexts (the bytes of all windows of the anchor) among its own,
   marks all but the first as repeated, and sends the first to the anchor's owner: a passage that very
   many documents share is one context a part.
3. The owner marks all but the first of equal contexts. Where an anchor has several different contexts, those that have
   a window whose hash another one has too go on (equal windows have equal hashes, so none is lost): the owner builds the
   Burrows-Wheeler transform of them and expands intervals breadth-first by backward
   extension: boundaries of common prefixes are found by increasing value, up to ``length``. What then has
   no boundary is a class of equal windows, and all but its first are repeated.
4. The marked stretches go back to their chunks, which cut them out.

Every byte of every text takes part, and the outcome doesn't depend on how rows are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .chunks import by_owner, owner_bits, pack_keys, parts_of, unpack_keys, write_chunks
from .common import Workspace, text_of
from .grams import distinct, mix, slices, text_buffers

GRAM = 50
#: Bytes that are hashed at once; bits of a place among them and a window beyond.
BLOCK, PLACE_BITS = 1 << 18, 21
#: Bytes of contexts an owner should get, about; bytes of them that are put into one transform, unless one anchor has more.
OWNER_BYTES, TRANSFORM_BYTES = 8 << 20, 1 << 20
_VALUES = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any stretch follows."""
    grams._POWERS.to(max(len(data), 1 << 16))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * grams._POWERS.up[: len(data)], out=out[1:])
    return out


def _stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * grams._POWERS.down[start] + (end - start).astype(np.uint64))


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of the texts ``data[offsets[k]:offsets[k + 1]]``: each anchor's hash, its context's hash, its place, its first and
    last window, and its text's number; places count from ``offsets[0]``. At most ``2**PLACE_BITS`` bytes."""
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets - base
    n, span = len(data), length - GRAM + 1
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    sums = _sums(data)
    gram = (sums[GRAM:] - sums[:-GRAM]) * grams._POWERS.down[: n - GRAM + 1]
    gram ^= gram >> np.uint64(32)
    gram *= np.uint64(0xD6E8FEB86659FD93)
    # high bits of the hash, then the place: the least is the leftmost smallest, of each window by doubling
    least = (gram >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[step:], least[:-step])
        width += step
    valid = np.arange(length, n + 1, dtype=np.int32) <= np.repeat(offsets[1:].astype(np.int32), np.diff(offsets))[: len(least)]
    # a window that is not inside a text lies between those of two texts
    other = least[1:] != least[:-1]
    begins, ends = valid.copy(), valid.copy()
    begins[1:] &= other | ~valid[:-1]
    ends[:-1] &= other | ~valid[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    place = (least[first] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    context = mix(_stretch(sums, first, last + length) + (place - first).astype(np.uint64))
    # minima are small numbers: mixed again, they spread over owners
    return mix(gram[place]), context, place, first, last, np.searchsorted(offsets, first, side="right") - 1


def _part_anchors(bodies: pa.Array, length: int) -> list[tuple[np.ndarray, ...]]:
    """The anchors of a part, a slice of texts at a time; places count from the part's first byte."""
    data, offsets = text_buffers(bodies)
    out = []
    for a, b in slices(offsets, BLOCK):
        low, high = int(offsets[a]), int(offsets[b])
        step = high - low if b - a > 1 else BLOCK  # a long text, in stretches that share length - 1 bytes
        for at in range(low, max(high, low + 1), max(step, 1)):
            cut = offsets[a : b + 1] if step == high - low else np.array([at, min(at + step + length - 1, high)])
            hashes, contexts, place, first, last, text = anchors_of(data, cut, length)
            shift = at - int(offsets[0])
            out.append((hashes, contexts, place + shift, first + shift, last + shift, text + a))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.uint64)] * 2 + [np.zeros(0, dtype=np.int64)] * 4


def _send(length: int, bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, low, high, rows in parts_of(batch):
                keys = distinct(_part_anchors(rows.column("body"), length)[0])
                owners, cuts = by_owner(keys, bits)
                blobs = [pack_keys(keys[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                same = [pa.array(np.full(len(owners), x)) for x in (chunk, low, high)]
                yield pa.RecordBatch.from_arrays([pa.array(owners), *same, pa.array(blobs, pa.binary())], ["owner", "chunk", "low", "high", "keys"])

    return send


def _answer(table: pa.Table) -> pa.Table:
    lists = [unpack_keys(x.as_py()) for x in table.column("keys")]
    every = np.sort(np.concatenate(lists))
    twice = distinct(every[1:][every[1:] == every[:-1]])
    bits = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in lists]
    return table.drop_columns(["keys"]).append_column("bits", pa.array(bits, pa.binary()))


def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + np.ascontiguousarray(x).tobytes() for x in arrays)


def _unblob(data: bytes, *kinds: type) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(np.frombuffer(data, kind, n, at + 8))
        at += 8 + n * np.dtype(kind).itemsize
    return out


_SENT = (np.uint64, np.int64, np.int64, np.int64, np.int64, np.int64, np.uint8)
_OUT = pa.schema([("owner", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary())])


def _differ(data: np.ndarray, at: np.ndarray, size: np.ndarray, other: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether the stretch ``data[at:at + size]`` is not the other one byte by byte."""
    out = size != other_size
    same = np.flatnonzero(~out & (at != other))
    n = size[same]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    unequal = data[np.repeat(at[same], n) + step] != data[np.repeat(other[same], n) + step]
    out[same[np.repeat(np.arange(len(same)), n)[unequal]]] = True
    return out


def _contexts(length: int, bits: int, out_bits: int):
    def contexts(rows: pa.Table, answers: pa.Table) -> pa.Table:
        """Rows to owners (owner >= 0), and covered stretches (uid, start, end) found here (owner -1)."""
        rows = rows.sort_by("uid")
        uid = rows.column("uid").to_numpy()
        answers = answers.sort_by([("low", "ascending"), ("owner", "ascending")])
        lows, highs = answers.column("low").to_numpy(), answers.column("high").to_numpy()
        out: list[tuple] = []
        for low in np.unique(lows):
            mine = np.flatnonzero(lows == low)
            a, b = np.searchsorted(uid, [low, highs[mine[0]] + 1])
            part = rows.slice(a, b - a)
            hashes, context, place, first, last, text = _part_anchors(part.column("body"), length)
            keys, inverse, many = np.unique(hashes, return_inverse=True, return_counts=True)
            _, cuts = by_owner(keys, bits)
            shared = np.concatenate([np.unpackbits(np.frombuffer(answers.column("bits")[int(i)].as_py(), np.uint8), count=y - x) for i, x, y in zip(mine, cuts[:-1], cuts[1:], strict=True)]).astype(bool)
            chosen = np.flatnonzero((shared | (many > 1))[inverse])
            if not len(chosen):
                continue
            data, offsets = text_buffers(part.column("body"))
            begin = (offsets - offsets[0])[text[chosen]]
            order, row = part.column("ord").to_numpy()[text[chosen]], uid[a:b][text[chosen]]
            first, last, place, hashes, context = first[chosen], last[chosen], place[chosen], hashes[chosen], context[chosen]
            start, wide = first - begin, last - first + 1
            rank = np.lexsort((start, row, order, context, hashes))
            head = np.ones(len(rank), dtype=bool)
            head[1:] = (context[rank][1:] != context[rank][:-1]) | (hashes[rank][1:] != hashes[rank][:-1])
            model = rank[np.maximum.accumulate(np.where(head, np.arange(len(rank)), 0))]
            head |= _differ(data, first[rank] + offsets[0], wide[rank] - 1 + length, first[model] + offsets[0], wide[model] - 1 + length)
            again = rank[~head]
            out.append((-1, int(rows.column("chunk")[0].as_py()), _blob(row[again], start[again], start[again] + wide[again] - 1 + length)))
            sent = rank[head]  # by hash, so by owner
            owners = (hashes[sent] >> np.uint64(64 - out_bits)).astype(np.int64)
            edges = np.append(np.flatnonzero(np.diff(owners, prepend=-1)), len(sent))
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                k = sent[x:y]
                size = wide[k] - 1 + length
                at = np.repeat(first[k] + offsets[0] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                out.append((int(owners[x]), int(rows.column("chunk")[0].as_py()), _blob(hashes[k], place[k] - first[k], wide[k], order[k], row[k], start[k], data[at])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, _OUT.types, strict=True)], schema=_OUT)

    return contexts


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` (codes below 512) ordered by the ``depth`` codes from each on, at least, by prefix doubling."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for k in range(7):
        key = (key << 9) | padded[k : k + n]
    known = 7
    while True:
        order = np.argsort(key)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]] - 1) != 0)
        if known >= depth or rank[order[-1]] == n:
            return order
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: max(0, n - known)] = rank[known:]
        key = rank * np.int64(n + 1) + ahead
        known *= 2


def equal_classes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of ``text`` (0: between strings), and for each row whether it differs from the row above within
    ``length`` codes, for rows without a 0 among them.

    Breadth-first on the Burrows-Wheeler transform: a boundary of value v (a row whose common prefix with the row above has v
    codes) gives, for each code c, the boundary of value v + 1 at the first row at or after it that c precedes.
    """
    order = suffix_order(text, length + 1)
    n = len(text)
    before = text[order - 1]
    counts = np.bincount(text, minlength=2)
    starts = np.cumsum(counts) - counts
    places = {c: np.flatnonzero(before == c) for c in np.flatnonzero(counts).tolist() if c}
    known = np.zeros(n + 1, dtype=bool)
    fresh = np.unique(starts[counts > 0])
    known[fresh] = True
    for _ in range(1, length):
        found = []  # by code, so in order of rows
        for c, rows in places.items():
            if len(rows) > len(fresh):
                at = np.searchsorted(rows, fresh)
            else:  # fewer rows than boundaries: those with one between them and the row before
                since = np.searchsorted(fresh, rows, side="right")
                at = np.flatnonzero(np.diff(since, prepend=0) > 0)
            found.append(starts[c] + at[at < len(rows)])
        new = np.concatenate(found) if found else fresh[:0]
        fresh = new[(np.diff(new, prepend=-1) != 0) & ~known[new]]
        if not len(fresh):
            break
        known[fresh] = True
    return order, known[:n]


def repeated_windows(bodies: list[bytes], wide: np.ndarray, order: np.ndarray, row: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts (with the earliest place of each): context and number of each window that comes earlier elsewhere, in that order."""
    sizes = np.array([len(x) + 1 for x in bodies])
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"\0".join([*bodies, b""]), np.uint8).astype(np.int64) + 1
    text[ends - 1] = 0
    rows, differs = equal_classes(text, length)
    group = np.cumsum(differs)
    begin = ends - sizes
    number = np.repeat(np.arange(len(sizes)), sizes)
    context = number[rows]
    window = rows - begin[context]
    real = np.flatnonzero(window < wide[context])
    many = np.bincount(group[real], minlength=group[-1] + 1)
    real = real[many[group[real]] > 1]
    context, window, group = context[real], window[real], group[real]
    rank = np.lexsort((start[context] + window, row[context], order[context], group))
    later = np.zeros(len(rank), dtype=bool)
    later[1:] = group[rank][1:] == group[rank][:-1]
    context, window = context[rank][later], window[rank][later]
    by = np.lexsort((window, context))
    return context[by], window[by]


def _by_bytes(hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Numbers of contexts sorted by anchor, in runs of whole anchors of about ``TRANSFORM_BYTES``."""
    heads = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, dtype=np.int64)
    filled = (np.cumsum(sizes) - sizes)[heads] // TRANSFORM_BYTES
    return np.split(np.arange(len(hashes)), heads[1:][np.diff(filled) > 0]) if len(hashes) else []


def shared_windows(bodies: list[bytes], hashes: np.ndarray, wide: np.ndarray, length: int) -> np.ndarray:
    """Of each context whether a window's hash comes again among those of its anchor; all contexts with equal windows are."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = wide + length - 1
    windows = int(wide.sum())
    context = np.repeat(np.arange(len(wide)), wide)
    at = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(wide) - wide), wide) + np.arange(windows)
    keys = _stretch(_sums(data), at, at + length) ^ hashes[context]
    rank = np.argsort(keys)
    same = keys[rank][1:] == keys[rank][:-1]
    out = np.zeros(len(wide), dtype=bool)
    out[context[rank[1:][same]]] = True
    out[context[rank[:-1][same]]] = True
    return out


def _resolve(length: int):
    def resolve(table: pa.Table) -> pa.Table:
        """An owner: covered stretches for each chunk."""
        chunks = table.column("chunk").to_numpy()
        read = [_unblob(x.as_py(), *_SENT) for x in table.column("blob")]
        hashes, offset, wide, order, row, start = (np.concatenate([x[k] for x in read]) for k in range(6))
        chunk = np.repeat(chunks, [len(x[0]) for x in read])
        bodies: list[bytes] = []
        for x in read:
            ends = np.cumsum(x[2] - 1 + length)
            whole = x[6].tobytes()
            bodies += [whole[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        number: dict[tuple[bytes, int], int] = {}
        kind = np.array([number.setdefault((b, o), len(number)) for b, o in zip(bodies, offset.tolist(), strict=True)])
        rank = np.lexsort((start, row, order, kind))
        head = np.ones(len(rank), dtype=bool)
        head[1:] = kind[rank][1:] != kind[rank][:-1]
        again, first = rank[~head], rank[head]  # first: one of each kind, in order of kind
        covers = [(chunk[again], row[again], start[again], start[again] + wide[again] - 1 + length)]
        per_hash = np.unique(hashes[first], return_inverse=True, return_counts=True)
        several = np.flatnonzero(per_hash[2][per_hash[1]] > 1)
        # anchors never share windows, so each transform takes some of them
        several = several[np.argsort(hashes[first[several]], kind="stable")]
        kept = [part[shared_windows([bodies[i] for i in first[several[part]]], hashes[first[several[part]]], wide[first[several[part]]], length)] for part in _by_bytes(hashes[first[several]], wide[first[several]] + length)]
        several = several[np.concatenate(kept)] if kept else several
        for part in _by_bytes(hashes[first[several]], wide[first[several]] + length):
            part = several[part]
            some = first[part]
            context, window = repeated_windows([bodies[i] for i in some], wide[some], order[some], row[some], start[some], length)
            breaks = np.flatnonzero((np.diff(context, prepend=-1) != 0) | (np.diff(window, prepend=-1) != 1))
            i, low, high = some[context[breaks]], window[breaks], window[np.append(breaks[1:], len(window)) - 1] if len(breaks) else breaks
            covers.append((chunk[i], row[i], start[i] + low, start[i] + high + length))
        chunk, row, low, high = (np.concatenate(x) for x in zip(*covers, strict=True))
        by = np.argsort(chunk, kind="stable")
        edges = np.flatnonzero(np.diff(chunk[by], prepend=-1))
        out = [(-1, int(chunk[k[0]]), _blob(row[k], low[k], high[k])) for k in (np.split(by, edges[1:]) if len(by) else [])]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, _OUT.types, strict=True)], schema=_OUT)

    return resolve


def _cut(with_bytes: bool):
    def cut(rows: pa.Table, covers: pa.Table) -> pa.Table:
        data, offsets = text_buffers(rows.column("body"))
        offsets = offsets.copy()
        base = int(offsets[0]) if len(offsets) else 0
        data, offsets = data[base : int(offsets[-1])], offsets - base
        uid = rows.column("uid").to_numpy()
        by = np.argsort(uid)
        change = np.zeros(len(data) + 1, dtype=np.int32)
        for x in covers.column("blob"):
            row, low, high = _unblob(x.as_py(), np.int64, np.int64, np.int64)
            at = offsets[by[np.searchsorted(uid[by], row)]]
            np.add.at(change, at + low, 1)
            np.add.at(change, at + high, -1)
        gone = np.cumsum(change[:-1]) > 0
        sizes = np.diff(offsets)
        out: list[tuple] = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            mine = gone[a:b]
            removed = int(mine.sum())
            kept = data[a:b][~mine].tobytes() if removed else data[a:b].tobytes()
            spans = int((mine[1:] & ~mine[:-1]).sum() + mine[0]) if removed else 0
            out.append((removed, spans, hashlib.sha256(kept).hexdigest(), *[kept] * with_bytes))
        names = ["n_removed", "n_spans", "kept_sha256", *["kept"] * with_bytes]
        kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * with_bytes]
        columns = {n: pa.array(c, k) for n, c, k in zip(names, zip(*out, strict=True) if out else [[]] * len(names), kinds, strict=True)}
        return pa.table({"doc_id": rows.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), **columns})

    return cut


def remove_repeats(docs: DataFrame, length: int = 100, with_bytes: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]`` for every row of ``docs``.

    A byte goes when a string of ``length`` bytes covers it that also starts earlier: in a row of a smaller
    id (null ids come last; of equal ids, the row read first) or earlier in the same text. Strings are judged on the
    input. Null texts are empty; nothing crosses texts; an empty table gives no rows; other columns
    are not read. ``length`` is at least 51, at most a million.
    """
    if not GRAM < length <= 1_000_000:
        raise ValueError(f"length must be over {GRAM} and at most a million")
    with Workspace(docs.sparkSession, "repeats") as work:
        order = F.coalesce(docs[id_column].cast("long"), F.lit((1 << 63) - 1))
        plain = docs.select(docs[id_column].alias("doc_id"), order.alias("ord"), F.encode(text_of(docs, text_column), "UTF-8").alias("body"))
        corpus, size = write_chunks(plain, F.col("body"), work)
        kind = corpus.schema["doc_id"].dataType.simpleString()
        bits = owner_bits(size / 26)
        narrow = corpus.select("chunk", "uid", "ord", "body")
        sent = narrow.mapInArrow(_send(length, bits), "owner long, chunk long, low long, high long, keys binary")
        answers = sent.groupBy("owner").applyInArrow(_answer, "owner long, chunk long, low long, high long, bits binary")
        out_bits = max(2, int(np.ceil(np.log2(size / OWNER_BYTES + 1))))
        found = narrow.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_contexts(length, bits, out_bits), "owner long, chunk long, blob binary")
        found = work.put(found, "contexts", "zstd")
        resolved = found.where("owner >= 0").groupBy("owner").applyInArrow(_resolve(length), "owner long, chunk long, blob binary")
        covers = work.put(found.where("owner < 0").unionByName(resolved), "covers", "zstd")
        kept = ", kept binary" if with_bytes else ""
        out = corpus.groupBy("chunk").cogroup(covers.groupBy("chunk")).applyInArrow(_cut(with_bytes), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{kept}")
        out = work.put(out, "result")
        work.clear("result")
        return out
