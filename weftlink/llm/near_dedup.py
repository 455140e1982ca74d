"""Near-duplicates by MinHash in an LSH forest.

1. Each text becomes its set of 5-word shingles (64-bit hashes), and the set a signature of 128 minima. Texts of
   one set are one node from here on, so exact copies are never compared.
2. Every tree orders signatures by its own order of the minima: 32 trees, first levels disjoint. Nodes with
   one prefix of four minima form a region. In a small region all are candidates of each other. A larger
   one is cut deeper, minimum by minimum, as long as it is large; at every depth its nodes are
   candidates of their neighbours of longest common prefix in the sorted order and of the region's hub, the node
   that agrees best with its commonest minima. So these candidates are linear in the nodes, in regions of any size.
3. Candidates are confirmed on full sets, in rounds. The first takes each node's two most promising pairs; in the next ones each
   component that is left takes up to 8, then up to 64 pairs with others; the last takes every other candidate pair whose nodes
   are still apart. Pairs inside a component would not change it, and a large group of near copies is one component long before
   its pairs are all confirmed.
4. In larger regions every pair that is still apart is tested too, in blocks: all rows outside the region's largest
   component against all rows. Parity sketches of the sets bound their difference from below, so that only pairs
   that can't be linked go before the full sets are confirmed; none is lost. What is connected costs nothing
   here, and many texts of one region that are not linked cost the square of their number.
5. Components spread by smallest labels.

With similarity 0.75 or more, a pair shares a region in at least one of 32 trees with a probability of 0.999995.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import pack_keys, unpack_keys, write_chunks
from .common import Workspace, carried, partitions, text_of, unpacked
from .components import connected
from .grams import distinct, mix, run_hashes, text_buffers, words_of

MINIMA, TREES, REGION_LEVELS, LEVELS = 128, 32, 4, 12
#: Nodes of a region that are all compared; neighbours on each side in a larger one.
SMALL, NEAR = 6, 3
#: Rows of one region that are held at once; a larger region is taken in stretches of its sorted order, with hubs of the whole.
STRETCH = 100_000
#: Members that are confirmed against one centre in one task.
BLOCK_MEMBERS = 256
#: Rows on each side of a block in which all pairs of a region are tested.
BLOCK_ROWS = 1024
#: Pairs that a component takes in a round between the first and the last.
SHARES = (8, 64)
#: Bits of a parity sketch.
SKETCH = 4096

_RANDOM = np.random.default_rng(31_337)
_FACTORS = (_RANDOM.integers(1, 1 << 32, MINIMA, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SHIFTS = _RANDOM.integers(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)


def _tree_orders() -> np.ndarray:
    """Places of the signature in each tree's order: the first levels of trees share none."""
    out = np.zeros((TREES, LEVELS), dtype=np.int64)
    for t in range(TREES):
        own = np.arange(t * REGION_LEVELS, (t + 1) * REGION_LEVELS)
        rest = np.setdiff1d(np.arange(MINIMA), own)
        out[t] = np.concatenate([own, _RANDOM.permutation(rest)[: LEVELS - REGION_LEVELS]])
    return out


ORDERS = _tree_orders()


def shingle_sets(bodies: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one of the whole sequence if it has fewer words."""
    every, starts = words_of(*text_buffers(bodies))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        own = every[a:b]
        yield distinct(run_hashes(own, words) if b - a >= words else run_hashes(own, b - a) if b > a else own)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 4096):
        np.minimum(out, (high[None, at : at + 4096] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1), out=out)
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Of each of 4096 classes of shingles whether their number is odd: sketches of two sets differ in no more bits than the sets in shingles."""
    classes = (mix(shingles + np.uint64(0xA24BAED4963EE407)) % np.uint64(SKETCH)).astype(np.int64)
    return np.packbits(np.bincount(classes, minlength=SKETCH) & 1).view(np.uint64)


def may_link(sketches_a: np.ndarray, sizes_a: np.ndarray, sketches_b: np.ndarray, sizes_b: np.ndarray, percent: int) -> np.ndarray:
    """False only for pairs of sets that can't be linked: linked ones differ in (100 - percent) of (100 + percent) parts of both at most."""
    differ = np.bitwise_count(sketches_a ^ sketches_b).sum(axis=1, dtype=np.int64)
    return (100 + percent) * np.maximum(differ, np.abs(sizes_a - sizes_b)) <= (100 - percent) * (sizes_a + sizes_b)


def _describe(words: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ones, twos, signs, sketches = [], [], [], [], []
            for found in shingle_sets(batch.column("body"), words):
                sizes.append(len(found))
                ones.append(int(mix(found).sum().astype(np.int64)) if len(found) else 0)
                twos.append(int(np.bitwise_xor.reduce(mix(found + np.uint64(0x632BE59BD9B4E019))).astype(np.int64)) if len(found) else 0)
                signs.append(signature(found).tobytes())
                sketches.append(sketch(found).tobytes())
            new = [pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(signs, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("chunk", "uid", "ord", "doc_id")] + new, ["chunk", "uid", "ord", "doc_id", "n_shingles", "set_a", "set_b", "sign", "sketch"])

    return describe


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signs = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint32).reshape(-1, MINIMA)
        uid = batch.column("uid")
        for t in range(TREES):
            ordered = signs[:, ORDERS[t]]
            region = np.full(len(signs), t, dtype=np.uint64)
            for k in range(REGION_LEVELS):
                region = mix(region + ordered[:, k].astype(np.uint64))
            rest = np.ascontiguousarray(ordered[:, REGION_LEVELS:].astype(">u2"))
            yield pa.RecordBatch.from_arrays([pa.array(region.astype(np.int64)), pa.array([x.tobytes() for x in rest], pa.binary()), uid], ["region", "rest", "uid"])


def region_pairs(rest: np.ndarray, uid: np.ndarray) -> np.ndarray:
    """Candidate pairs (smaller, larger) of a region whose rows are sorted by ``rest`` (rows x deeper levels)."""
    m = len(uid)
    if m <= SMALL:
        a, b = np.triu_indices(m, 1)
        return np.column_stack([np.minimum(uid[a], uid[b]), np.maximum(uid[a], uid[b])])
    pairs = [np.column_stack([uid[:-k], uid[k:]]) for k in range(1, NEAR + 1)]
    same = np.ones(m - 1, dtype=bool)
    for depth in range(rest.shape[1] - 1):
        edges = np.flatnonzero(np.concatenate([[True], ~same]))
        sizes = np.diff(np.append(edges, m))
        big = np.flatnonzero(sizes > SMALL)
        if not len(big):
            break
        # agreement of every row with the commonest value of each further level of its part
        part = np.repeat(np.arange(len(edges)), sizes)
        agree = np.zeros(m, dtype=np.int64)
        for level in range(depth, rest.shape[1]):
            value = part.astype(np.int64) << 16 | rest[:, level]
            _, inverse, many = np.unique(value, return_inverse=True, return_counts=True)
            top = np.zeros(len(edges), dtype=np.int64)
            np.maximum.at(top, part, many[inverse])
            agree += many[inverse] == top[part]
        best = np.lexsort((uid, -agree, part))
        hub = uid[best[edges]]
        inside = np.isin(part, big)
        pairs.append(np.column_stack([hub[part[inside]], uid[inside]]))
        same &= rest[1:, depth] == rest[:-1, depth]
    every = np.concatenate(pairs)
    every = every[every[:, 0] != every[:, 1]]
    return np.unique(np.column_stack([every.min(axis=1), every.max(axis=1)]), axis=0)


def _candidates(batches: Iterator[pa.RecordBatch], stretch: int = STRETCH) -> Iterator[pa.RecordBatch]:
    """Pairs of sorted rows (a, b, votes), region after region, and the rows of regions of over SMALL (region, uid, 0, rest).

    Of a region of over ``stretch`` rows, what is complete is taken at once: the parts of one prefix before the one that
    is open, for which the rows held suffice. Parts of over ``stretch`` rows get their hubs from ``wide_hubs``.
    """
    held: list[np.ndarray] | None = None
    width = 2 * (LEVELS - REGION_LEVELS)
    carried = 0  # rows of the last stretch at the start of held
    out: list[np.ndarray] = []
    members: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def done(region: np.ndarray, rest: np.ndarray, uid: np.ndarray, large: bool, skip: int) -> None:
        """``large``: the first region, without its first ``skip`` rows, belongs to one over SMALL."""
        cuts = np.append(np.flatnonzero(np.diff(region, prepend=region[0] - 1)), len(region))
        sizes = np.diff(cuts)
        for k in np.flatnonzero((sizes > 1) | ((np.arange(len(sizes)) == 0) & large)).tolist():
            a, b = int(cuts[k]), int(cuts[k + 1])
            if b - a == 2:
                out.append(np.array([[min(uid[a], uid[a + 1]), max(uid[a], uid[a + 1])]]))
            else:
                out.append(region_pairs(rest[a:b], uid[a:b]))
            first = large and k == 0
            if b - a > SMALL or first:
                a += skip if first else 0
                members.append((region[a:b], uid[a:b], rest[a:b]))

    def flush() -> Iterator[pa.RecordBatch]:
        every = np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)
        out.clear()
        pairs, votes = np.unique(every, axis=0, return_counts=True)
        names = ["a", "b", "votes", "rest"]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64()), pa.array(votes, pa.int64()), pa.nulls(len(pairs), pa.binary())], names)
        if members:
            region, uid, rest = (np.concatenate(x) for x in zip(*members, strict=True))
            members.clear()
            yield pa.RecordBatch.from_arrays([pa.array(region, pa.int64()), pa.array(uid, pa.int64()), pa.array(np.zeros(len(uid), dtype=np.int64)), pa.array([x.tobytes() for x in rest.astype(">u2")], pa.binary())], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        rest = np.frombuffer(b"".join(batch.column("rest").to_pylist()), ">u2").reshape(-1, width // 2).astype(np.int64)
        new = [batch.column("region").to_numpy(), rest, batch.column("uid").to_numpy()]
        held = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new, strict=True)]
        last = int(np.searchsorted(held[0], held[0][-1]))  # regions before the last one are complete
        if last:
            done(*(x[:last] for x in held), carried > 0, carried)
            held, carried = [x[last:] for x in held], 0
        elif len(held[0]) - carried > stretch:
            starts = np.logical_and.accumulate(held[1] == held[1][-1], axis=1).argmax(axis=0)  # of the open part at each depth
            later = starts[starts > carried]
            cut = int(later[0]) if len(later) else len(held[0])
            done(*(x[:cut] for x in held), True, carried)
            begin = max(0, cut - NEAR)
            held, carried = [x[begin:] for x in held], cut - begin
        if sum(map(len, out)) > 500_000:
            yield from flush()
    if held is not None:
        done(*held, carried > 0, carried)
    yield from flush()


def wide_hubs(members: DataFrame, stretch: int = STRETCH) -> DataFrame | None:
    """Pairs (a, b) of the hub of each part of over ``stretch`` rows with all its rows, by sums over the whole part.

    ``members``: region, uid, rest. As in ``region_pairs``, a part is what shares a region and a prefix, and its hub agrees best
    with the commonest minima of the levels from there on. There are few such parts, so they are broadcast.
    """
    out, rows, levels = None, members, LEVELS - REGION_LEVELS
    minimum = lambda level: F.expr(f"substring(rest, {2 * level + 1}, 2)")
    for depth in range(levels - 1):
        rows = rows.select("region", F.expr(f"substring(rest, 1, {2 * depth})").alias("prefix"), "rest", "uid")
        wide = rows.groupBy("region", "prefix").agg(F.count("*").alias("m")).where(F.col("m") > stretch).drop("m")
        if wide.isEmpty():
            break
        rows = rows.join(F.broadcast(wide), ["region", "prefix"])
        values = rows.select("region", "prefix", F.posexplode(F.array(*[minimum(x) for x in range(depth, levels)])).alias("level", "value"))
        many = values.groupBy("region", "prefix", "level", "value").agg(F.count("*").alias("n"))
        common = many.groupBy("region", "prefix", "level").agg(F.max(F.struct("n", "value")).alias("most"))
        common = common.groupBy("region", "prefix").agg(F.map_from_entries(F.collect_list(F.struct("level", "most.value"))).alias("common"))
        agree = sum((F.when(F.col("common")[F.lit(x - depth)] == minimum(x), 1).otherwise(0) for x in range(depth, levels)), F.lit(0))
        hubs = rows.join(F.broadcast(common), ["region", "prefix"]).groupBy("region", "prefix").agg((-F.max(F.struct(agree.alias("agree"), (-F.col("uid")).alias("u")))["u"]).alias("hub"))
        pairs = rows.join(F.broadcast(hubs), ["region", "prefix"]).where("uid <> hub").select(F.least("uid", "hub").alias("a"), F.greatest("uid", "hub").alias("b"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def sketches_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


def _block_pairs(percent: int):
    """Pairs of rows sorted by block: those on the left against all, if their labels differ and sketches don't rule a link out."""

    def block(left: np.ndarray, top: np.ndarray, uid: np.ndarray, label: np.ndarray, size: np.ndarray, bits: np.ndarray) -> np.ndarray:
        out, right = [np.zeros((0, 2), dtype=np.int64)], np.flatnonzero(~left)
        for k in np.flatnonzero(left).tolist():
            # two rows outside the largest component meet twice
            other = right[(label[right] != label[k]) & (top[right] | (uid[right] > uid[k]))]
            other = other[may_link(bits[other], size[other], bits[k], size[k], percent)]
            out.append(np.column_stack([np.minimum(uid[other], uid[k]), np.maximum(uid[other], uid[k])]))
        return np.concatenate(out)

    def found(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cuts = np.append(np.flatnonzero(np.diff(held[0], prepend=held[0][0] - 1)), len(held[0]))
        out = [block(*(x[a:b] for x in held[1:])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        pairs = np.unique(np.concatenate(out), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("block", "left", "top", "uid", "label", "n_shingles")] + [sketches_of(batch.column("sketch"))]
            held = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1]))  # blocks before the last one are complete
            if last:
                yield from found([x[:last] for x in held])
                held = [x[last:] for x in held]
        if held is not None:
            yield from found(held)

    return pairs


def region_rest(members: DataFrame, labels: DataFrame, known: DataFrame, work: Workspace, percent: int) -> DataFrame:
    """Pairs (a, b) that share a region of ``members`` (region, uid), are apart by ``labels`` (node, label) and may be linked.

    Rows outside a region's largest component go to the left of blocks, all rows to the right, each to every block
    that its pairs are in; regions of one component have none.
    """
    told = members.join(labels, members["uid"] == labels["node"], "left").select("region", "uid", F.coalesce("label", "uid").alias("label"))
    told = work.put(told, "told")
    regions = told.groupBy("region", "label").agg(F.count("*").alias("n")).groupBy("region").agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("most"))
    regions = regions.where("all > most.n").select("region", F.col("most.label").alias("most"), F.ceil((F.col("all") - F.col("most.n")) / BLOCK_ROWS).alias("lefts"), F.ceil(F.col("all") / BLOCK_ROWS).alias("rights"))
    mixed = work.put(told.join(regions, "region"), "mixed")
    rows = known.join(mixed, "uid").withColumn("top", F.col("label") == F.col("most"))
    own = lambda many: F.pmod(F.xxhash64("uid"), many)
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1))
    left = rows.where("not top").withColumn("x", own(F.col("lefts"))).withColumn("y", every("rights")).withColumn("left", F.lit(True))
    right = rows.withColumn("x", every("lefts")).withColumn("y", own(F.col("rights"))).withColumn("left", F.lit(False))
    sent = left.unionByName(right).select(F.xxhash64("region", "x", "y").alias("block"), "left", "top", "uid", "label", "n_shingles", "sketch")
    sent = sent.repartition(partitions(known.sparkSession), "block").sortWithinPartitions("block")
    return sent.mapInArrow(_block_pairs(percent), "a long, b long").distinct()


def _serve(words: int):
    def serve(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        """The set of each wanted row of a chunk, for each block that wants it."""
        uids = np.unique(wanted.column("uid").to_numpy())
        mine = rows.filter(pc.is_in(rows.column("uid"), value_set=pa.array(uids)))
        sets = {u: pack_keys(x) if len(x) else b"" for u, x in zip(mine.column("uid").to_pylist(), shingle_sets(mine.column("body"), words), strict=True)} if len(mine) else {}
        return wanted.drop_columns(["chunk"]).append_column("shingles", pa.array([sets[u] for u in wanted.column("uid").to_pylist()], pa.binary()))

    return serve


def _confirm(percent: int):
    def confirm(table: pa.Table) -> pa.Table:
        """Members of a block that are linked with its centre."""
        centre = table.column("centre").to_numpy(zero_copy_only=False).astype(bool)
        uid, packed = table.column("uid").to_numpy(), table.column("shingles")
        at = int(np.flatnonzero(centre)[0])
        whole = unpack_keys(packed[at].as_py())
        linked = []
        for k in np.flatnonzero(~centre).tolist():
            own = unpack_keys(packed[k].as_py())
            place = np.minimum(np.searchsorted(whole, own), len(whole) - 1)
            both = int((whole[place] == own).sum())
            if 100 * both >= percent * (len(whole) + len(own) - both):
                linked.append(uid[k])
        return pa.table({"a": pa.array([uid[at]] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    return confirm


def confirm_pairs(pairs: DataFrame, where: DataFrame, corpus: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are linked, by their full sets; ``where``: uid, chunk.

    The node with more pairs is the centre; its members are dealt to blocks, so a centre of very many is no hot key,
    and each set travels once for a pair and once for a block.
    """
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("many"))
    of_a = ends.select(F.col("node").alias("a"), F.col("many").alias("many_a"))
    of_b = ends.select(F.col("node").alias("b"), F.col("many").alias("many_b"))
    counted = pairs.select("a", "b").join(of_a, "a").join(of_b, "b")
    by_a = F.col("many_a") >= F.col("many_b")
    block = F.pmod(F.xxhash64(F.when(by_a, F.col("b")).otherwise(F.col("a"))), F.ceil(F.greatest("many_a", "many_b") / BLOCK_MEMBERS))
    dealt = counted.select(F.when(by_a, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(by_a, F.col("b")).otherwise(F.col("a")).alias("uid"), block.alias("block"))
    members = dealt.select("hub", "block", "uid", F.lit(False).alias("centre"))
    centres = dealt.select("hub", "block", F.col("hub").alias("uid"), F.lit(True).alias("centre")).distinct()
    wanted = members.unionByName(centres).join(where.select("uid", "chunk"), "uid")
    served = corpus.select("chunk", "uid", "body").groupBy("chunk").cogroup(wanted.select("chunk", "uid", "hub", "block", "centre").groupBy("chunk"))
    served = served.applyInArrow(_serve(words), "uid long, hub long, block long, centre boolean, shingles binary")
    return served.groupBy("hub", "block").applyInArrow(_confirm(percent), "a long, b long")


def _possible(percent: int):
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (bits_a, size_a), (bits_b, size_b) = ((sketches_of(batch.column(f"sketch_{n}")), batch.column(f"size_{n}").to_numpy()) for n in "ab")
            kept = pa.array(may_link(bits_a, size_a, bits_b, size_b, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])

    return possible


def told_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """All of ``pairs`` (a, b) whose nodes are apart by ``labels``, with their components la and lb."""
    la, lb = (labels.select(F.col("node").alias(n), F.col("label").alias(f"l{n}")) for n in ("a", "b"))
    told = pairs.join(la, "a", "left").join(lb, "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    return told.where("la <> lb")


def apart_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """All of ``pairs`` (a, b) whose nodes are apart by ``labels``."""
    return told_pairs(pairs, labels).select("a", "b")


def shared_out(told: DataFrame, most: int) -> DataFrame:
    """Of pairs (a, b, la, lb) up to ``most`` of each component: one of each class of pairs by hash, so by partial aggregates."""
    pair = F.struct("a", "b")
    sides = told.select(F.col("la").alias("l"), pair.alias("pair")).unionByName(told.select(F.col("lb").alias("l"), pair.alias("pair")))
    of = F.xxhash64("pair.a", "pair.b")
    kept = sides.groupBy("l", F.pmod(of, F.lit(most)).alias("class")).agg(F.max(F.struct(of.alias("h"), F.col("pair").alias("pair"))).alias("x"))
    return kept.select("x.pair.a", "x.pair.b").distinct()


def possible_pairs(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """``pairs`` without those that sketches rule out; ``known``: uid, n_shingles, sketch."""
    beside = pairs.join(known.toDF("a", "size_a", "sketch_a"), "a").join(known.toDF("b", "size_b", "sketch_b"), "b")
    return beside.mapInArrow(_possible(percent), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, uid`` for every row of ``docs``.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Rows are linked when
    ``100 * |both| >= percent * |either|`` of their shingle sets; the component is what links reach, and its id the smallest
    doc_id in it. One row of a component is kept: that of the smallest id, and of rows that repeat this id
    the first read. Null ids come last. Texts without words, or null, are linked with nothing and kept. An empty
    table gives no rows; other columns are not read.
    """
    with Workspace(docs.sparkSession, "near-dedup") as work:
        corpus, _ = write_chunks(_plain(docs, id_column, text_column), F.col("body"), work)
        out = work.put(_components(corpus, work, words, percent), "result")
        work.clear("result")
        return out


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, of any names, that ``near_duplicates`` keeps: one of each component.

    Null texts and texts without words stay; of repeated rows, and of rows that share the smallest id, the first read stays; null ids
    come last. An empty table gives an empty one.
    """
    with Workspace(docs.sparkSession, "near-dedup") as work:
        plain = _plain(carried(docs, id=id_column, text=text_column), "id", "text", "row").drop("body")
        text = F.coalesce(F.col("row")[f"c{docs.columns.index(text_column)}"].cast("string"), F.lit(""))
        corpus, _ = write_chunks(plain, text, work, derived=True)
        kept = work.put(_components(corpus, work, words, percent), "result").where("kept").select("uid")
        rows = corpus.join(kept, "uid", "left_semi").select(*unpacked(docs.columns))
        out = work.put(rows, "rows-kept", "zstd")
        work.clear("rows-kept")
        return out


def _plain(docs: DataFrame, id_column: str, text_column: str, *more) -> DataFrame:
    order = F.coalesce(docs[id_column].cast("long"), F.lit((1 << 63) - 1))
    return docs.select(docs[id_column].alias("doc_id"), order.alias("ord"), text_of(docs, text_column).alias("body"), *more)


def _components(corpus: DataFrame, work: Workspace, words: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, uid`` of a corpus in chunks (chunk, uid, ord, doc_id, body)."""
    spark = corpus.sparkSession
    kind = corpus.schema["doc_id"].dataType.simpleString()
    described = corpus.select("chunk", "uid", "ord", "doc_id", "body").mapInArrow(_describe(words), f"chunk long, uid long, ord long, doc_id {kind}, n_shingles long, set_a long, set_b long, sign binary, sketch binary")
    described = work.put(described, "described")
    ledger = described.drop("sign", "sketch")

    full = described.where("n_shingles > 0").select("set_a", "set_b", "n_shingles", F.struct("ord", "uid", "chunk", "sign").alias("first"))
    nodes = full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("first").alias("first"))
    nodes = work.put(nodes.select("set_a", "set_b", "n_shingles", "first.uid", "first.chunk", "first.sign"), "nodes")
    where = nodes.select("uid", "chunk")
    deals = max(partitions(spark), nodes.count() * TREES // 500_000)
    trees = nodes.select("uid", "sign").mapInArrow(_tree_rows, "region long, rest binary, uid long")
    trees = trees.repartition(deals, "region").sortWithinPartitions("region", "rest", "uid")
    found = work.put(trees.mapInArrow(_candidates, "a long, b long, votes long, rest binary"), "found")
    members = found.where("votes = 0").select(F.col("a").alias("region"), F.col("b").alias("uid"), "rest")
    pairs = found.where("votes > 0").select("a", "b", "votes")
    hubs = wide_hubs(members)
    if hubs is not None:
        pairs = pairs.unionByName(hubs.withColumn("votes", F.lit(1).cast("long")))
    pairs = pairs.groupBy("a", "b").agg(F.sum("votes").alias("votes"))
    pairs = work.put(pairs, "pairs")

    # each node's pair of most trees, and its pair with the smallest partner among those of many trees
    sides = pairs.select(F.col("a").alias("n"), F.col("b").alias("m"), "a", "b", "votes").unionByName(pairs.select(F.col("b").alias("n"), F.col("a").alias("m"), "a", "b", "votes"))
    pick = F.struct(F.col("votes"), -F.col("m"), "a", "b")
    low = F.struct(F.when(F.col("votes") >= 8, 0).otherwise(1), F.col("m"), "a", "b")
    best = sides.groupBy("n").agg(F.max(pick).alias("x"), F.min(low).alias("y"))
    first = best.select("x.a", "x.b").unionByName(best.select("y.a", "y.b")).distinct()
    first = work.put(first, "first")
    links = work.put(confirm_pairs(first, where, corpus, words, percent), "links-1")
    labels = connected(links, work, "round-1")

    known = described.select("uid", "n_shingles", "sketch")
    apart = work.put(apart_pairs(pairs.join(first, ["a", "b"], "left_anti"), labels), "apart")
    ends = work.put(apart.select(F.col("a").alias("uid")).unionByName(apart.select(F.col("b").alias("uid"))).distinct(), "ends")
    left = work.put(possible_pairs(apart, work.put(known.join(ends, "uid"), "known"), percent), "left")
    work.drop("pairs", "first", "apart", "ends", "known")

    def joined(more: DataFrame, labels: DataFrame, name: str) -> DataFrame:
        """Labels after new links: components are nodes of a small graph, so no old link is carried on."""
        edges = work.put(told_pairs(more, labels).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), f"links-{name}")
        if edges.isEmpty():
            return labels
        merged = connected(edges, work, name).select(F.col("node").alias("m_node"), F.col("label").alias("m_label"))
        old = labels.join(merged, labels["label"] == merged["m_node"], "left").select("node", F.coalesce("m_label", "label").alias("label"))
        new = merged.join(labels, merged["m_node"] == labels["node"], "left_anti").select(F.col("m_node").alias("node"), F.col("m_label").alias("label"))
        return work.put(old.unionByName(new), f"labels-{name}")

    for turn, most in enumerate([*SHARES, None], 2):
        told = work.put(told_pairs(left, labels), f"told-{turn}")
        if told.isEmpty():
            break
        chosen = work.put(shared_out(told, most) if most else told.select("a", "b"), f"chosen-{turn}")
        labels = joined(confirm_pairs(chosen, where, corpus, words, percent), labels, f"round-{turn}")
        left = work.put(told.select("a", "b").join(chosen, ["a", "b"], "left_anti"), f"left-{turn}")

    third = work.put(region_rest(members, labels, described.select("uid", "n_shingles", "sketch"), work, percent), "third")
    work.drop("told", "mixed", "found", "left")
    if not third.isEmpty():
        labels = joined(confirm_pairs(third, where, corpus, words, percent), labels, "rest")

    named = nodes.join(labels, nodes["uid"] == labels["node"], "left").select("set_a", "set_b", "n_shingles", F.coalesce("label", "uid").alias("label"))
    named = work.put(named, "named")
    rows = ledger.join(named, ["set_a", "set_b", "n_shingles"], "left").select("uid", "ord", "doc_id", "n_shingles", F.coalesce("label", "uid").alias("label"))
    rows = work.put(rows, "rows")
    heads = work.put(rows.groupBy("label").agg(F.min(F.struct("ord", "uid", "doc_id")).alias("head")).select("label", F.col("head.uid").alias("head_uid"), F.col("head.doc_id").alias("component_id")), "heads")
    return rows.join(heads, "label").select("doc_id", "n_shingles", "component_id", (F.col("uid") == F.col("head_uid")).alias("kept"), "uid")
