"""Sharding by fixed virtual slots.

Records are hashed into thousands of virtual slots, once and for all (repeated rows by their row numbers too). Their bytes are summed per
slot, and a versioned map says which shard owns a slot. Rebalancing and growing edit that map, of
``slots`` entries at most, and never touch a record's slot.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, carried, text_of, unpacked, unsigned_crc


@dataclass(frozen=True)
class SlotMap:
    """``owner[s]`` is the shard of slot s; an edit gives a new map with the next version."""

    owner: tuple[int, ...]
    shards: int
    version: int = 0
    moved: tuple[int, ...] = field(default=())

    @staticmethod
    def initial(slots: int, shards: int) -> SlotMap:
        return SlotMap(tuple(s % shards for s in range(slots)), shards)

    def _edited(self, owner: np.ndarray, shards: int) -> SlotMap:
        moved = np.flatnonzero(owner != np.array(self.owner))
        return SlotMap(tuple(owner.tolist()), shards, self.version + 1, tuple(moved.tolist()))

    def rebalanced(self, weight: np.ndarray) -> SlotMap:
        """Moves a slot from the heaviest shard to the lightest, or swaps two, while that narrows the gap.

        The slot (or pair) whose weight is nearest to half the gap moves, so each step narrows it.
        """
        owner = np.array(self.owner)
        load = np.bincount(owner, weights=weight, minlength=self.shards)
        for _ in range(4 * len(owner)):
            high, low = int(load.argmax()), int(load.argmin())
            gap = load[high] - load[low]
            mine, theirs = np.flatnonzero((owner == high) & (weight > 0)), np.flatnonzero((owner == low) & (weight > 0))
            if gap <= 0 or not len(mine):
                break
            ours, other = weight[mine], np.sort(weight[theirs])
            by_move = ours[np.abs(ours - gap / 2).argmin()]
            best, pair = (abs(by_move - gap / 2), None) if by_move < gap else (np.inf, None)
            if len(theirs):  # for each slot of the heavy shard, the partner that leaves nearest to half the gap
                at = np.clip(np.searchsorted(other, ours - gap / 2), 0, len(other) - 1)
                left = np.abs(ours - other[at] - gap / 2)
                if left.min() < min(best, gap / 2):
                    k = int(left.argmin())
                    best, pair = left[k], (mine[k], theirs[np.argsort(weight[theirs], kind="stable")[at[k]]])
            if not best < gap / 2:
                break
            if pair is None:
                k = mine[np.abs(ours - gap / 2).argmin()]
                owner[k] = low
                load[high] -= weight[k]
                load[low] += weight[k]
            else:
                a, b = pair
                owner[a], owner[b] = low, high
                load[high] += weight[b] - weight[a]
                load[low] += weight[a] - weight[b]
        return self._edited(owner, self.shards)

    def grown(self, weight: np.ndarray) -> SlotMap:
        """One more shard; slots move only into it, from the heaviest shard each time."""
        owner, new = np.array(self.owner), self.shards
        load = np.append(np.bincount(owner, weights=weight, minlength=new), 0.0)
        goal = weight.sum() / (new + 1)
        while load[new] < goal:
            high = int(load[:new].argmax())
            mine = np.flatnonzero((owner == high) & (weight > 0))
            fits = mine[weight[mine] <= 2 * (goal - load[new])]
            if not len(fits):
                break
            k = fits[0]
            owner[k] = new
            load[high] -= weight[k]
            load[new] += weight[k]
        return self._edited(owner, new + 1)

    def rows(self) -> list[tuple[int, int, int]]:
        return [(self.version, s, o) for s, o in enumerate(self.owner)]


#: Groups of rows equal in id and text are broadcast up to so many (28 bytes each); beyond, the join shuffles.
BROADCAST_GROUPS = 1 << 20


def place_rows(rows: DataFrame, slots: int, work: Workspace) -> DataFrame:
    """``rows`` (id, body, ...), written, with ``size``, ``crc`` and ``vslot`` in place of the body.

    The slot is the hash of id and whole text, so neither a repeated id nor a group of copies fills one. Rows that are equal in
    both, which any of them may stand for, are dealt by their row number as well. Those groups are found by partial
    counts, and a group of very many rows meets its one count by a broadcast or by a join that adaptive execution splits.
    """
    crc = unsigned_crc(F.encode("body", "UTF-8"))
    keyed = rows.withColumns({"size": (F.octet_length("body") + 1).cast("long"), "crc": crc, "h": F.xxhash64("id", "body")}).drop("body")
    repeated = keyed.groupBy("h", "size", "crc").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("r_h"), F.col("size").alias("r_size"), F.col("crc").alias("r_crc"))
    repeated = work.put(repeated, "repeated")
    some = F.broadcast(repeated) if repeated.count() <= BROADCAST_GROUPS else repeated
    told = keyed.join(some, (keyed["h"] == repeated["r_h"]) & (keyed["size"] == repeated["r_size"]) & (keyed["crc"] == repeated["r_crc"]), "left")
    hashed = F.when(F.col("r_h").isNull(), F.col("h")).otherwise(F.xxhash64("h", F.monotonically_increasing_id()))
    placed = told.withColumn("vslot", F.pmod(hashed, F.lit(slots)).cast("int")).drop("h", "r_h", "r_size", "r_crc")
    return work.put(placed, "placed")


def shard_rows(rows: DataFrame, work: Workspace, shards: int, slots: int, versions: list[SlotMap] | None) -> DataFrame:
    """``rows`` (id, body, ...) with ``size, crc, vslot, shard, slot, version`` in place of the body."""
    spark: SparkSession = rows.sparkSession
    placed = place_rows(rows, slots, work)
    sums = placed.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # slots rows at most
    weight, count = np.zeros(slots), np.zeros(slots, dtype=np.int64)
    for row in sums:
        weight[row["vslot"]], count[row["vslot"]] = row["bytes"], row["n"]
    maps = [SlotMap.initial(slots, shards)]
    maps.append(maps[0].rebalanced(weight))
    if versions is not None:
        versions.extend(maps)
    table = [(v, s, o, int(weight[s]), int(count[s])) for m in maps for v, s, o in m.rows()]
    work.put(spark.createDataFrame(table, "version int, vslot int, shard int, bytes long, n long").coalesce(1), "slot-map")
    owner = np.array(maps[-1].owner)
    order = np.lexsort((np.arange(slots), owner))
    before = np.cumsum(count[order]) - count[order]
    first = np.zeros(shards, dtype=np.int64)
    np.add.at(first, owner, count)
    first = np.cumsum(first) - first
    start = np.zeros(slots, dtype=np.int64)
    start[order] = before - first[owner[order]]
    place = spark.createDataFrame([(s, int(owner[s]), int(start[s]), maps[-1].version) for s in range(slots)], "vslot int, shard int, start long, version int")
    rank = F.expr("row_number() over (partition by vslot order by id, crc, size) - 1")
    out = placed.withColumn("rank", rank).join(F.broadcast(place), "vslot")
    return out.withColumn("slot", (F.col("start") + F.col("rank")).cast("long")).drop("start", "rank")


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = 8192, id_column: str = "doc_id", text_column: str = "text", versions: list[SlotMap] | None = None, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard``, ``slot`` (the place in the shard, from 0 without gaps), ``map_version`` and ``vslot``.

    Law ``bytes``: the summed sizes (bytes of the text, and 1) of shards are near equal. Version 0 of the map
    deals slots in turn, version 1 is rebalanced by the bytes of each slot; ``versions``, if given, receives
    both, and they are stored with each slot's bytes and rows as a table in the shared folder.
    A null text has no bytes; null ids are one id; rows that are equal in id and text are dealt apart; ties of order are such rows; an
    empty table gives an empty result. ``columns``: those of ``docs`` to carry (all, if not given); they may have any names, and those
    with the names of results are replaced. Rows are numbered inside a virtual slot and then shifted by what precedes the slot in its
    shard, so the largest sort is of a slot's rows, not of a shard's.
    """
    results = {"size": "size", "text_crc32": "crc", "shard": "shard", "slot": "slot", "map_version": "version", "vslot": "vslot"}
    kept = [c for c in (docs.columns if columns is None else columns) if c not in results]
    with Workspace(docs.sparkSession, "sharding") as work:
        whole = carried(docs, id=id_column, body=text_column)
        own = F.struct(F.lit(0).alias("none"), *[F.col("row")[f"c{docs.columns.index(c)}"].alias(f"c{k}") for k, c in enumerate(kept)])
        rows = whole.select(own.alias("row"), "id", text_of(whole, "body").alias("body"))
        out = shard_rows(rows, work, shards, slots, versions)
        out = out.select(*unpacked(kept), *[F.col(v).alias(k) for k, v in results.items()])
        out = work.put(out, "shards")
        work.clear("shards", "slot-map")
        return out
