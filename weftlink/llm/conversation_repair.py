"""Repair of the turn structure of conversations at the least cost, by layers of reachable states.

Roles have to read ``(s?(ua)+)?`` by their initials. A row is kept (0), given the role user or assistant (2) or deleted (3); an empty
user or assistant row may be inserted anywhere (2); a truncated row that stays costs 1 more; blank and repeated rows must go.

Spark numbers the rows of a conversation, finds their faults, and makes one letter of each row. For that string, layer ``c`` holds
for every place between rows the set of grammar states that cost ``c`` reaches and nothing cheaper does, as four bits; keeping a
sound row stays inside a layer, other edits go to later ones. The first layer that accepts behind the last row is the cost. Bits from
which the end is reached at that cost are traced back, and the least letters of edits through them are the audit. A state
more than ``MARGIN`` above its place's first layer is on no cheapest way, so layers are narrow and time and memory are in
proportion to the rows. Edits then join the rows again; texts never gather in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Workspace, picked

# Fixed values of the contract: costs, roles that edits may give, white space, marks that end a text.
RETAG, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
WHITE_CHARS = " \t\n\x0b\x0c\r"
MARKS = (".", "!", "?")
#: States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ACCEPTS = 0b1001
#: From any state two insertions reach a user or assistant state, and a kept system turn saves one deletion.
MARGIN = 2 * INSERT + DELETE


def _forward(*letters: str) -> list[int]:
    return [sum({1 << to for x in letters for at, to in MOVES[x].items() if bits >> at & 1}) for bits in range(16)]


def _back(*letters: str) -> list[int]:
    return [sum({1 << at for x in letters for at, to in MOVES[x].items() if bits >> to & 1}) for bits in range(16)]


STEP, GIVE = {x: _forward(x) for x in MOVES} | {"x": [0] * 16}, _forward("u", "a")
UNSTEP, UNGIVE = {x: _back(x) for x in MOVES} | {"x": [0] * 16}, _back("u", "a")


def cost_layers(rows: str) -> list[dict[int, int]]:
    """By cost, up to the first that accepts: places and the states that are reached there first at that cost.

    ``rows``: a letter a row: d must go; s, u, a by the role, x any other role; a capital: truncated.
    """
    n, layers, waiting = len(rows), [], {0: {0: 1}}
    seen, first = bytearray(n + 1), [-1] * (n + 1)

    def later(cost: int, place: int, bits: int) -> None:
        if bits:
            layer = waiting.setdefault(cost, {})
            layer[place] = layer.get(place, 0) | bits

    while True:
        cost, layer = len(layers), {}
        now = waiting.pop(cost, {})
        for start in sorted(now):
            place = start
            while place in now:  # kept rows lead on inside the layer
                bits = now.pop(place) & ~seen[place]
                if first[place] < 0:
                    first[place] = cost
                if not bits or cost > first[place] + MARGIN:
                    break
                seen[place] |= bits
                layer[place] = bits
                later(cost + INSERT, place, GIVE[bits])
                if place < n:
                    row = rows[place]
                    later(cost + DELETE, place + 1, bits)
                    if row != "d":
                        more, kept = TRUNCATED * row.isupper(), STEP[row.lower()][bits]
                        later(cost + RETAG + more, place + 1, GIVE[bits])
                        if more:
                            later(cost + more, place + 1, kept)
                        elif kept:
                            now[place + 1] = now.get(place + 1, 0) | kept
                place += 1
        layers.append(layer)
        if layer.get(n, 0) & ACCEPTS:
            return layers


@lru_cache(maxsize=1 << 14)
def solve(rows: str) -> tuple[int, str, tuple[str, ...]]:
    """Cost, audit, and for each row, and the end, the letters of roles inserted before it and then k kept, d deleted, u or a given; e the end."""
    layers, n = cost_layers(rows), len(rows)
    cost = len(layers) - 1
    useful: list[dict[int, int]] = [{} for _ in layers]
    leads = lambda c, place: useful[c].get(place, 0) if c <= cost else 0
    useful[cost][n] = layers[cost][n] & ACCEPTS
    for c in range(cost, -1, -1):
        for place in sorted(layers[c], reverse=True):
            goal = leads(c, place) | UNGIVE[leads(c + INSERT, place)]
            if place < n:
                goal |= leads(c + DELETE, place + 1)
                if (row := rows[place]) != "d":
                    more = TRUNCATED * row.isupper()
                    goal |= UNSTEP[row.lower()][leads(c + more, place + 1)] | UNGIVE[leads(c + RETAG + more, place + 1)]
            useful[c][place] = layers[c][place] & goal
    c, place, state, audit, pieces, piece = 0, 0, 1, [], [], ""
    while not (c == cost and place == n and state & ACCEPTS):
        given = "a" if state == 1 << 2 else "u"
        row = rows[place] if place < n else "d"
        more = TRUNCATED * row.isupper()
        if place < n and state & leads(c + DELETE, place + 1):
            edit, c, mark = "D", c + DELETE, "d"
        elif GIVE[state] & leads(c + INSERT, place):
            edit, c, state, piece = "I", c + INSERT, GIVE[state], piece + given
        elif row != "d" and STEP[row.lower()][state] & leads(c + more, place + 1):
            edit, c, state, mark = "K", c + more, STEP[row.lower()][state], "k"
        else:
            edit, c, state, mark = "R", c + RETAG + more, GIVE[state], given
        audit.append(edit)
        if edit != "I":
            pieces.append(piece + mark)
            place, piece = place + 1, ""
    return cost, "".join(audit), (*pieces, piece + "e")


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [solve(x) for x in batch.column("rows").to_pylist()]
        columns = [pa.array([c for c, _, _ in found], pa.int64()), pa.array([a for _, a, _ in found], pa.string()), pa.array([list(p) for _, _, p in found], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("rows"), *columns], ["rows", "cost", "audit", "pieces"])


def _digest(kind: pa.DataType):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """SHA-256 of each conversation's lines; rows come in order, a conversation's one after another."""
        now, held = None, None
        for batch in batches:
            done: list[tuple] = []
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if held is None or conv != now:
                    if held is not None:
                        done.append((now, held.hexdigest()))
                    now, held = conv, hashlib.sha256(line.encode())
                else:
                    held.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([x for _, x in done], pa.string())], ["conv_id", "sha"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([held.hexdigest()], pa.string())], ["conv_id", "sha"])

    return digest


def turn_faults(turns: DataFrame) -> DataFrame:
    """``conv_id, ord, turn, role, text, fault, letter, illegal, new_turn`` of rows (conv_id, turn, role, text) without null roles or texts."""
    conv = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.withColumn("ord", F.row_number().over(conv))
    before = Window.partitionBy("conv_id").orderBy("ord")
    same = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("ord"))
    end = F.substring(F.rtrim("text", F.lit(WHITE_CHARS)), -1, 1)
    fault = F.when(end == "", "blank").when(same > 1, "duplicate").when(~end.isin(*MARKS), "truncated")
    first = F.substring("role", 1, 1)
    known = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    pair = F.concat(F.lag(first).over(before), first)
    last = F.lag("turn").over(before)
    return rows.withColumn("fault", fault).select(
        "conv_id", "ord", "turn", "role", "text", "fault", letter.alias("letter"), (pair.isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & (last.isNull() | (last != F.col("turn")))).alias("new_turn"),
    )


def repair_conversations(turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """A report a conversation, and the rows of the repaired conversations.

    Report: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` (of lines ``role:text``). Repaired:
    ``conv_id, place, role, text, edit`` (K, R or I), places from 1 on, with gaps where rows were deleted. Rows of a conversation are in the order of turn (nulls
    first), role and text. A null role or text counts as one space, null conversations are one; a role that begins with none of s, u, a
    has to be changed or deleted. A row's first fault counts: blank, duplicate, truncated. Rows that repeat are duplicates; an empty table
    gives empty ones; other columns are not read. Both stay readable as long as the session's files.
    """
    spark = turns.sparkSession
    with Workspace(spark, "conversation-repair") as work:
        own = picked(turns, conv_id=conv_column, turn=turn_column, role=role_column, text=text_column)
        filled = own.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")})
        rows = work.put(turn_faults(filled), "rows", "zstd")

        many = lambda c: F.count(F.when(c, 1))
        wide = lambda c: F.col(c).cast("decimal(20, 0)")
        letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "letter"))), lambda x: x["letter"]), "")
        told = rows.groupBy("conv_id").agg(
            F.min("turn").alias("low"), F.max("turn").alias("high"), many(F.col("new_turn")).alias("turns"), *[many(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
            many(F.col("illegal")).alias("illegal"), letters.alias("rows"),
        )
        gaps = F.coalesce((wide("high") - wide("low") + 1 - F.col("turns")).try_cast("long"), F.lit(0))
        told = work.put(told.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "rows"), "told")
        # conversations of one form are solved once
        solved = work.put(told.select("rows").distinct().mapInArrow(_solve, "rows string, cost long, audit string, pieces array<string>"), "solved")
        told = told.join(solved, "rows")

        edits = told.select("conv_id", F.posexplode("pieces").alias("at", "piece")).select(F.col("conv_id").alias("e_conv"), (F.col("at") + 1).alias("e_ord"), "piece")
        joined = edits.join(rows, edits["e_conv"].eqNullSafe(rows["conv_id"]) & (edits["e_ord"] == rows["ord"]), "left")
        mark = F.substring("piece", -1, 1)
        given = lambda x: F.when(x == "u", ROLES["u"]).otherwise(ROLES["a"])
        added = F.transform(F.filter(F.split(F.expr("left(piece, length(piece) - 1)"), ""), lambda x: x != ""), lambda x: F.struct(given(x).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
        own_row = F.struct(F.when(mark == "k", F.col("role")).otherwise(given(mark)).alias("role"), "text", F.when(mark == "k", "K").otherwise("R").alias("edit"))
        every = F.concat(added, F.when(mark.isin("k", "u", "a"), F.array(own_row)).otherwise(F.array().cast("array<struct<role string, text string, edit string>>")))
        lines = joined.select(F.col("e_conv").alias("conv_id"), "e_ord", F.posexplode(every).alias("sub", "line"))
        repaired = work.put(lines.select("conv_id", "e_ord", "sub", "line.role", "line.text", "line.edit"), "repaired", "zstd")

        sorted_ = repaired.select("conv_id", "e_ord", "sub", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "e_ord", "sub")
        field = repaired.schema["conv_id"].dataType
        hashed = sorted_.select("conv_id", "line").mapInArrow(_digest(to_arrow_type(field)), f"conv_id {field.simpleString()}, sha string").toDF("h_conv", "sha")
        report = told.join(hashed, told["conv_id"].eqNullSafe(hashed["h_conv"]), "left")
        sha = F.coalesce("sha", F.sha2(F.lit(""), 256))
        report = work.put(report.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", sha.alias("repaired_sha256")), "report")
        work.clear("report", "repaired")
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy("e_ord", "sub"))
        return report, repaired.select("conv_id", place.alias("place"), "role", "text", "edit")


def damage_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the faults that a hash of conversation and turn gives them; nulls of role and text become one space."""
    own = picked(turns, conv_id="conv_id", turn="turn", role="role", text="text")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = own.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("copy")).drop("copy")


def repair_report(turns: DataFrame, originals: DataFrame) -> DataFrame:
    """The report for every conversation of ``originals``: zeros, no audit and the hash of nothing where no row is left."""
    report, _ = repair_conversations(turns)
    every = picked(originals, o_conv="conv_id").distinct()
    out = every.join(report, every["o_conv"].eqNullSafe(report["conv_id"]), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("o_conv").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
