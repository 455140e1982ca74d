"""Chat formatting as one relational plan: collected turn structs are sorted, adjacent turns of one role
merged by array functions, and the pieces concatenated; Spark expressions only.

The template (fixed strings)::

    <|im_start|>ROLE\\nTEXT<|im_next|>TEXT<|im_end|>\\n

A block holds adjacent turns of one role, parted by ``<|im_next|>``, so merging loses no turn. In roles
and texts ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``; no control string can arise inside
them, and undoing both gives the text back. Newlines of a role become ``\\n`` (backslash, n).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _role_escaped(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\n"))


def _role_unescaped(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, segments``: one row a conversation, its turns in order of ``turn``.

    ``segments`` is the loss mask with its text: an array of (piece, loss) whose pieces make up ``formatted``;
    ``loss`` holds for the escaped texts of ``trained_role``, marks excluded. Null texts and roles are empty;
    null turns come first; equal turn numbers are ordered by role, then text; a null ``conv_id`` is a
    conversation of its own. Other columns are ignored; an empty table gives no rows.
    """
    empty = F.lit("")
    kept = turns.select(
        turns["conv_id"].alias("conv_id"),
        F.struct(turns["turn"].alias("turn"), F.coalesce(turns["role"], empty).alias("role"), F.coalesce(turns["text"], empty).alias("text")).alias("t"),
    )
    grouped = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # each turn beside the role before and after it: one pass, no look-up inside the array
    roles = F.col("turns.role")
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(roles, 1, F.size("turns") - 1))
    after = F.concat(F.slice(roles, 2, F.size("turns")), F.array(F.lit(None).cast("string")))
    zipped = F.zip_with(F.zip_with("turns", before, lambda t, b: F.struct(t["role"].alias("role"), t["text"].alias("text"), b.alias("b"))), after, lambda t, a: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["b"].eqNullSafe(t["role"]).alias("joined"), a.eqNullSafe(t["role"]).alias("goes_on")))

    def pieces(t: Column) -> Column:
        head = F.when(t["joined"], F.lit(NEXT)).otherwise(F.concat(F.lit(START), _role_escaped(t["role"]), F.lit("\n")))
        tail = F.when(t["goes_on"], empty).otherwise(F.lit(END))
        piece = lambda x, loss: F.struct(x.alias("piece"), loss.alias("loss"))
        return F.array(piece(head, F.lit(False)), piece(escaped(t["text"]), t["role"] == trained_role), piece(tail, F.lit(False)))

    out = grouped.select("conv_id", F.flatten(F.transform(zipped, pieces)).alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"), "segments")


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, formatted, segments``: the turns (role, text) parsed from ``formatted`` alone."""
    def block(b: Column) -> Column:
        role = _role_unescaped(F.substring_index(b, "\n", 1))
        body = F.substr(b, F.instr(b, "\n") + 1)
        return F.transform(F.split(body, r"<\|im_next\|>", -1), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    # a block ends with the end mark; the last piece after it is empty
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda b: b != "")
    bare = F.transform(blocks, lambda b: F.substr(b, F.lit(len(START) + 1)))
    return formatted.select("conv_id", F.flatten(F.transform(bare, block)).alias("turns"), "formatted", "segments")


def turn_digests(formatted: DataFrame) -> DataFrame:
    """Counts and checksums of what ``format_conversations`` wrote, read back from it."""
    back = read_back(formatted)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["piece"])), "")
    # rows alone, so that no long expression is inlined into the lambdas again
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
