"""The AI layer: prompts, replies as data, and what of them may be used. Providers are callables."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncated
from ..functions.vectorised import vectorised

ITEM = "target_page_id string, target_url string, is_relevant string, relevance_score string, reason string, anchor_text string, suggested_context string"


class ProviderError(RuntimeError):
    """A provider that failed; ``code`` says how."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


def prompts(sources: DataFrame, candidates: DataFrame, content_chars: int = 6000, excerpt_chars: int = 300) -> DataFrame:
    """``source_page_id, prompt``: JSON of a source and its retrieved pool, at most the pool's size of targets.

    ``sources``: source_page_id, url, title, h1, keywords, content; ``candidates``: source_page_id, rank, target_page_id, url, title, h1,
    keywords, excerpt, avoid (anchors in use).
    """
    target = F.struct(
        "rank", F.col("target_page_id").alias("id"), "url", "title", "h1", F.slice("keywords", 1, 10).alias("keywords"), F.substr("excerpt", F.lit(1), F.lit(excerpt_chars)).alias("excerpt"), F.slice("avoid", 1, 10).alias("avoid_anchors")
    )
    pool = candidates.groupBy("source_page_id").agg(F.sort_array(F.collect_list(target)).alias("candidates"))
    source = F.struct("url", "title", "h1", F.slice("keywords", 1, 20).alias("keywords"), truncated(F.col("content"), content_chars).alias("content"))
    return sources.join(pool, "source_page_id").select("source_page_id", F.to_json(F.struct(source.alias("source"), "candidates")).alias("prompt"))


def ask(prompted: DataFrame, *providers: Callable[[str], str]) -> DataFrame:
    """``source_page_id, reply, provider, error``: the first provider that answers; ``provider`` is its place."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, prompt in zip(frame["source_page_id"], frame["prompt"], strict=True):
                row = (key, None, None, "AI_PROVIDER_NOT_CONFIGURED")
                for k, provider in enumerate(providers):
                    try:
                        row = (key, provider(prompt), k, None)
                        break
                    except ProviderError as error:
                        row = (key, None, k, error.code)
                rows.append(row)
            yield pd.DataFrame(rows, columns=["source_page_id", "reply", "provider", "error"])

    return prompted.select("source_page_id", "prompt").mapInPandas(run, "source_page_id string, reply string, provider int, error string")


def unfenced(reply: Column) -> Column:
    """A reply without the fence that models put around JSON."""
    return F.regexp_replace(F.trim(reply), r"(?s)^```(?:json)?\s*|\s*```$", "")


@vectorised("struct<error:string,items:array<string>>")
def read_reply(reply: pd.Series) -> pd.DataFrame:
    """Items of a reply as JSON texts: an object with ``suggestions`` (or ``items``), or a list, with or without words around it."""
    def one(text: str | None) -> dict:
        bare = re.sub(r"^```(?:json)?\s*|\s*```$", "", (text or "").strip())
        for tried in (bare, bare[bare.find("{") : bare.rfind("}") + 1]):
            try:
                said = json.loads(tried)
            except ValueError:
                continue
            found = said if isinstance(said, list) else said.get("suggestions", said.get("items")) if isinstance(said, dict) else None
            if isinstance(found, list):
                return {"error": None, "items": [json.dumps(x) for x in found]}
        return {"error": "AI_INVALID_RESPONSE", "items": []}

    return pd.DataFrame([one(x) for x in reply], columns=["error", "items"])


def parse_items(replies: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable items, and discards with their reason.

    Scores may be numbers or numeric text, rounded half to even; ``is_relevant`` true, 1 or yes. An item names its target by
    id, and its URL must be that target's if given. Of several for a target, the best, of equals the first.
    """
    rows = replies.select("source_page_id", read_reply(F.col("reply")).alias("r")).select("source_page_id", F.posexplode("r.items").alias("position", "raw"))
    item = rows.withColumn("i", F.from_json("raw", ITEM)).select("source_page_id", "position", "i.*")
    score = F.bround(F.expr("try_cast(relevance_score as double)"), 0).cast("int")
    relevant = F.lower("is_relevant").isin("true", "1", "1.0", "yes", "on", "y", "t")
    known = F.lower("is_relevant").isin("true", "false", "1", "0", "1.0", "0.0", "yes", "no", "on", "off", "y", "n", "t", "f")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    empty = relevant & (blank(F.col("anchor_text")) | blank(F.col("suggested_context")))
    bad = F.col("_id").isNull() | score.isNull() | ~score.between(0, 100) | ~F.coalesce(known, F.lit(False)) | empty
    pool = candidates.select("source_page_id", F.lower("target_page_id").alias("_id"), "target_page_id", F.col("url").alias("_url"))
    both = item.withColumn("_id", F.lower(F.trim("target_page_id"))).drop("target_page_id").withColumn("score", score).withColumn("_bad", bad)
    both = both.join(pool, ["source_page_id", "_id"], "left")
    problem = (
        F.when(F.coalesce("_bad", F.lit(True)), "INVALID_AI_ITEM")
        .when(F.col("_url").isNull(), "UNKNOWN_TARGET")
        .when(~blank(F.col("target_url")) & (F.regexp_replace("target_url", "/+$", "") != F.regexp_replace("_url", "/+$", "")), "TARGET_URL_MISMATCH")
        .when(~relevant, "NOT_RELEVANT")
    )
    judged = both.withColumn("problem", problem)
    best = F.expr("row_number() over (partition by source_page_id, target_page_id order by score desc, position)")
    good = judged.where("problem is null").withColumn("_rank", best).where("_rank = 1")
    items = good.select("source_page_id", "target_page_id", F.col("_url").alias("target_url"), F.col("score").alias("relevance_score"), "reason", "anchor_text", "suggested_context", "position")
    return items, judged.where("problem is not null").select("source_page_id", F.coalesce("target_page_id", "_id").alias("target_page_id"), "position", "problem")
