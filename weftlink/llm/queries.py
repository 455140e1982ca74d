"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_conversations, turn_digests
from .collocations import collocations
from .common import read_documents
from .conversation_repair import damage_turns, repair_report
from .decontamination import contamination
from .exact_dedup import exact_duplicates
from .language_id import id_fold, identify_language, train_on_folds
from .language_model import score_documents
from .media import text_media
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .packing import pack_documents
from .repeats import remove_repeats
from .sharding import shard_documents


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_documents(spark, sf_dir))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("kept").alias("kept_row"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_documents(spark, sf_dir))


def op3_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    out = score_documents(docs, id_fold(docs["doc_id"], 7) != 2)
    return out.withColumn("held_out", id_fold(F.col("doc_id"), 7) == 2)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    out = identify_language(docs, train_on_folds(docs))
    return out.withColumn("held_out", id_fold(F.col("doc_id"), 5) == 0)


def op5_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(read_documents(spark, sf_dir), shards=16, slots=8192, columns=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def op6_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turn_digests(format_conversations(turns.unionByName(probe)))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_documents(spark, sf_dir))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(read_documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_documents(spark, sf_dir)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_report(damage_turns(turns), turns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


#: CRC-32 of ``conv_id:turn`` bit by bit, as DuckDB has no function for it.
_CRC_SQL = (
    "xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)), "
    "lambda acc, b: list_reduce([xor(acc, b), 1::BIGINT, 1::BIGINT, 1::BIGINT, 1::BIGINT, 1::BIGINT, 1::BIGINT, 1::BIGINT, 1::BIGINT], lambda x, one: CASE WHEN x & one = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)))"
)


def _repair_sql() -> str:
    """The repair as a recursion over rows: of each grammar state the least (cost, audit, lines) so far."""
    edit = lambda v, cost, letter, line=None: f"{{'c': {v}.c + {cost}, 'a': {v}.a || '{letter}', 't': {v}.t" + (f" || chr(10) || {line}" if line else "") + "}"
    least = lambda *of: of[0] if len(of) == 1 else f"list_sort([{', '.join(of)}])[1]"
    none = "{'c': 1000000000, 'a': '', 't': ''}"
    own, user, assistant = "role || ':' || text", "'user:'", "'assistant:'"
    with_user = f"{least('v2', *[edit(v, 2, 'I', user) for v in ('v0', 'v1', 'v3')])} AS w2"
    with_answer = f"{least('v3', edit('w2', 2, 'I', assistant))} AS w3"
    drop = lambda v: edit(v, 3, "D")
    keep = lambda v, x: f"CASE WHEN NOT gone AND x = '{x}' THEN {edit(v, 'cut', 'K', own)} ELSE {none} END"
    give = lambda v, role: f"CASE WHEN NOT gone THEN {edit(v, '2 + cut', 'R', role + ' || text')} ELSE {none} END"
    into2 = [f(v) for v in ("v0", "v1", "w3") for f in (lambda v: keep(v, "u"), lambda v: give(v, user))]
    return rf"""
WITH RECURSIVE h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC_SQL} % 20 AS kind FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, range(0, 2) AS copies(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)
), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS ord FROM damaged),
f AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY ord) > 1 AS again,
    lag(role) OVER (PARTITION BY conv_id ORDER BY ord) AS before FROM n
), r AS (
  SELECT conv_id, ord, turn, role, text, role[1] AS x, said = '' AS blank, said <> '' AND again AS duplicate, said = '' OR again AS gone,
    (said <> '' AND NOT again AND right(said, 1) NOT IN ('.', '!', '?'))::INT AS cut, before IS NOT NULL AND before[1] || role[1] NOT IN ('su', 'ua', 'au') AS illegal FROM f
), step AS (
  SELECT conv_id, 0::BIGINT AS ord, {{'c': 0, 'a': '', 't': ''}} AS v0, {none} AS v1, {none} AS v2, {none} AS v3 FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT conv_id, ord, {drop('v0')}, {least(drop('v1'), keep('v0', 's'))}, {least(drop('w2'), *into2)}, {least(drop('w3'), keep('w2', 'a'), give('w2', assistant))}
  FROM (SELECT *, {with_answer} FROM (SELECT r.*, v0, v1, v2, v3, {with_user} FROM step JOIN r ON r.conv_id IS NOT DISTINCT FROM step.conv_id AND r.ord = step.ord + 1))
), ends AS (SELECT conv_id, {least('v0', 'w3')} AS best FROM (SELECT *, {with_answer} FROM (SELECT *, {with_user} FROM step QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY ord DESC) = 1))),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, sum(cut) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM r GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE_SQL = {
    "op7_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, lag(role) OVER w AS b, lead(role) OVER w AS a,
    replace(replace(text, '\', '\\'), '<|', '<\|') AS safe,
    replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n') AS safe_role
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe) + CASE WHEN b IS NOT DISTINCT FROM role THEN 11 ELSE 12 + length(safe_role) + 1 END
      + CASE WHEN a IS NOT DISTINCT FROM role THEN 0 ELSE 11 END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
""",
    "op8_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
""",
    "op11_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
h AS (SELECT lang, ws, i, unnest(range(1, least(4, len(ws) - i + 1) + 1)) AS size FROM i),
f AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase, string_split(phrase, ' ') AS ws, count(*) AS a FROM h GROUP BY ALL HAVING count(*) >= 30),
k AS (SELECT lang, phrase, a, size, ws, unnest(range(1, size)) AS k FROM f WHERE size > 1),
sides AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest FROM k),
cuts AS (
  SELECT s.lang, s.phrase, s.a, k, x.a AS l, y.a AS r, (s.a::HUGEINT * 2000000 // (x.a + y.a))::BIGINT AS score
  FROM sides s JOIN f x ON x.lang = s.lang AND x.phrase = s.first JOIN f y ON y.lang = s.lang AND y.phrase = s.rest
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS most
  FROM f, range(2, 4) AS ms(m), range(1, 4) AS starts(i) WHERE m < size AND i + m - 1 <= size GROUP BY ALL
), kept AS (SELECT b.* FROM best b LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR most::HUGEINT * 100 < b.a::HUGEINT * 80)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score, k AS cut
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
""",
    "op12_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents
), b AS (
  SELECT row_number() OVER () AS b, coalesce(item_id::VARCHAR, '') AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark
), v AS (SELECT b, item, s, least(10, len(ws)) AS m, ws[s:s + least(10, len(ws)) - 1] AS win FROM (SELECT *, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s FROM b WHERE len(ws) > 0)),
t AS (SELECT uid, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS pos FROM d),
f AS (SELECT uid, i, m, array_to_string(ws[i:i + m - 1], ' ') AS win FROM (SELECT uid, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM v) WHERE len(ws) >= m)),
occurs AS (SELECT uid, i, v.m, item FROM f JOIN v ON v.m = f.m AND f.win = array_to_string(v.win, ' ')),
hit AS (SELECT uid, count(DISTINCT pos) AS n_hit FROM (SELECT uid, unnest(range(i, i + m)) AS pos FROM occurs) GROUP BY uid),
named AS (SELECT uid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occurs GROUP BY uid),
c AS (SELECT term, count(*) AS postings FROM t GROUP BY term),
mem AS (SELECT b, item, s, m, term, j, postings FROM (SELECT b, item, s, m, unnest(win) AS term, unnest(range(0, m)) AS j FROM v) JOIN c USING (term)),
rare AS (SELECT b, s, arg_min(term, (postings, j)) AS term, arg_min(j, (postings, j)) AS j FROM mem GROUP BY b, s, m HAVING count(*) = m),
line AS (SELECT r.b, r.s, t.uid, t.pos - r.j AS base FROM rare r JOIN t ON t.term = r.term),
wants AS (SELECT l.b, l.s, l.uid, l.base, k.item, k.m, k.j, k.term, unnest([l.base + k.j - 1, l.base + k.j, l.base + k.j + 1]) AS pos FROM line l JOIN mem k ON k.b = l.b AND k.s = l.s),
near AS (SELECT uid, count(DISTINCT item) AS n_near FROM (SELECT w.uid, w.item FROM wants w JOIN t ON t.uid = w.uid AND t.pos = w.pos AND t.term = w.term GROUP BY w.b, w.s, w.uid, w.base, w.item, w.m HAVING count(DISTINCT w.j) = w.m) GROUP BY uid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN hit USING (uid) LEFT JOIN named USING (uid) LEFT JOIN near USING (uid)
""",
    "op13_conversation_repair": _repair_sql(),
}
